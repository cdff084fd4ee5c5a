"""Languages told by how well each one's dictionary compresses a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh, lean, sized, small_batches
from ._text import flat

SAMPLE_DOCS = 200  #: documents that make a language's dictionary at most: those with the least hash of their ids
SAMPLE_CHARS = 1_200  #: characters that each of them gives, from a place in the text that the hash picks
SAMPLE_BYTES = 64 << 20  #: of all dictionaries together; with very many labels each gets fewer documents
LEVEL = 5  #: compression level, with matches of 3 bytes and up, as words of natural language are short
BLOCK = 4_096  #: bytes compressed at once: longer texts would make a dictionary of themselves
MARGIN = 0.01  #: least advantage over the second language, as a share of the second's size
LEAST = 2  #: the same in bytes: sizes are whole bytes, and one byte is chance


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Raw-content dictionaries of all labelled languages of ``docs``, from a bounded sample: SAMPLE_DOCS documents
    each, SAMPLE_CHARS characters of each, SAMPLE_BYTES together. Choosing them reads ids and labels of all rows.

    Null labels, ids and texts are left out; of repeated ids one window counts, the least. A label whose texts
    are empty gives no dictionary. More labels than documents that SAMPLE_BYTES has room for are an error: such
    a column holds no languages. Other columns don't matter; an empty table gives none.
    """
    src = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("g"), F.col(text_col).alias("x"))
    ids = src.select("g", F.xxhash64("i").alias("h"), F.col("i").isNotNull().alias("known")).where("g is not null and known")
    labels = ids.select("g").distinct().count()
    if not labels:
        return {}
    room = SAMPLE_BYTES // (4 * SAMPLE_CHARS)
    if labels > room:
        raise ValueError(f"{lang_col} has {labels} labels; there is room for the dictionaries of {room}")
    first = F.row_number().over(Window.partitionBy("g").orderBy("h"))
    chosen = ids.select("g", "h").distinct().select("g", "h", first.alias("k")).where(F.col("k") <= min(SAMPLE_DOCS, room // labels)).select("g", "h").collect()  # SAMPLE_BYTES bound it
    frame = docs.sparkSession.createDataFrame([(r.g, r.h) for r in chosen], "g string, h long")
    texts = src.where("x <> ''").withColumn("h", F.xxhash64("i")).join(F.broadcast(frame), ["g", "h"])  # bounded as above
    place = F.pmod("h", F.greatest(F.lit(1), F.length("x") - SAMPLE_CHARS + 1)) + 1
    window = F.substring("x", place.cast("int"), F.lit(SAMPLE_CHARS))
    rows = texts.groupBy("g", "h").agg(F.min(window).alias("x")).orderBy("g", "h").collect()  # one for each of them
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r.g, []).append(r.x.lower())
    return {g: "\n".join(x).encode() for g, x in found.items()}


def _encoders(dicts: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for g in sorted(dicts):
        raw = dicts[g].ljust(8, b"\n")  # the library takes no less
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(raw), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        d.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
    return out


def sizes(arr: pa.Array, encoders: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """(texts x languages) compressed bytes of each whole text, in lower case and block by block."""
    raw, off = flat(pc.utf8_lower(arr))
    view = memoryview(raw)
    out = np.zeros((len(off) - 1, len(encoders)), dtype=np.int64)
    for k, e in enumerate(encoders):
        squeeze = e.compress
        for d in range(len(off) - 1):
            lo, hi = int(off[d]), int(off[d + 1])
            out[d, k] = sum(len(squeeze(view[at : min(at + BLOCK, hi)])) for at in range(lo, hi, BLOCK))
    return out


def decide(found: np.ndarray, margin: float = MARGIN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's number, its margin and whether that is accepted, for rows of sizes. Where there is one
    language only, the margin is 1 for any text; an empty text has margin 0."""
    if not found.shape[1]:
        return np.zeros(len(found), np.int64), np.zeros(len(found)), np.zeros(len(found), bool)
    best = found.argmin(axis=1)
    rest = np.sort(found, axis=1)
    second = rest[:, 1].astype(float) if found.shape[1] > 1 else np.where(rest[:, 0] > 0, np.inf, 0.0)
    gap = np.where(np.isinf(second), 1.0, np.where(second > 0, (second - rest[:, 0]) / np.maximum(second, 1), 0.0))
    return best, gap, (gap >= margin) & (second - rest[:, 0] >= least) & (second > 0)


def _classify(dicts: dict[str, bytes], margin: float) -> Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray]]:
    names = pa.array(sorted(dicts), pa.string())

    def run(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        if not hasattr(run, "encoders"):
            run.encoders = _encoders(dicts)
        best, gap, ok = decide(sizes(texts, run.encoders), margin)
        lang = names.take(pa.array(best)) if len(names) else pa.nulls(len(best), pa.string())
        return lang, gap, ok

    return run


def identify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``(doc_id, lang, margin, accepted)`` for every row, over whole texts of any length; no shuffle.

    ``lang`` is the language of the smallest encoding (ties: the first by name). A margin under ``margin``, or of
    fewer than LEAST bytes, rejects; so are null and empty texts rejected, with margin 0. Repeated rows and null
    ids are rows like any other; other columns, whatever their names, don't matter; an empty table gives no
    rows; without dictionaries all are rejected.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    classify = _classify(dicts, margin)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sized(batches, "text"):
            lang, gap, ok = classify(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), lang, pa.array(np.round(gap, 6)), pa.array(ok)], names=["doc_id", "lang", "margin", "accepted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang string, margin double, accepted boolean")


def keep_identified(docs: DataFrame, dicts: dict[str, bytes], text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN) -> DataFrame:
    """``docs`` without the rows whose language is rejected (see ``identify`` for nulls, empty texts and ties),
    ``lang_col`` set to what was found; other columns stay as they were, whatever their names. No shuffle; only the
    text goes to Python, and only the language comes back."""
    small_batches(docs.sparkSession)
    classify = _classify(dicts, margin)

    def texts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            batch = pa.record_batch([a], names=["text"])
            parts = []
            for b in sized(iter([batch]), "text"):
                lang, _, ok = classify(b.column(0))
                parts.append(pc.if_else(pa.array(ok), lang, pa.scalar(None, pa.string())))
            yield pa.concat_arrays(parts) if parts else pa.nulls(0, pa.string())

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(texts)(arrays)

    name = fresh(docs, "language_found")
    found = docs.withColumn(name, F.arrow_udf(run, "string").asNondeterministic()(F.col(text_col)))  # so that it is evaluated once
    kept = found.where(F.col(name).isNotNull())
    kind = docs.schema[lang_col].dataType
    return kept.select(*[F.col(name).cast(kind).alias(c) if c == lang_col else F.col(f"`{c}`") for c in docs.columns])
