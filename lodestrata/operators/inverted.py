"""From texts to terms, postings, norms and the statistics of a term dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import segwrite
from .ordinals import with_ordinal

TOKEN = "[a-z0-9]+"
BLOCK = 128  #: postings in a packed block
RANGE = 1 << 16  #: ids of a range; a row holds a term's documents of one range at most


def tokens(docs: DataFrame, field: Column, doc_id: Column, text: Column) -> DataFrame:
    """``(field_name, doc_id, position, term)``; null texts have none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return docs.select(field.alias("field_name"), doc_id.alias("doc_id"), F.posexplode(found).alias("position", "term"))


def postings(toks: DataFrame) -> DataFrame:
    """``(field_name, term, doc_id, freq)``: partial counts on the map side, one shuffle."""
    return toks.groupBy("field_name", "term", "doc_id").agg(F.count(F.lit(1)).alias("freq"))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in segwrite.portions(batches):
        field = part.column("field_name").combine_chunks().dictionary_encode("encode")
        code, ids = field.indices.to_numpy(), part.column("doc_id").to_numpy()
        order = np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        _, words, cuts, at, freqs = segwrite.inverted(part.column("text").take(pa.array(order)).to_pylist())
        if not words:
            continue
        term, bucket = np.repeat(np.arange(len(words)), np.diff(cuts)), ids[at] // RANGE
        first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(code[at]) != 0) | (np.diff(bucket) != 0)]))
        names = field.dictionary.take(pa.array(code[at[first]])).cast(pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(ids[at]))
        yield pa.record_batch([names, pa.array([w.decode() for w in words]).take(pa.array(term[first])), pa.array(bucket[first]), lists, pa.array(np.add.reduceat(freqs, first))], names=["field_name", "term", "range", "ids", "freq"])


def invert(docs: DataFrame, field: Column, doc_id: Column, text: Column) -> DataFrame:
    """``(field_name, term, range, ids, freq)``: documents of each term in a range of RANGE ids, in order and without
    repeats, and how often they have it. Every task inverts portions of its documents, so that what is shuffled,
    once and by field and term, is lists and no single tokens."""
    rows = docs.select(field.alias("field_name"), doc_id.cast("long").alias("doc_id"), F.lower(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lists = rows.mapInArrow(_inverted, "field_name string, term string, range long, ids array<long>, freq long").repartition("field_name", "term")
    return lists.groupBy("field_name", "term", "range").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.sum("freq").alias("freq"))


def term_freqs(lists: DataFrame) -> DataFrame:
    """``(field_name, term, doc_freq, total_term_freq)`` of what ``invert`` gives."""
    return lists.groupBy("field_name", "term").agg(F.sum(F.size("ids").cast("long")).alias("doc_freq"), F.sum("freq").alias("total_term_freq"))


def term_fields(docs: DataFrame, field: Column, doc_id: Column, text: Column, docs_only: bool = False) -> DataFrame:
    """Statistics of each field's dictionary: terms, sums of document and term frequencies, documents, least and
    greatest term in byte order. With ``docs_only`` no term frequencies are kept and their sum is -1."""
    per_term = term_freqs(invert(docs, field, doc_id, text))
    byte = F.col("term").cast("binary")
    ttf = F.lit(-1).cast("long") if docs_only else F.sum("total_term_freq")
    stats = per_term.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("num_terms"), F.sum("doc_freq").alias("sum_doc_freq"), ttf.alias("sum_total_term_freq"),
        F.decode(F.min(byte), "UTF-8").alias("min_term"), F.decode(F.max(byte), "UTF-8").alias("max_term"),
    )
    some = docs.where(F.lower(text).rlike(TOKEN)).select(field.alias("field_name"), doc_id.alias("doc_id")).distinct()
    count = some.groupBy(F.col("field_name").alias("_f")).agg(F.count("doc_id").alias("doc_count"))
    return stats.join(count, F.col("field_name").eqNullSafe(F.col("_f"))).drop("_f")


def posting_lists(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(field_name, term, block, base, doc_ids, deltas)``: the ascending ids of each term in blocks of ``block``, and
    their differences, the first from ``base``, the last id of the block before (0 for the first).

    Of what ``invert`` gives, a range's first place is the sum of the ranges before; its ids are cut into blocks, and
    those which go over several ranges are put together. All of that keeps the distribution by field and term.
    """
    w = Window.partitionBy("field_name", "term").orderBy("range")
    n = F.size("ids").cast("long")
    rows = lists.select(
        "field_name", "term", "ids", n.alias("n"), F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("start"),
        F.coalesce(F.lag(F.element_at("ids", -1)).over(w), F.lit(0).cast("long")).alias("last"),
    )
    rows = rows.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + n - 1) div {block})")))
    low, high = F.greatest(F.col("block") * block - F.col("start"), F.lit(0)).cast("int"), F.least((F.col("block") + 1) * block - F.col("start"), F.col("n")).cast("int")
    rows = rows.withColumn("low", low).select("field_name", "term", "block", F.slice("ids", F.col("low") + 1, high - F.col("low")).alias("part"), F.when(F.col("low") == 0, F.col("last")).otherwise(F.get("ids", F.col("low") - 1)).alias("base"))
    out = rows.groupBy("field_name", "term", "block").agg(F.min_by("base", F.element_at("part", 1)).alias("base"), F.array_sort(F.flatten(F.collect_list("part"))).alias("doc_ids"))
    before = F.concat(F.array("base"), F.slice("doc_ids", 1, F.size("doc_ids") - 1))
    return out.select("field_name", "term", "block", "base", "doc_ids", F.zip_with("doc_ids", before, lambda a, b: a - b).alias("deltas"))


def from_deltas(lists: DataFrame) -> DataFrame:
    """``(field_name, term, doc_id)`` from blocks of differences: the running sum of each block from its base."""
    ids = F.aggregate("deltas", F.array("base"), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))
    return lists.select("field_name", "term", F.explode(F.slice(ids, 2, F.size("deltas"))).alias("doc_id"))


def posting_blocks(lists: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(field_name, term, block, n, full, bits, bytes)``: postings in blocks of ``block`` differences. A full
    block is packed with as many bits as its greatest value needs; the rest are variable-length integers."""
    rows = posting_lists(lists, block)
    width = F.transform("deltas", lambda d: F.when(d == 0, 0).otherwise(F.length(F.bin(d))))
    vints = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.greatest(F.ceil(x / 7), F.lit(1)))
    out = rows.select("field_name", "term", "block", F.size("deltas").cast("long").alias("n"), width.alias("width"))
    out = out.select("field_name", "term", "block", "n", F.array_max("width").cast("long").alias("bits"), vints(F.col("width")).alias("vints"))
    full = F.col("n") == block
    return out.select("field_name", "term", "block", "n", full.alias("full"), "bits", F.when(full, F.ceil(F.col("n") * F.col("bits") / 8) + 1).otherwise(F.col("vints")).cast("long").alias("bytes"))


def norms(toks: DataFrame) -> DataFrame:
    """``(field_name, doc_id, norm)``: the length of every field in tokens."""
    return toks.groupBy("field_name", "doc_id").agg(F.count(F.lit(1)).alias("norm"))


def term_ordinals(per_term: DataFrame) -> DataFrame:
    """``per_term`` with ``term_ord``, the place of the term in its field's dictionary in byte order."""
    return with_ordinal(per_term, ["field_name"], [F.col("term").cast("binary")], "term_ord")


def shared_prefix(ordered: DataFrame) -> DataFrame:
    """``(field_name, term_ord, term, prefix)``: characters that a term shares with the one before it, which
    prefix coding leaves out. Joins on ordinals, so that no task holds a whole dictionary."""
    before = ordered.select("field_name", (F.col("term_ord") + 1).alias("term_ord"), F.col("term").alias("last"))
    rows = ordered.select("field_name", "term_ord", "term").join(before, ["field_name", "term_ord"], "left")
    n = F.least(F.length("term"), F.length("last"))
    match = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring("term", F.lit(1), i) == F.substring("last", F.lit(1), i))
    prefix = F.when(F.col("last").isNull() | (n == 0), 0).otherwise(F.size(match))
    return rows.select("field_name", "term_ord", "term", prefix.cast("long").alias("prefix"))


def boolean(post: DataFrame, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """``doc_id`` of the documents with every term of ``every``, one of ``some`` and none of ``none``. Only the
    postings of these terms are looked at; one aggregation by document does the set operations."""
    wanted = [*every, *some, *none]
    has = lambda t: F.max((F.col("term") == t).cast("int")) == 1
    test = F.lit(True)
    for t in every:
        test = test & has(t)
    if some:
        test = test & (F.max(F.col("term").isin(list(some)).cast("int")) == 1)
    for t in none:
        test = test & ~has(t)
    return post.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(test.alias("ok")).where("ok").select("doc_id")


def term_prefix(per_term: DataFrame, prefix: str) -> DataFrame:
    return per_term.where(F.col("term").startswith(prefix))


def term_range(per_term: DataFrame, low: str, high: str) -> DataFrame:
    """Terms from ``low`` to ``high``, both included, in byte order."""
    byte = F.col("term").cast("binary")
    return per_term.where((byte >= F.lit(low).cast("binary")) & (byte <= F.lit(high).cast("binary")))
