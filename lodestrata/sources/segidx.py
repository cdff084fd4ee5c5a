"""A segmented index as a PySpark data source: ``spark.read.format("segidx").option("table", ...).load(path)``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

from . import segments as S
from .segments import Segment

ROWS = 8_192  #: rows of a batch
LEAVES = 16  #: leaves of points in a batch
GROUP = 2_048  #: chunks of stored documents that one task reads
DOCS = 1 << 20  #: documents of which one task reads the norms or numbers; a multiple of 8

_ENTRY = "format string, missing_offset bigint, offset bigint, count bigint, min_value bigint, gcd bigint, bits_per_value int, table array<bigint>, min_length bigint, max_length bigint, addr_offset bigint, end_offset bigint"
SCHEMAS = {
    "commit": "generation string, codec string, format_version bigint, object_id string, index_version string, index_update_count bigint, name_counter bigint, segment_count bigint, min_segment_version string, user_data map<string,string>",
    "segments": "seg_name string, has_segment boolean, segment_id string, codec string, del_gen bigint, del_count bigint, field_info_gen bigint, doc_values_gen bigint, field_info_files array<string>, dv_field_count bigint, dv_fields map<bigint,array<string>>",
    "segment_info": "segment string, version string, segment_size bigint, is_compound_file boolean, diagnostics map<string,string>, files array<string>, attributes map<string,string>, num_sort_fields bigint",
    "compound_entries": "segment string, file_name string, offset bigint, length bigint",
    "file_headers": "segment string, file string, magic bigint, codec string, format_version bigint, object_id string, suffix_length int, suffix string, footer_magic bigint, checksum_algo bigint, checksum_expected bigint, checksum_actual bigint, ok boolean",
    "fields": "segment string, field_number bigint, field_name string, field_bits int, store_term_vec boolean, omit_norm boolean, store_payload boolean, index_option_bits int, doc_values_bits int, doc_values_gen bigint, attributes map<string,string>, dimension_count int, dimension_member_bytes int",
    "stored_chunks": "segment string, block_id bigint, chunk_id bigint, doc_base bigint, start_pointer bigint, chunk_docs bigint, raw_length bigint",
    "stored_info": "segment string, chunk_size bigint, packed_version bigint, max_pointer bigint, num_chunks bigint, num_dirty_chunks bigint, tail_ok boolean",
    "stored": "segment string, doc_id bigint, ord int, doc_start_ptr bigint, field_number bigint, field_name string, type_tag int, str string, bin binary, int int, float float, long bigint, double double",
    "dv_meta": f"segment string, field_name string, field_type string, role string, {_ENTRY}",
    "dv_values": "segment string, field_name string, doc_id bigint, ord int, long_value bigint, bin_value binary",
    "norms": "segment string, field_number bigint, field_name string, doc_id bigint, norm bigint",
    "points_index": "segment string, field_number bigint, field_name string, fp bigint",
    "points_tree": "segment string, field_number bigint, field_name string, num_dims int, max_points_in_leaf bigint, bytes_per_dim int, num_leaves bigint, min_packed binary, max_packed binary, point_count bigint, doc_count bigint, version int",
    "points": "segment string, field_number bigint, field_name string, leaf bigint, doc_id bigint, dim int, raw binary, unsigned decimal(20,0), value bigint",
    "term_fields": "segment string, field_name string, field_number bigint, num_terms bigint, num_bytes bigint, root_code binary, index_opts int, min_term binary, max_term binary, sum_doc_freq bigint, doc_count bigint, longs_size int, index_start_ptr bigint, sum_total_term_freq bigint",
    "term_index": "segment string, field_name string, format_version int, empty_output binary, input_bytes int, start_node bigint, num_bytes bigint",
    "terms": "segment string, field_name string, term_ord bigint, term binary, doc_freq bigint, total_term_freq bigint, doc_start_fp bigint, pos_start_fp bigint, payload_start_fp bigint, skip_offset bigint, singleton_doc_id bigint",
    "postings": "segment string, field_name string, term binary, doc_id bigint, freq bigint",
}
_BY_FIELD = {"dv_values", "norms", "points", "terms", "postings"}


@dataclass
class Part(InputPartition):
    """What one task reads of a segment: all of it, a field, a range of its documents, or chunks; field -1 is nothing."""

    segment: str
    number: int | None = None
    starts: tuple[int, ...] = ()
    low: int = 0
    high: int | None = None


def _own_fields(seg: Segment, table: str) -> list[int]:
    if table == "dv_values":
        return [m["info"]["field_number"] for m in seg.dv_meta()]
    if table == "norms":
        return [f for f, _, _ in seg.norm_fields()]
    return list(seg.point_fields() if table == "points" else seg.term_fields)


def _point_columns(seg: Segment, number: int, values: tuple[int | None, int | None], dims: set | None) -> Iterator[tuple[int, dict]]:
    """Rows of the points of some leaves, and a function for each column."""
    size = seg.fields[number]["dimension_member_bytes"]
    box = None
    if size and size <= 8 and (dims is not None or values != (None, None)):
        half = 1 << (8 * size - 1)
        low, high = (min(max(v, -half), half - 1) for v in (values[0] if values[0] is not None else -half, values[1] if values[1] is not None else half - 1))
        own = (low + half).to_bytes(size, "big"), (high + half).to_bytes(size, "big")
        box = {d: own for d in range(seg.fields[number]["dimension_count"]) if dims is None or d in dims}
        if values[0] is not None and values[0] >= half or values[1] is not None and values[1] < -half:
            return  # beyond what so many bytes hold
    source = seg.points(number, box)
    while some := list(islice(source, LEAVES)):
        raw = np.concatenate([x for _, _, x in some])
        n, per, size = raw.shape
        flat, rows = raw.reshape(n * per, size), n * per
        wide = np.zeros((rows, 16), np.uint8)  # as 16 bytes, least significant first
        if size <= 8:
            wide[:, :size] = flat[:, ::-1]
        unsigned = np.ascontiguousarray(wide[:, :8]).view("<u8").ravel()
        there = size <= 8
        yield rows, {
            "field_number": lambda rows=rows: pa.array(np.full(rows, number)),
            "leaf": lambda some=some, per=per: pa.array(np.repeat([k for k, _, _ in some], [len(d) * per for _, d, _ in some])),
            "doc_id": lambda some=some, per=per: pa.array(np.repeat(np.concatenate([np.array(d, np.int64) for _, d, _ in some]), per)),
            "dim": lambda n=n, per=per: pa.array(np.tile(np.arange(per, dtype=np.int32), n)),
            "raw": lambda rows=rows, size=size, flat=flat: pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, rows * size + 1, size, dtype=np.int32) if size else np.zeros(rows + 1, np.int32)), pa.py_buffer(flat.tobytes())]),
            "unsigned": lambda rows=rows, wide=wide, there=there: pa.Array.from_buffers(pa.decimal128(20, 0), rows, [None, pa.py_buffer(wide.tobytes())]) if there else pa.nulls(rows, pa.decimal128(20, 0)),
            "value": lambda rows=rows, unsigned=unsigned, size=size, there=there: pa.array((unsigned - np.uint64(1 << (8 * size - 1))).view(np.int64)) if there else pa.nulls(rows, pa.int64()),
        }


def _dv_columns(seg: Segment, number: int, low: int, high: int | None) -> Iterator[tuple[int, dict]]:
    """Rows of the columnar values of a field, and a function for each column."""
    for doc, ord_, values, words in seg.dv_arrays(seg.fields[number]["field_name"], low, high):
        for at in range(0, len(doc), ROWS * 4):
            part = slice(at, at + ROWS * 4)
            n = len(doc[part])
            yield n, {
                "doc_id": lambda part=part: pa.array(doc[part]),
                "ord": lambda part=part: pa.array(ord_[part].astype(np.int32)),
                "long_value": lambda n=n, part=part: pa.nulls(n, pa.int64()) if values is None else pa.array(values[part]),
                "bin_value": lambda n=n, part=part: pa.nulls(n, pa.binary()) if words is None else pa.array([words[k] for k in (range(len(doc))[part] if values is None else values[part].tolist())], pa.binary()),
            }


def _dv_meta_rows(seg: Segment) -> Iterator[dict]:
    for m in seg.dv_meta():
        base = {"field_name": m["info"]["field_name"], "field_type": S._DV[m["type"]]}
        for role in ("numeric", "binary", "ord", "ord_index", "ss"):
            if role in m:
                names = ("FIXED", "VARIABLE", "PREFIX") if role == "binary" else ("ADDRESSES", "SINGLE", "SETS") if role == "ss" else S._NUMBER_FORMATS
                yield base | {k: v for k, v in m[role].items() if k in _ENTRY} | {"role": role, "format": names[m[role]["format"]]}


def _chunk_rows(seg: Segment) -> Iterator[dict]:
    c = None
    for row in seg.chunks():
        if c is None:
            c = seg.open(".fdt")
            S.header(c)
            c.vint()
        c.at = row["start_pointer"]
        c.vint()
        n = c.vint() >> 1
        sizes = [c.vint(), c.vint()][1:] if n == 1 else (seg._spread(c, n), seg._spread(c, n))[1]
        yield row | {"chunk_docs": n, "raw_length": int(np.sum(sizes))}


def _rows(seg: Segment, table: str, part: Part, reader: "SegmentReader") -> Iterator[dict]:
    f = part.number
    if table == "segment_info":
        yield seg.info
    elif table == "compound_entries":
        yield from ({"file_name": n, "offset": at, "length": size} for n, (at, size) in seg.entries.items())
    elif table == "file_headers":
        for name, c in seg.all_files():
            yield {"file": name} | S.header(c) | S.footer(c)
    elif table == "fields":
        yield from seg.fields.values()
    elif table == "stored_chunks":
        yield from _chunk_rows(seg)
    elif table == "stored":
        yield from seg.stored(list(part.starts))
    elif table == "dv_meta":
        yield from _dv_meta_rows(seg)
    elif table == "stored_info":
        if (info := seg.stored_info()) is not None:
            yield info
    elif table == "norms":
        base = {"field_number": f, "field_name": seg.fields[f]["field_name"]}
        yield from (base | {"doc_id": i, "norm": v} for i, v in enumerate(seg.norms(f, part.low, part.high).tolist(), part.low))
    elif table == "points_index":
        yield from ({"field_number": n, "field_name": seg.fields[n]["field_name"], "fp": p} for n, p in seg.point_fields().items())
    elif table == "points_tree":
        for n in seg.point_fields():
            yield {"field_number": n, "field_name": seg.fields[n]["field_name"]} | seg.tree(n, seg.open(".dim"))
    elif table == "term_fields":
        yield from seg.term_fields.values()
    elif table == "term_index":
        yield from map(seg.automaton, seg.term_fields)
    elif table == "terms":
        within = reader.terms()
        if within is not None and "term_ord" in reader.columns:  # what is skipped can't be counted: only the end may be
            ends = [high for _, high in within]
            within = None if None in ends else [(b"", max(ends, default=b""))]
        yield from seg.terms(f, within)


class SegmentReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.system, self.root = S.open_path(options["path"])
        self.path, self.table = options["path"], options.get("table", "postings")
        self.generation = options.get("generation")
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.columns, self.arrow = schema.fieldNames(), to_arrow_schema(schema)
        self.only: dict[str, set] = {}
        self.low: dict = {}
        self.high: dict = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with names of segments and fields picks what is opened. Filters on terms, documents and values of
        points pick blocks, chunks and leaves, which hold other rows as well; so Spark applies these again."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if isinstance(f, (EqualTo, In)) and name in ("segment", "field_name", "term", "doc_id", "value", "dim"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                values = {bytes(v) for v in values} if name == "term" else values
                self.only[name] = self.only.get(name, values) & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name in ("term", "doc_id", "value"):
                value = bytes(f.value) if name == "term" else f.value
                self.low[name] = max(self.low.get(name, value), value)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name in ("term", "doc_id", "value"):
                value = bytes(f.value) if name == "term" else f.value
                self.high[name] = min(self.high.get(name, value), value)
            if name not in ("segment", "field_name") or not isinstance(f, (EqualTo, In)):
                yield f

    def between(self, name: str) -> tuple:
        """The least and the greatest value that the filters allow; None where there is no bound."""
        own = self.only.get(name)
        if own is not None and not own:
            own = None  # nothing passes; Spark's filters see to that
        low, high = self.low.get(name), self.high.get(name)
        if own:
            low, high = (x for x in (min(own) if low is None else max(low, min(own)), max(own) if high is None else min(high, max(own))))
        return low, high

    def terms(self) -> list[tuple[bytes, bytes | None]] | None:
        """Closed intervals that hold the terms that the filters allow; None for all."""
        low, high = self.low.get("term"), self.high.get("term")
        if "term" in self.only:
            return sorted((t, t) for t in self.only["term"] if (low is None or t >= low) and (high is None or t <= high))
        return None if low is None and high is None else [(low or b"", high)]

    def wanted(self, column: str, value: str) -> bool:
        return column not in self.only or value in self.only[column]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"system": None}

    def _commit(self) -> dict:
        return S.commit(self.system, self.root, self.generation or S.latest(self.system, self.root))

    def partitions(self) -> list[Part]:
        """A task for each segment and field, for DOCS documents of a field whose values can be read from any place, or
        for GROUP chunks of stored documents; nothing for documents that the filters rule out."""
        if self.table in ("commit", "segments"):
            return [Part("")]
        parts = []
        for s in self._commit()["segments"]:
            if not self.wanted("segment", s["seg_name"]):
                continue
            try:
                seg = Segment(self.system, self.root, s["seg_name"])
                if self.table in _BY_FIELD:
                    split = {m["info"]["field_number"] for m in seg.dv_meta() if S.ranged(m)} if self.table == "dv_values" else set()
                    for f in _own_fields(seg, self.table):
                        if self.wanted("field_name", seg.fields[f]["field_name"]):
                            parts += self._ranges(seg, f) if self.table == "norms" or f in split else [Part(seg.name, f)]
                elif self.table == "stored":
                    bases = [c["doc_base"] for c in seg.chunks()] + [seg.size]
                    low, high = self.between("doc_id")
                    starts = [c["start_pointer"] for c, end in zip(seg.chunks(), bases[1:]) if (high is None or c["doc_base"] <= high) and (low is None or end > low)]
                    parts += [Part(seg.name, None, tuple(starts[i : i + GROUP])) for i in range(0, len(starts), GROUP)]
                else:
                    parts.append(Part(seg.name))
            except (S.Corrupt, OSError):
                if not self.permissive:
                    raise
                parts.append(Part(s["seg_name"]))  # the task meets the damage again and gives its row
        return parts or [Part("", -1)]

    def _ranges(self, seg: Segment, field: int) -> list[Part]:
        low, high = self.between("doc_id")
        low, high = max(0, low or 0), seg.size if high is None else min(seg.size, high + 1)
        low -= low % 8
        return [Part(seg.name, field, (), at, min(at + DOCS, high)) for at in range(low, high, DOCS)]

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t.type) for c, t in zip(self.columns, self.arrow)], schema=self.arrow)

    def _postings(self, seg: Segment, number: int) -> Iterator[pa.RecordBatch]:
        """Whole arrays for many terms at once."""
        name = seg.fields[number]["field_name"]
        source = seg.postings(number, self.terms())
        while True:
            kept, n = [], 0
            while n < ROWS * 4 and (one := next(source, None)) is not None:
                kept.append(one)
                n += len(one[1])
            if not kept:
                return
            sizes = np.array([len(k[1]) for k in kept])
            place = pa.array(np.repeat(np.arange(len(kept)), sizes))
            docs = np.concatenate([k[1] for k in kept])
            freq = pa.nulls(n, pa.int64()) if kept[0][2] is None else pa.array(np.concatenate([k[2] for k in kept]))
            found = {"segment": lambda: pa.array([seg.name] * n), "field_name": lambda: pa.array([name] * n), "term": lambda: pa.array([k[0] for k in kept], pa.binary()).take(place), "doc_id": lambda: pa.array(docs), "freq": lambda: freq, "_corrupt": lambda: pa.nulls(n, pa.string())}
            yield pa.RecordBatch.from_arrays([found[c]() for c in self.columns], schema=self.arrow)

    def _columns(self, seg: Segment, number: int, source: Iterator[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
        """Batches of the columns that are asked for; names are the same in all rows."""
        same = {"segment": seg.name, "field_name": seg.fields[number]["field_name"]}
        for n, found in source:
            made = [pa.repeat(same[c], n) if c in same else found[c]() if c in found else pa.nulls(n, t.type) for c, t in zip(self.columns, self.arrow)]
            yield pa.RecordBatch.from_arrays(made, schema=self.arrow)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        self.system, self.root = S.open_path(self.path)
        if part.number == -1:
            return
        try:
            if self.table in ("commit", "segments"):
                c = self._commit()
                yield self._batch([c] if self.table == "commit" else c["segments"])
                return
            seg = Segment(self.system, self.root, part.segment)
            if self.table in _BY_FIELD and part.number is None:
                _own_fields(seg, self.table)
            if self.table == "postings":
                yield from self._postings(seg, part.number)
                return
            if self.table in ("points", "dv_values"):
                source = _point_columns(seg, part.number, self.between("value"), self.only.get("dim")) if self.table == "points" else _dv_columns(seg, part.number, part.low, part.high)
                yield from self._columns(seg, part.number, source)
                return
            rows = (r for r in _rows(seg, self.table, part, self) if "field_name" not in r or self.wanted("field_name", r["field_name"]))
            while some := [{"segment": seg.name} | r for r in islice(rows, ROWS)]:
                yield self._batch(some)
        except (S.Corrupt, OSError, UnicodeDecodeError) as e:
            if not self.permissive:
                raise
            yield self._batch([{"segment": part.segment, "_corrupt": str(e)}])


class SegmentSource(DataSource):
    """Options: ``path`` (a folder), ``table`` (a key of SCHEMAS), ``generation`` (of the commit point; the newest
    without it), ``mode`` (failfast; permissive: a part that can't be read gives a row with its error in an
    extra column ``_corrupt`` after the rows before the damage). With ``spark.sql.python.filterPushdown.enabled``
    filters on ``segment`` and ``field_name`` and, of stored documents, norms and numbers, on ``doc_id`` reach the
    planning; those on ``term`` the blocks of terms and their postings, and those on ``value`` and ``dim`` the
    leaves of points. Deleted documents are included."""

    @classmethod
    def name(cls) -> str:
        return "segidx"

    def schema(self) -> str:
        table = self.options.get("table", "postings")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table!r}; there are {', '.join(SCHEMAS)}")
        return SCHEMAS[table] + (", _corrupt string" if self.options.get("mode", "").lower() == "permissive" else "")

    def reader(self, schema: T.StructType) -> SegmentReader:
        return SegmentReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    spark.dataSource.register(SegmentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, table: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A relation of the index in the folder ``path``, or some columns of it. Of ``terms`` without ``term_ord`` a
    filter on the term skips what it rules out; with it, terms must be counted from the first."""
    register(spark)
    source = spark.read.format("segidx").options(table=table, **options)
    if columns is not None:
        whole = T.StructType.fromDDL(SCHEMAS[table])
        source = source.schema(T.StructType([whole[c] for c in columns]))
    return source.load(path)


def boolean(spark: SparkSession, path: str, field: str, every: list[str] = (), some: list[str] = (), none: list[str] = ()) -> DataFrame:
    """``(segment, doc_id)`` of the documents with every term of ``every``, one of ``some`` and none of ``none`` in
    ``field``. The terms are sought in the index, and no other postings are read. A search for nothing but
    ``none``, or for no terms, finds nothing, as no posting names those documents."""
    wanted = [t.encode() for t in (*every, *some, *none)]
    post = read(spark, path, "postings").where((F.col("field_name") == field) & F.col("term").isin([bytearray(t) for t in wanted]))
    has = lambda t: F.max((F.col("term") == F.lit(bytearray(t.encode()))).cast("int")) == 1
    test = F.lit(bool(every or some))
    for t in every:
        test = test & has(t)
    for t in none:
        test = test & ~has(t)
    if some:
        test = test & (F.max(F.col("term").isin([bytearray(t.encode()) for t in some]).cast("int")) == 1)
    return post.groupBy("segment", "doc_id").agg(test.alias("ok")).where("ok").select("segment", "doc_id")


def dump(spark: SparkSession, path: str, *tables: str) -> DataFrame:
    """``(relation, json)``: rows of the named relations, or of all that describe the index and hold no documents."""
    names = tables or ("commit", "segments", "segment_info", "compound_entries", "file_headers", "fields", "stored_info", "dv_meta", "points_index", "points_tree", "term_fields", "term_index")
    parts = [read(spark, path, t).select(F.lit(t).alias("relation"), F.to_json(F.struct("*")).alias("json")) for t in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
