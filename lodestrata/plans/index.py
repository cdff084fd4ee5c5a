"""Queries over relations of an index that was written from the tables: what the files hold is what was indexed."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.shared import delete, shared_dir
from ..operators import fields as catalog_fields
from ..sources import segidx
from ..sources.segwrite import Field, write_index
from .catalog import _query, _t

_DOCUMENTS = [
    Field("doc_id", stored="long", dv="numeric"),
    Field("text", options=2, norms=True, stored="string"),
    Field("lang", options=1, stored="string", dv="sorted"),
    Field("source", stored="string", dv="sorted_set"),
    Field("n_chars", stored="long", dv="sorted_numeric", points=8),
]
_LINES = [
    Field("l_orderkey", dv="numeric"),
    Field("l_linenumber", dv="numeric"),
    Field("l_quantity", stored="double"),
    Field("part", dv="numeric"),
    Field("box", points=4, dims=2),
]
_LABELS = [  # columns with nulls, of every kind
    Field("doc_id", dv="numeric"),
    Field("quality", stored="int", dv="numeric"),
    Field("big", stored="long", dv="numeric", points=8),
    Field("ratio", stored="double"),
    Field("origin", options=2, norms=True, stored="string"),
    Field("tongue", stored="binary", dv="sorted"),
]
_WORDS = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS freq FROM w GROUP BY ALL)"
_SEGMENTS = 4  #: at least, and one for each core; a table of more partitions gives segments of each of them, without a shuffle
_written: dict[tuple[str, str, str], str] = {}


def _index(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where the index of a table lies; it is written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{shared_dir(spark)}/lodestrata-index-{uuid.uuid4().hex}"
        df = _t(spark, sf_dir, name)
        if name == "documents":
            df = df.select("doc_id", "text", "lang", F.encode("source", "UTF-8").alias("source"), "n_chars").withColumn("lang_", F.encode("lang", "UTF-8"))
            fields = [f if f.name != "lang" else Field("lang", options=1, stored="string") for f in _DOCUMENTS]
            fields = [*fields[:3], Field("lang_", dv="sorted"), Field("source", stored="binary", dv="sorted_set"), fields[4]]
        elif name == "labels":
            fields = _LABELS
            df = _t(spark, sf_dir, "documents").join(df, "doc_id", "left").select("doc_id", "quality", F.when(F.col("doc_id") % 3 != 1, F.col("doc_id") + (1 << 53)).alias("big"), F.when(F.col("toxic") == 0, F.col("n_chars") / 7).alias("ratio"), F.when(F.col("quality") == 1, F.col("source")).alias("origin"), F.encode(F.when(F.col("toxic") == 0, F.col("lang")), "UTF-8").alias("tongue"))
        else:
            fields = _LINES
            df = df.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity", F.col("l_partkey").alias("part"), F.array(F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")).alias("box"))
        least = max(_SEGMENTS, spark.sparkContext.defaultParallelism)
        write_index(df.repartition(least) if df.rdd.getNumPartitions() < least else df, path, fields, compound=name == "documents")
        atexit.register(delete, spark, path)
        _written[key] = path
    return _written[key]


def _read(spark: SparkSession, sf_dir: str, table: str, name: str = "documents", columns: list[str] | None = None) -> DataFrame:
    return segidx.read(spark, _index(spark, sf_dir, name), table, columns)


def _named(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` with the id of the table in place of the number within a segment."""
    ids = _read(spark, sf_dir, "dv_values").where("field_name = 'doc_id'").select("segment", F.col("doc_id").alias("_n"), F.col("long_value").alias("_id"))
    return rows.withColumnRenamed("doc_id", "_n").join(ids, ["segment", "_n"]).withColumnRenamed("_id", "doc_id")


@_query(f"WITH {_WORDS} SELECT term, count(*) AS doc_freq, CAST(sum(freq) AS BIGINT) AS total_term_freq FROM p GROUP BY ALL")
def index_terms(spark, sf_dir):
    t = _read(spark, sf_dir, "terms").where("field_name = 'text'")
    return t.groupBy(F.decode("term", "UTF-8").alias("term")).agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_term_freq").alias("total_term_freq"))


@_query(f"WITH {_WORDS} SELECT term, doc_id, freq FROM p")
def index_postings(spark, sf_dir):
    p = _named(_read(spark, sf_dir, "postings").where("field_name = 'text'"), spark, sf_dir)
    return p.select(F.decode("term", "UTF-8").alias("term"), "doc_id", "freq")


@_query(f"""WITH {_WORDS}, t AS (SELECT 'text' AS field_name, term, doc_id, freq FROM p UNION ALL SELECT 'lang', lang, doc_id, 1 FROM documents)
SELECT field_name, min(term) AS min_term, max(term) AS max_term, count(*) AS sum_doc_freq, count(DISTINCT doc_id) AS doc_count, CASE WHEN field_name = 'lang' THEN -1 ELSE CAST(sum(freq) AS BIGINT) END AS sum_total_term_freq FROM t GROUP BY field_name""")
def index_term_fields(spark, sf_dir):
    t = _read(spark, sf_dir, "term_fields").groupBy("field_name")
    total = F.when(F.min("sum_total_term_freq") < 0, F.lit(-1)).otherwise(F.sum("sum_total_term_freq")).cast("long")
    return t.agg(F.decode(F.min("min_term"), "UTF-8").alias("min_term"), F.decode(F.max("max_term"), "UTF-8").alias("max_term"), F.sum("sum_doc_freq").alias("sum_doc_freq"), F.sum("doc_count").alias("doc_count"), total.alias("sum_total_term_freq"))


@_query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS norm FROM documents")
def index_norms(spark, sf_dir):
    return _named(_read(spark, sf_dir, "norms"), spark, sf_dir).select("doc_id", "norm")


@_query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def index_stored(spark, sf_dir):
    """Stored documents, one column a field: the last value of each."""
    s = _read(spark, sf_dir, "stored").groupBy("segment", F.col("doc_id").alias("_n"))
    one = lambda name, c: F.max_by(F.when(F.col("field_name") == name, F.col(c)), F.when(F.col("field_name") == name, F.col("ord"))).alias(name)
    return s.agg(one("doc_id", "long"), one("text", "str"), one("lang", "str"), F.decode(one("source", "bin"), "UTF-8").alias("source"), one("n_chars", "long")).drop("segment", "_n")


@_query("SELECT doc_id, lang, source, n_chars FROM documents")
def index_doc_values(spark, sf_dir):
    v = _named(_read(spark, sf_dir, "dv_values"), spark, sf_dir).groupBy("doc_id")
    one = lambda name, c: F.max(F.when(F.col("field_name") == name, F.col(c)))
    return v.agg(F.decode(one("lang_", "bin_value"), "UTF-8").alias("lang"), F.decode(one("source", "bin_value"), "UTF-8").alias("source"), one("n_chars", "long_value").alias("n_chars"))


@_query("SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 2000")
def index_points(spark, sf_dir):
    p = _named(_read(spark, sf_dir, "points").where("field_name = 'n_chars'").where(F.col("value").between(500, 2000)), spark, sf_dir)
    return p.select("doc_id", F.col("value").alias("n_chars"))


@_query("SELECT CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_discount * 100) AS BIGINT) AS discount, count(*) AS n FROM lineitem GROUP BY ALL")
def index_points_2d(spark, sf_dir):
    """A tree of two dimensions and several leaves, counted by point."""
    p = _read(spark, sf_dir, "points", "lineitem", ["segment", "doc_id", "dim", "value"]).groupBy("segment", "doc_id").agg(F.max(F.when(F.col("dim") == 0, F.col("value"))).alias("quantity"), F.max(F.when(F.col("dim") == 1, F.col("value"))).alias("discount"))
    return p.groupBy("quantity", "discount").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT count(*) AS points, count(*) AS docs, min(CAST(l_quantity AS BIGINT)) AS low, max(CAST(l_quantity AS BIGINT)) AS high FROM lineitem")
def index_points_tree(spark, sf_dir):
    low, high = (codec.unsigned_column(F.col(c), 1, 4) - (1 << 31) for c in ("min_packed", "max_packed"))
    return _read(spark, sf_dir, "points_tree", "lineitem").agg(F.sum("point_count").alias("points"), F.sum("doc_count").alias("docs"), F.min(low).alias("low"), F.max(high).alias("high"))


@_query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey AS part FROM lineitem")
def index_numbers(spark, sf_dir):
    v = _read(spark, sf_dir, "dv_values", "lineitem", ["segment", "field_name", "doc_id", "long_value"]).groupBy("segment", "doc_id")
    return v.agg(*(F.max(F.when(F.col("field_name") == n, F.col("long_value"))).alias(n) for n in ("l_orderkey", "l_linenumber", "part"))).drop("segment", "doc_id")


@_query("SELECT count(*) AS docs, true AS sums_match, true AS chunks_match, true AS commit_matches FROM documents")
def index_integrity(spark, sf_dir):
    """Sizes of segments, checksums of all files, chunks against segments, and the commit point against both."""
    info, commit = _read(spark, sf_dir, "segment_info"), _read(spark, sf_dir, "commit")
    sums = _read(spark, sf_dir, "file_headers").agg(F.bool_and("ok").alias("sums_match"))
    docs = info.agg(F.sum("segment_size").alias("docs"), F.count(F.lit(1)).alias("n"))
    chunks = _read(spark, sf_dir, "stored_chunks").agg(F.sum("chunk_docs").alias("in_chunks"))
    segs = _read(spark, sf_dir, "segments").agg(F.count(F.lit(1)).alias("m"))
    one = docs.crossJoin(sums).crossJoin(chunks).crossJoin(segs).crossJoin(commit.select("segment_count"))  # a row each
    return one.select("docs", "sums_match", (F.col("docs") == F.col("in_chunks")).alias("chunks_match"), ((F.col("n") == F.col("m")) & (F.col("n") == F.col("segment_count"))).alias("commit_matches"))


@_query("""SELECT * FROM (VALUES ('doc_id', 0, 1, 0, true), ('text', 2, 0, 0, false), ('lang', 1, 0, 0, true), ('lang_', 0, 3, 0, true), ('source', 0, 4, 0, true), ('n_chars', 0, 5, 1, true)) f(field_name, index_option_bits, doc_values_bits, dimension_count, omit_norm)""")
def index_fields(spark, sf_dir):
    return _read(spark, sf_dir, "fields").select("field_name", "index_option_bits", "doc_values_bits", "dimension_count", "omit_norm").distinct()


@_query("SELECT * FROM (VALUES ('doc_id', 'numeric', 'numeric'), ('lang_', 'sorted', 'binary'), ('lang_', 'sorted', 'ord'), ('source', 'sorted_set', 'ss'), ('source', 'sorted_set', 'binary'), ('source', 'sorted_set', 'ord'), ('n_chars', 'sorted_numeric', 'ss'), ('n_chars', 'sorted_numeric', 'numeric')) f(field_name, field_type, role)")
def index_dv_meta(spark, sf_dir):
    return _read(spark, sf_dir, "dv_meta").select("field_name", "field_type", "role").distinct()


@_query("SELECT 'n_chars' AS field_name, true AS compound, true AS terms_indexed")
def index_structure(spark, sf_dir):
    """Fields with points, whether segments are compound with all their entries, and heads of the prefix indexes."""
    points = _read(spark, sf_dir, "points_index").select("field_name").distinct()
    entries = _read(spark, sf_dir, "compound_entries").groupBy("segment").agg(F.min(F.col("length") > 0).alias("full"), F.count(F.lit(1)).alias("n"))
    compound = entries.agg(F.bool_and(F.col("full") & (F.col("n") >= 10)).alias("compound"))
    heads = _read(spark, sf_dir, "term_index").agg((F.bool_and(F.col("empty_output").isNotNull()) & (F.count_distinct("field_name") == 2)).alias("terms_indexed"))
    return points.crossJoin(compound).crossJoin(heads)  # a row each


@_query(f"WITH {_WORDS} SELECT doc_id, freq FROM p WHERE term = 'the'")
def index_term_seek(spark, sf_dir):
    """The documents of one term: only its blocks of terms and its postings are read."""
    p = _read(spark, sf_dir, "postings").where((F.col("field_name") == "text") & (F.col("term") == F.lit(bytearray(b"the"))))
    return _named(p, spark, sf_dir).select("doc_id", "freq")


@_query(f"""WITH {_WORDS} (SELECT doc_id FROM p WHERE term = 'the' INTERSECT SELECT doc_id FROM p WHERE term IN ('that', 'ed')) EXCEPT SELECT doc_id FROM p WHERE term = 'an'""")
def index_boolean(spark, sf_dir):
    return _named(segidx.boolean(spark, _index(spark, sf_dir, "documents"), "text", every=["the"], some=["that", "ed"], none=["an"]), spark, sf_dir).select("doc_id")


def _found_terms(spark, sf_dir, low: bytes, high: bytes, strict: bool):
    term = F.col("term")
    t = segidx.read(spark, _index(spark, sf_dir, "documents"), "terms", ["segment", "field_name", "term", "doc_freq", "total_term_freq"])
    t = t.where((F.col("field_name") == "text") & (term >= F.lit(bytearray(low))) & ((term < F.lit(bytearray(high))) if strict else (term <= F.lit(bytearray(high)))))
    return t.groupBy(F.decode("term", "UTF-8").alias("term")).agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_term_freq").alias("total_term_freq"))


@_query(f"WITH {_WORDS} SELECT term, count(*) AS doc_freq, CAST(sum(freq) AS BIGINT) AS total_term_freq FROM p WHERE starts_with(term, 'th') GROUP BY ALL")
def index_prefix(spark, sf_dir):
    return _found_terms(spark, sf_dir, b"th", b"ti", True)


@_query(f"WITH {_WORDS} SELECT term, count(*) AS doc_freq, CAST(sum(freq) AS BIGINT) AS total_term_freq FROM p WHERE term BETWEEN 'an' AND 'ed' GROUP BY ALL")
def index_range(spark, sf_dir):
    return _found_terms(spark, sf_dir, b"an", b"ed", False)


@_query("SELECT CAST(l_quantity AS BIGINT) AS quantity, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 GROUP BY ALL")
def index_points_range(spark, sf_dir):
    """Points with a first dimension from 10 to 12: leaves that have none aren't read."""
    p = _read(spark, sf_dir, "points", "lineitem", ["field_name", "dim", "value"]).where("field_name = 'box' AND dim = 0 AND value >= 10 AND value <= 12")
    return p.groupBy(F.col("value").alias("quantity")).agg(F.count(F.lit(1)).alias("n"))


@_query("""SELECT d.doc_id, quality::BIGINT AS quality, CASE WHEN d.doc_id % 3 <> 1 THEN d.doc_id + 9007199254740992 END AS big, CASE WHEN d.doc_id % 3 <> 1 THEN d.doc_id + 9007199254740992 END AS big_stored,
CASE WHEN toxic = 0 THEN n_chars / 7 END AS ratio, CASE WHEN quality = 1 THEN source END AS origin, CASE WHEN toxic = 0 THEN lang END AS tongue FROM documents d LEFT JOIN labels l USING (doc_id)""")
def index_nullable(spark, sf_dir):
    """Columns with nulls, written and read again as columnar values and as stored ones."""
    v = _read(spark, sf_dir, "dv_values", "labels").groupBy("segment", "doc_id")
    one = lambda name, c: F.max(F.when(F.col("field_name") == name, F.col(c)))
    v = v.agg(one("doc_id", "long_value").alias("id"), one("quality", "long_value").alias("quality"), one("big", "long_value").alias("big"), F.decode(one("tongue", "bin_value"), "UTF-8").alias("tongue"))
    s = _read(spark, sf_dir, "stored", "labels").groupBy("segment", "doc_id").agg(one("big", "long").alias("big_stored"), one("ratio", "double").alias("ratio"), one("origin", "str").alias("origin"))
    return v.join(s, ["segment", "doc_id"], "left").select(F.col("id").alias("doc_id"), "quality", "big", "big_stored", "ratio", "origin", "tongue")


@_query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS norm, 'text' AS field_name FROM documents")
def index_norms_checked(spark, sf_dir):
    """Norms with the names of their fields; one of a field that can't have any would be an error."""
    fields = _read(spark, sf_dir, "fields").select("field_number", "field_name", "field_bits", "index_option_bits").distinct()
    n = catalog_fields.check_norms(_read(spark, sf_dir, "norms").drop("field_name"), fields)
    return _named(n, spark, sf_dir).select("doc_id", "norm", "field_name")


@_query("SELECT true AS tails_ok, true AS counts_match, true AS sizes_match, count(*) > 0 AS some FROM documents")
def index_stored_info(spark, sf_dir):
    """What follows the chunks of stored documents: their number, and that of those which weren't full."""
    info = _read(spark, sf_dir, "stored_info").agg(F.bool_and("tail_ok").alias("tails_ok"), F.sum("num_chunks").alias("n"), F.sum("num_dirty_chunks").alias("dirty"))
    chunks = _read(spark, sf_dir, "stored_chunks").agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("raw_length") < 16_384).cast("long")).alias("few"))
    return info.crossJoin(chunks).select("tails_ok", (F.col("n") == F.col("m")).alias("counts_match"), (F.col("dirty") == F.col("few")).alias("sizes_match"), (F.col("n") > 0).alias("some"))  # a row each


@_query("SELECT '6.6.0' AS index_version, '6.6.0' AS min_segment_version, '6.6.0' AS version, count(*) AS docs FROM documents")
def index_versions(spark, sf_dir):
    """Versions in the commit point and in the segments, and the documents they count."""
    seg = _read(spark, sf_dir, "segment_info").groupBy("version").agg(F.sum("segment_size").alias("docs"))
    return _read(spark, sf_dir, "commit").select("index_version", "min_segment_version").crossJoin(seg)  # a row each


@_query("SELECT count(*) AS docs, 6 AS fields, true AS sums_match FROM documents")
def index_dump(spark, sf_dir):
    """The structures of an index as JSON, and what can be read from it again."""
    d = segidx.dump(spark, _index(spark, sf_dir, "documents"), "segment_info", "fields", "file_headers")
    get = lambda name, path, kind: F.when(F.col("relation") == name, F.get_json_object("json", path).cast(kind))
    return d.agg(F.sum(get("segment_info", "$.segment_size", "long")).alias("docs"), F.count_distinct(get("fields", "$.field_name", "string")).cast("int").alias("fields"), F.bool_and(get("file_headers", "$.ok", "boolean")).alias("sums_match"))
