"""All queries outside the subpackage llm, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import columns, inverted, points, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TOKENS = "tok AS (SELECT lang AS field_name, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)"
_POST = _TOKENS + ", post AS (SELECT field_name, term, doc_id, count(*) AS freq FROM tok GROUP BY ALL)"
_TERMS = _POST + ", terms AS (SELECT field_name, term, count(*) AS doc_freq, CAST(sum(freq) AS BIGINT) AS total_term_freq FROM post GROUP BY ALL)"


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.tokens(_t(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), F.col("text"))


def _inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted.invert(_t(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), F.col("text"))


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@_query(f"""WITH {_TERMS} SELECT t.field_name, count(*) AS num_terms, CAST(sum(doc_freq) AS BIGINT) AS sum_doc_freq,
CAST(sum(total_term_freq) AS BIGINT) AS sum_total_term_freq, min(term) AS min_term, max(term) AS max_term,
(SELECT count(DISTINCT doc_id) FROM post p WHERE p.field_name = t.field_name) AS doc_count FROM terms t GROUP BY t.field_name""")
def term_dict_stats(spark, sf_dir):
    return inverted.term_fields(_t(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), F.col("text"))


@_query(f"""WITH {_POST}, d AS (SELECT field_name, term, doc_id, doc_id - coalesce(lag(doc_id) OVER w, 0) AS delta, (row_number() OVER w - 1) // 128 AS block FROM post WINDOW w AS (PARTITION BY field_name, term ORDER BY doc_id))
SELECT field_name, term, block, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids, string_agg(delta, ',' ORDER BY doc_id) AS deltas FROM d GROUP BY ALL""")
def postings(spark, sf_dir):
    """Posting lists in blocks of 128 documents."""
    lists = inverted.posting_lists(_inverted(spark, sf_dir))
    return lists.select("field_name", "term", "block", _joined("doc_ids").alias("doc_ids"), _joined("deltas").alias("deltas"))


@_query(f"WITH {_POST} SELECT field_name, term, doc_id FROM post")
def postings_decoded(spark, sf_dir):
    """Lists of differences and back: the running sums are the ids again."""
    return inverted.from_deltas(inverted.posting_lists(_inverted(spark, sf_dir)))


@_query(f"""WITH {_POST}, d AS (SELECT field_name, term, doc_id - coalesce(lag(doc_id) OVER w, 0) AS delta, (row_number() OVER w - 1) // 128 AS block FROM post WINDOW w AS (PARTITION BY field_name, term ORDER BY doc_id)),
b AS (SELECT field_name, term, block, CASE WHEN delta = 0 THEN 0 ELSE length(bin(delta)) END AS width FROM d),
g AS (SELECT field_name, term, block, count(*) AS n, max(width) AS bits, CAST(sum(greatest(1, (width + 6) // 7)) AS BIGINT) AS vints FROM b GROUP BY ALL)
SELECT field_name, term, block, n, n = 128 AS "full", bits, CASE WHEN n = 128 THEN (n * bits + 7) // 8 + 1 ELSE vints END AS bytes FROM g""")
def posting_blocks(spark, sf_dir):
    return inverted.posting_blocks(_inverted(spark, sf_dir))


@_query(f"WITH {_TOKENS} SELECT field_name, doc_id, count(*) AS norm FROM tok GROUP BY ALL")
def norms(spark, sf_dir):
    return inverted.norms(_tokens(spark, sf_dir))


@_query(f"WITH {_TERMS} SELECT * FROM terms")
def term_freqs(spark, sf_dir):
    return inverted.term_freqs(_inverted(spark, sf_dir))


@_query(f"WITH {_TERMS} SELECT field_name, term, hex(term) AS term_bytes FROM terms")
def term_bytes(spark, sf_dir):
    return _tokens(spark, sf_dir).select("field_name", "term").distinct().withColumn("term_bytes", F.hex("term"))


_ORDS = _TERMS + ", ords AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY term) - 1 AS term_ord FROM terms)"


@_query(f"WITH {_ORDS} SELECT field_name, term, doc_freq, total_term_freq, term_ord FROM ords")
def term_ordinals(spark, sf_dir):
    return inverted.term_ordinals(inverted.term_freqs(_inverted(spark, sf_dir)))


@_query(f"""WITH {_ORDS}, l AS (SELECT field_name, term_ord, term, lag(term) OVER (PARTITION BY field_name ORDER BY term) AS last FROM ords)
SELECT field_name, term_ord, term, CAST(coalesce(list_max(list_filter(range(1, least(length(term), length(last)) + 1), lambda i: term[1:i] = last[1:i])), 0) AS BIGINT) AS prefix FROM l""")
def shared_prefix(spark, sf_dir):
    return inverted.shared_prefix(inverted.term_ordinals(inverted.term_freqs(_inverted(spark, sf_dir))))


@_query(f"WITH {_POST} SELECT doc_id FROM post WHERE term = 'the' INTERSECT SELECT doc_id FROM post WHERE term = 'that'")
def boolean_and(spark, sf_dir):
    return inverted.boolean(inverted.postings(_tokens(spark, sf_dir)), every=["the", "that"])


@_query(f"WITH {_POST} SELECT DISTINCT doc_id FROM post WHERE term IN ('the', 'that')")
def boolean_or(spark, sf_dir):
    return inverted.boolean(inverted.postings(_tokens(spark, sf_dir)), some=["the", "that"])


@_query(f"WITH {_POST} SELECT doc_id FROM post WHERE term = 'the' EXCEPT SELECT doc_id FROM post WHERE term = 'that'")
def boolean_not(spark, sf_dir):
    return inverted.boolean(inverted.postings(_tokens(spark, sf_dir)), every=["the"], none=["that"])


@_query(f"WITH {_TERMS} SELECT * FROM terms WHERE starts_with(term, 'th')")
def term_prefix(spark, sf_dir):
    return inverted.term_prefix(inverted.term_freqs(_inverted(spark, sf_dir)), "th")


@_query(f"WITH {_TERMS} SELECT * FROM terms WHERE term BETWEEN 'an' AND 'ed'")
def term_range(spark, sf_dir):
    return inverted.term_range(inverted.term_freqs(_inverted(spark, sf_dir)), "an", "ed")


@_query(f"WITH {_POST} SELECT field_name, count(DISTINCT doc_id) AS docs FROM post GROUP BY ALL")
def distinct_docs(spark, sf_dir):
    return _tokens(spark, sf_dir).select("field_name", "doc_id").distinct().groupBy("field_name").agg(F.count(F.lit(1)).alias("docs"))


@_query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS ord, o_orderpriority AS value FROM orders")
def sorted_ordinals(spark, sf_dir):
    return columns.sorted_ordinals(_t(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority")


_NUMERIC = {"quantity": "CAST(l_quantity AS BIGINT)", "partkey": "l_partkey", "price_cents": "CAST(round(l_extendedprice * 100) AS BIGINT)", "linenumber": "CAST(l_linenumber AS BIGINT)", "tens": "l_suppkey * 10", "one": "CAST(7 AS BIGINT)"}
_VALUES = "v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS field_name, {e} AS value FROM lineitem" for n, e in _NUMERIC.items()) + ")"


def _numeric(spark, sf_dir):
    return columns.long_form(_t(spark, sf_dir, "lineitem"), {n: F.expr(e) for n, e in _NUMERIC.items()})


@_query(f"""WITH {_VALUES}, d AS (SELECT field_name, count(*) AS count, min(value) AS min_value, max(value) AS max_value, count(DISTINCT value) AS "distinct" FROM v GROUP BY ALL),
u AS (SELECT DISTINCT field_name, value FROM v), g AS (SELECT u.field_name, list_reduce(list(value - min_value), lambda a, b: gcd(a, b)) AS gcd FROM u JOIN d USING (field_name) GROUP BY ALL),
s AS (SELECT *, max_value - min_value AS spread FROM d JOIN g USING (field_name)),
b AS (SELECT *, CASE WHEN spread <= 0 THEN 0 ELSE length(bin(spread)) END AS wide, CASE WHEN "distinct" <= 1 THEN 0 ELSE length(bin("distinct" - 1)) END AS small FROM s),
f AS (SELECT *, CASE WHEN "distinct" = 1 THEN 'CONST' WHEN "distinct" <= 255 AND small < wide THEN 'TABLE' WHEN gcd > 1 THEN 'GCD' ELSE 'DELTA' END AS format FROM b)
SELECT field_name, format, count, min_value, max_value, gcd, "distinct", CAST(CASE format WHEN 'CONST' THEN 0 WHEN 'TABLE' THEN small WHEN 'GCD' THEN length(bin(spread // gcd)) ELSE wide END AS BIGINT) AS bits FROM f""")
def dv_numeric_profile(spark, sf_dir):
    return columns.numeric_profile(_numeric(spark, sf_dir))


@_query(f"WITH {_VALUES} SELECT field_name, value, count(*) AS n FROM v GROUP BY ALL")
def dv_numeric_decode(spark, sf_dir):
    """Values packed in units of their divisor and decoded again."""
    values = _numeric(spark, sf_dir)
    p = columns.packed(values, columns.numeric_profile(values))
    return p.select("field_name", columns.unpacked(p).alias("value")).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))


@_query("""WITH v AS (SELECT 'source' AS field_name, strlen(source) AS size FROM documents UNION ALL SELECT 'lang', strlen(lang) FROM documents UNION ALL SELECT 'text', strlen(text) FROM documents)
SELECT field_name, count(size) AS count, min(size) AS min_length, max(size) AS max_length, CASE WHEN min(size) = max(size) THEN 'FIXED' ELSE 'VARIABLE' END AS format FROM v GROUP BY ALL""")
def dv_binary_profile(spark, sf_dir):
    return columns.binary_profile(_t(spark, sf_dir, "documents"), {"source": F.col("source"), "lang": F.col("lang"), "text": F.col("text")})


@_query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS vals FROM events GROUP BY ALL")
def dv_sorted_set(spark, sf_dir):
    return columns.sorted_set(_t(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.array_join("values", ",").alias("vals"))


@_query("SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS vals FROM orders GROUP BY ALL")
def dv_sorted_numeric(spark, sf_dir):
    return columns.sorted_numeric(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", _joined("values").alias("vals"))


@_query("SELECT d.doc_id, l.doc_id IS NOT NULL AS live FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality IS NOT NULL) l ON d.doc_id = l.doc_id")
def live_docs(spark, sf_dir):
    return columns.live_docs(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id", "quality")


@_query("""WITH s AS (SELECT count(l.doc_id) AS live, count(*) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT live, total, CASE WHEN live = total THEN 'ALL_LIVE' WHEN live = 0 THEN 'ALL_MISSING' ELSE 'MIXED' END AS kind, CASE WHEN live = total OR live = 0 THEN 0 ELSE (total + 7) // 8 END AS bytes FROM s""")
def live_summary(spark, sf_dir):
    return columns.live_summary(columns.live_docs(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id", "quality"))


@_query("""WITH r AS (SELECT l_quantity, l_orderkey, (row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) - 1) // 1024 AS leaf FROM lineitem)
SELECT leaf, count(*) AS n, min(l_quantity) AS min_value, max(l_quantity) AS max_value, count(DISTINCT l_orderkey) AS doc_count FROM r GROUP BY ALL""")
def points_leaves(spark, sf_dir):
    return points.leaves(_t(spark, sf_dir, "lineitem"), "l_quantity", ["l_orderkey", "l_linenumber"])


@_query("SELECT count(*) AS point_count, min(l_quantity) + 0.0 AS q_min, max(l_quantity) + 0.0 AS q_max, min(l_discount) + 0.0 AS d_min, max(l_discount) + 0.0 AS d_max FROM lineitem")
def points_bounds(spark, sf_dir):
    return points.bounds(_t(spark, sf_dir, "lineitem"), {"q": F.col("l_quantity"), "d": F.col("l_discount")})


@_query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05")
def points_range(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return points.within(rows, {"l_quantity": (10.0, 20.0), "l_discount": (0.02, 0.05)})


@_query("SELECT o_orderkey, lpad(hex(CAST(CAST(o_custkey - 500 AS HUGEINT) + 9223372036854775808 AS UBIGINT)), 16, '0') AS sortable FROM orders")
def points_doc_values(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", points.sortable_hex(F.col("o_custkey") - 500).alias("sortable"))


_FIELDS = {"source": (0, "source", "string"), "lang": (1, "lang", "string"), "n_chars": (2, "n_chars", "long")}


def _stored(spark, sf_dir):
    return stored.stored(_t(spark, sf_dir, "documents"), F.col("doc_id"), {n: (k, F.col(c), t) for n, (k, c, t) in _FIELDS.items()})


@_query(" UNION ALL ".join(f"SELECT doc_id, CAST({k} AS BIGINT) AS ord, CAST({k} AS BIGINT) AS field_number, '{n}' AS field_name, CAST({stored.TAGS[t]} AS BIGINT) AS type_tag, CAST({c} AS VARCHAR) AS value FROM documents" for n, (k, c, t) in _FIELDS.items()))
def stored_documents(spark, sf_dir):
    return _stored(spark, sf_dir)


@_query("SELECT conv_id, max_by(text, turn) AS text FROM conversations GROUP BY ALL")
def stored_last_value(spark, sf_dir):
    return stored.last_value(_t(spark, sf_dir, "conversations"), ["conv_id"], "text", "turn")


@_query("SELECT doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def stored_map_view(spark, sf_dir):
    m = stored.as_map(_stored(spark, sf_dir))
    return m.select("doc_id", *[F.col("doc")[n].alias(n) for n in _FIELDS])


_CHUNKS = """p AS (SELECT doc_id, strlen(text) AS size, row_number() OVER (ORDER BY doc_id) - 1 AS pos, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pointer FROM documents),
c AS (SELECT CAST(pointer // 16384 AS BIGINT) AS chunk_id, min(pos) AS doc_base, count(*) AS docs, CAST(sum(size) AS BIGINT) AS raw_length, CAST(min(pointer) AS BIGINT) AS start_pointer FROM p GROUP BY ALL)"""


@_query(f"WITH {_CHUNKS} SELECT * FROM c")
def stored_chunks(spark, sf_dir):
    return stored.chunks(_t(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"))


@_query(f"""WITH {_CHUNKS}, r AS (SELECT chunk_id, start_pointer, row_number() OVER (ORDER BY chunk_id) - 1 AS pos FROM c),
b AS (SELECT pos // 16 AS block_id, min(start_pointer) AS base, (max(start_pointer) - min(start_pointer)) // greatest(count(*) - 1, 1) AS average FROM r GROUP BY ALL),
d AS (SELECT chunk_id, block_id, base, average, start_pointer - base - average * (pos % 16) AS delta, start_pointer FROM r JOIN b ON r.pos // 16 = b.block_id)
SELECT chunk_id, block_id, base, average, delta, CASE WHEN delta >= 0 THEN 2 * delta ELSE -2 * delta - 1 END AS zigzag, start_pointer AS pointer FROM d""")
def chunk_pointers(spark, sf_dir):
    return stored.chunk_pointers(stored.chunks(_t(spark, sf_dir, "documents"), "doc_id", F.octet_length("text")))


_CATALOG = [(0, "body", 1, 4, False), (1, "title", 2, 3, True), (2, "tag", 4, 1, True), (3, "price", 2, 0, False), (4, "note", 7, 2, True)]


@_query("WITH f(field_number, field_name, bits, opts, points) AS (VALUES " + ", ".join(f"({n}, '{m}', {b}, {o}, {p})" for n, m, b, o, p in _CATALOG) + """)
SELECT CAST(field_number AS BIGINT) AS field_number, field_name, (bits & 1) <> 0 AS store_term_vec, (bits & 2) <> 0 AS omit_norm, (bits & 4) <> 0 AS store_payload,
opts >= 2 AS has_freqs, opts >= 3 AS has_prox, opts >= 4 AS has_offsets, opts > 0 AND (bits & 2) = 0 AS has_norms FROM f""")
def field_catalog(spark, sf_dir):
    from ..operators import fields

    rows = spark.createDataFrame([(n, m, b, o) for n, m, b, o, _ in _CATALOG], "field_number long, field_name string, field_bits int, index_option_bits int")
    return fields.flags(rows)


@_query("WITH f(field_name, bits, opts) AS (VALUES " + ", ".join(f"('{m}', {b}, {o})" for _, m, b, o, _ in _CATALOG) + ") SELECT bool_or(opts >= 3) AS has_prox, bool_or(opts >= 4) AS has_offsets, bool_or((bits & 4) <> 0) AS has_payloads FROM f")
def field_capabilities(spark, sf_dir):
    from ..operators import fields

    return fields.capabilities(field_catalog(spark, sf_dir))


@_query("""SELECT doc_id // 100 AS segment, count(*) AS segment_size, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS del_count, min(d.doc_id) AS doc_base FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def segment_catalog(spark, sf_dir):
    from ..operators import fields

    live = columns.live_docs(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), "doc_id", "quality")
    return fields.segments(live.withColumn("segment", F.expr("doc_id div 100")), "segment", "doc_id", "live")


@_query(f"WITH {_TOKENS}, n AS (SELECT doc_id, count(*) AS norm FROM tok GROUP BY ALL) SELECT d.doc_id, d.source, n.norm, l.quality FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN labels l USING (doc_id)")
def doc_lookup(spark, sf_dir):
    """Source, norm and label of every document, by its key; a filter on the result looks single ones up."""
    docs = _t(spark, sf_dir, "documents")
    length = inverted.norms(_tokens(spark, sf_dir)).select("doc_id", "norm")
    return docs.select("doc_id", "source").join(length, "doc_id", "left").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@_query("SELECT event_id, event_id - 5000 AS value, CASE WHEN event_id >= 5000 THEN 2 * (event_id - 5000) ELSE -2 * (event_id - 5000) - 1 END AS zigzag FROM events")
def zigzag(spark, sf_dir):
    z = _t(spark, sf_dir, "events").select("event_id", codec.zigzag_column(F.col("event_id") - 5000).alias("zigzag"))
    return z.select("event_id", codec.unzigzag_column(F.col("zigzag")).alias("value"), "zigzag")


_MS = "unix_micros(cast(ts as timestamp)) div 1000"


@_query("""WITH m AS (SELECT epoch_us(ts) // 1000 AS ms FROM events UNION ALL SELECT epoch_us(o_orderdate) // 1000 FROM orders)
SELECT CASE WHEN ms % 86400000 = 0 THEN 'day' WHEN ms % 3600000 = 0 THEN 'hour' WHEN ms % 1000 = 0 THEN 'second' ELSE 'ms' END AS unit, count(*) AS n FROM m GROUP BY ALL""")
def tlong_scale(spark, sf_dir):
    ms = _t(spark, sf_dir, "events").select(F.expr(_MS).alias("ms")).union(_t(spark, sf_dir, "orders").select(F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000")))
    return ms.groupBy(codec.time_unit_column(F.col("ms")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT event_id, CASE WHEN event_id % 7 <> 3 THEN epoch_us(ts) // 1000 END AS ms FROM events")
def codec_tlong(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", codec.from_tlong(codec.to_tlong(F.when(F.col("event_id") % 7 != 3, F.expr(_MS)))).alias("ms"))


_SOME = "o_orderkey % 7 <> 3"  #: the others are null in the queries of codecs


def _some(c):
    return F.when(F.expr(_SOME), c)


@_query(f"SELECT o_orderkey, CASE WHEN {_SOME} THEN o_custkey END AS value FROM orders")
def codec_vint(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", codec.from_varied(codec.to_varied(_some(F.col("o_custkey")))).alias("value"))


@_query(f"SELECT o_orderkey, CASE WHEN {_SOME} THEN o_orderkey * 1234567891 END AS value FROM orders")
def codec_vlong(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", codec.from_varied(codec.to_varied(_some(F.col("o_orderkey") * F.lit(1234567891)))).alias("value"))


@_query(f"SELECT o_orderkey, CASE WHEN {_SOME} THEN o_totalprice - 100000 END AS value FROM orders")
def codec_zdouble(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", codec.from_zdouble(codec.to_zdouble(_some(F.col("o_totalprice") - 100000))).alias("value"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 7 <> 3 THEN CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) END AS value FROM part")
def codec_zfloat(spark, sf_dir):
    some = F.when(F.col("p_partkey") % 7 != 3, F.col("p_retailprice").cast("float"))
    return _t(spark, sf_dir, "part").select("p_partkey", codec.from_zfloat(codec.to_zfloat(some)).cast("double").alias("value"))


@_query("SELECT o_custkey, CASE WHEN o_custkey % 7 <> 3 THEN string_agg(o_orderkey, ',' ORDER BY o_orderkey) END AS vals FROM orders GROUP BY o_custkey")
def codec_packed(spark, sf_dir):
    rows = columns.sorted_numeric(_t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").withColumn("values", F.when(F.col("o_custkey") % 7 != 3, F.col("values")))
    return rows.select("o_custkey", F.array_join(F.transform(codec.from_packed(37)(codec.to_packed(37)("values"), F.size("values")), lambda x: x.cast("string")), ",").alias("vals"))


@_query("SELECT conv_id, turn, CASE WHEN conv_id % 7 <> 3 THEN text END AS text FROM conversations")
def codec_lz4(spark, sf_dir):
    text = F.when(F.col("conv_id") % 7 != 3, F.col("text"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", codec.from_lz4(codec.to_lz4(text), F.octet_length(text)).alias("text"))


_CRC = "list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


@_query(f"""WITH t AS (SELECT {_CRC} AS t), b AS (SELECT doc_id, hex(encode(text))[: -17] AS h FROM documents),
l AS (SELECT doc_id, list_transform(range(1, len(h) + 1, 2), lambda i: ('0x' || h[i : i + 1])::BIGINT) AS b FROM b)
SELECT doc_id, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM l, t""")
def checksum(spark, sf_dir):
    """CRC-32 of every text but its last 8 bytes, as the files of an index hold it."""
    raw = F.encode("text", "UTF-8")
    return _t(spark, sf_dir, "documents").select("doc_id", F.crc32(F.substring(raw, F.lit(1), F.greatest(F.length(raw) - 8, F.lit(0)))).alias("crc"))


@_query("SELECT doc_id, regexp_replace(lower(hex(source)), '(..)', '\\1:', 'g')[:-2] AS source_hex FROM documents")
def colon_hex(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", codec.colon_hex_column(F.encode("source", "UTF-8")).alias("source_hex"))


from . import index  # noqa: E402, F401 - adds its queries
