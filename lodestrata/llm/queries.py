"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import egojoin, langid, neardup, packing, pieces, quality, secrets, topk, toxicity, warc
from ._shared import delete, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the one that its group of near copies keeps, and its number of near copies."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors, among all, of every embedding whose id is divisible by 20."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin, place and token ids of every piece of every document."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in every document."""
    return secrets.findings(_table(spark, sf_dir, "documents")).select("doc_id", "rule", "nth", "secret")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, margin and acceptance of every document."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.dictionaries(docs))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and acceptance of every document."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding with the id of the one that its group of near copies keeps, and its number of near copies."""
    return egojoin.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document and whether they decode to its text."""
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as compressed web archives in the shared folder, and the responses read from them."""
    path = f"{shared_dir(spark)}/lodestrata-warc-{uuid.uuid4().hex}"
    warc.register(spark)
    warc.from_pages(_table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    atexit.register(delete, spark, path)
    return warc.responses(spark, path)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of all categories for every document."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def _secrets_sql() -> str:
    """One scan of the texts for each rule, with RE2's matches of the same expressions."""
    parts = []
    for r in secrets.RULES:
        fold = "(?i)" if r.pattern.startswith("(?i)") else ""
        core = r.pattern.removeprefix("(?i)")
        tail = f"(?-i:{r.tail})" + ("" if r.needed else "?") if r.tail else ""
        apart = "".join("\\" * (c == 45) + chr(c) for c in sorted(r.apart))
        before = f"(?:^|[^{apart}])" if apart else ""
        pattern = f"{fold}{before}((?:{core}){tail})".replace("'", "''")
        parts.append(f"SELECT doc_id, '{r.name}' AS rule, regexp_extract_all(text, '{pattern}', 1) AS m FROM documents")
    return f"SELECT doc_id, rule, CAST(unnest(range(1, len(m) + 1)) AS INTEGER) AS nth, unnest(m) AS secret FROM ({' UNION ALL '.join(parts)}) WHERE len(m) > 0"


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"

_TOP_K_SQL = f"""
WITH s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, round({_COSINE}, 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0),
r AS (SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbor_id) AS INTEGER) AS rank, neighbor_id, c AS similarity FROM s)
SELECT * FROM r WHERE rank <= {topk.K}"""

_NEAR_VECTORS_SQL = f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {_COSINE} >= {egojoin.SIMILARITY}),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
g AS (SELECT n AS vec_id, min(m) AS group_id FROM r GROUP BY n),
l AS (SELECT e.a AS vec_id, count(DISTINCT y.embedding) AS links FROM e JOIN embeddings x ON x.vec_id = e.a JOIN embeddings y ON y.vec_id = e.b AND y.embedding <> x.embedding GROUP BY e.a)
SELECT vec_id, group_id, group_id = vec_id AS keep, coalesce(links, 0) AS links FROM g LEFT JOIN l USING (vec_id)"""

QUERIES = {
    f.__name__: f
    for f in (op1_exact_top_k, op2_best_fit_packing, op3_minhash_near_dedup, op4_secret_scans, op5_language_id, op6_quality_classifier, op7_embedding_near_dedup, op8_sentencepiece, op9_warc, op10_toxicity)
}
ORACLES = {"op1_exact_top_k": _TOP_K_SQL, "op4_secret_scans": _secrets_sql(), "op7_embedding_near_dedup": _NEAR_VECTORS_SQL, "op9_warc": "SELECT page_id, url, html FROM pages WHERE html IS NOT NULL"}
