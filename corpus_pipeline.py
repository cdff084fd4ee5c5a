"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes rows with nulls in any column, texts of any length, repeated rows and empty tables: language ID and
quality drop null and empty texts, near-dedup keeps one row of each group of like texts, the first by id, and one
of repeated rows, secrets change texts only, packing puts every text's tokens into bins. Columns of other names
than a document's stay until packing. What ties mean is said in each operator.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import langid, neardup, packing, quality, secrets
from lodestrata.llm._shared import delete, shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others' ``lang`` becomes the language found."""
    return langid.keep_identified(docs, langid.dictionaries(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of poor quality, by a model of the labelled ones, go."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by the names of their rules; every document stays."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences to train on: bins of token ids, each with the documents' pieces that lie in it."""
    return packing.sequences(packing.pack(docs))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # compression, fitted models, sketches and the packing are beyond SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what lies between two stages is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/lodestrata-stage-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            atexit.register(delete, spark, path)
            docs = spark.read.parquet(path)
    return docs
