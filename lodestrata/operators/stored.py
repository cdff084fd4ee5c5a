"""Stored fields: values by document and field, chunks of documents and their pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import with_ordinal

CHUNK = 16_384  #: bytes of a chunk
TAGS = {"string": 0, "binary": 1, "int": 2, "float": 3, "long": 4, "double": 5}


def stored(df: DataFrame, doc_id: Column, fields: dict[str, tuple[int, Column, str]]) -> DataFrame:
    """``(doc_id, ord, field_number, field_name, type_tag, value)``: a row for each non-null value, in the order
    of ``fields`` (name to number, column, kind); values as text."""
    parts = F.array(*[F.struct(F.lit(n).cast("long").alias("field_number"), F.lit(name).alias("field_name"), F.lit(TAGS[kind]).cast("long").alias("type_tag"), c.cast("string").alias("value")) for name, (n, c, kind) in fields.items()])
    some = F.filter(parts, lambda p: p["value"].isNotNull())
    return df.select(doc_id.alias("doc_id"), F.posexplode(some).alias("ord", "p")).select("doc_id", F.col("ord").cast("long").alias("ord"), "p.*")


def last_value(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """``(key..., value)``: of several values the last one, as a map keeps it."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))


def as_map(rows: DataFrame) -> DataFrame:
    """``(doc_id, doc)``: each document as a map from field name to its last value."""
    return last_value(rows, ["doc_id", "field_name"], "value", "ord").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "value"))).alias("doc"))


def chunks(df: DataFrame, doc_id: str, size: Column, chunk: int = CHUNK) -> DataFrame:
    """``(chunk_id, doc_base, docs, raw_length, start_pointer)``: documents in the order of their ids, in chunks
    by the bytes before them. Running sums go over ranges of ids: a place's sum is that in its range plus the
    totals of the ranges before."""
    rows = with_ordinal(df.select(F.lit("d").alias("_f"), F.col(doc_id).alias("doc_id"), size.cast("long").alias("size")), ["_f"], [F.col("doc_id")], "at")
    block = F.expr("at div 4096")
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("block", block).withColumn("inner", inner)
    totals = rows.groupBy("block").agg(F.sum("size").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(totals.select("block", before.alias("before")), "block").withColumn("pointer", F.col("before") + F.col("inner"))
    rows = rows.withColumn("chunk_id", F.expr(f"pointer div {chunk}"))
    return rows.groupBy("chunk_id").agg(F.min("at").alias("doc_base"), F.count(F.lit(1)).alias("docs"), F.sum("size").alias("raw_length"), F.min("pointer").alias("start_pointer"))


def chunk_pointers(table: DataFrame, block: int = 16) -> DataFrame:
    """``(chunk_id, block_id, base, average, delta, zigzag, pointer)``: the pointers of each block of ``block``
    chunks as base + average * i + delta, the delta in zigzag form, and the pointer decoded from these."""
    rows = with_ordinal(table.select(F.lit("c").alias("_f"), "chunk_id", "start_pointer"), ["_f"], [F.col("chunk_id")], "at")
    rows = rows.withColumn("block_id", F.expr(f"at div {block}")).withColumn("i", F.expr(f"at % {block}"))
    per = rows.groupBy("block_id").agg(F.min("start_pointer").alias("base"), F.expr("(max(start_pointer) - min(start_pointer)) div greatest(count(1) - 1, 1)").alias("average"))
    out = rows.join(per, "block_id").withColumn("delta", F.col("start_pointer") - F.col("base") - F.col("average") * F.col("i"))
    out = out.withColumn("zigzag", F.shiftleft("delta", 1).bitwiseXOR(F.shiftright("delta", 63)))
    back = F.shiftrightunsigned("zigzag", 1).bitwiseXOR(-F.col("zigzag").bitwiseAND(F.lit(1)))
    return out.select("chunk_id", "block_id", "base", "average", "delta", "zigzag", (F.col("base") + F.col("average") * F.col("i") + back).alias("pointer"))
