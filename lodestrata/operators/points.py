"""Points of fixed-width numbers: leaves, bounds, ranges and their bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import with_ordinal

LEAF = 1024  #: points in a leaf


def leaves(points: DataFrame, value: str, doc: list[str], leaf: int = LEAF) -> DataFrame:
    """``(leaf, n, min_value, max_value, doc_count)``: points in the order of their values, in runs of ``leaf``."""
    one = points.select(F.lit("p").alias("_f"), F.col(value).alias("value"), *doc)
    rows = with_ordinal(one, ["_f"], [F.col("value"), *[F.col(d) for d in doc]], "_ord").withColumn("leaf", F.expr(f"_ord div {leaf}"))
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.countDistinct(doc[0]).alias("doc_count"))


def bounds(points: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """One row: points and, for every dimension, the least and the greatest value; a negative zero is given as 0."""
    return points.agg(F.count(F.lit(1)).alias("point_count"), *[(f(c) + F.lit(0.0)).alias(f"{n}_{name}") for n, c in dims.items() for name, f in (("min", F.min), ("max", F.max))])


def within(points: DataFrame, box: dict[str, tuple]) -> DataFrame:
    """Points with every dimension inside its closed range; the ranges reach the scan."""
    test = F.lit(True)
    for name, (low, high) in box.items():
        test = test & F.col(name).between(low, high)
    return points.where(test)


def sortable_hex(value: Column) -> Column:
    """The 8 bytes of a long, sign flipped so that bytes sort as values do, in hexadecimal."""
    return F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
