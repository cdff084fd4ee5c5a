"""Places in a sorted order without a single task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import settle

_LOW = (1 << 33) - 1


def with_ordinal(df: DataFrame, group: list[str], order: list[Column], name: str = "ord") -> DataFrame:
    """``df`` with ``name``, the place from 0 of each row within its ``group`` in the order of ``order``.

    One range shuffle by group and order; a row's place is its place in its task plus the rows that earlier
    tasks hold of the same group, which a small table of (task, group) counts tells. So neither one group nor
    one task has to hold more than a range of the data. ``order`` must tell the rows of a group apart.
    """
    keys = [F.col(g) for g in group] + order
    rows = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_task", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(_LOW)))
    seen = rows.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_task").alias("_t"), (before - F.col("_first")).alias("_shift"))
    same = F.col("_task") == F.col("_t")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(seen, same).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_task", "_t", "_shift", *[f"_g{i}" for i in range(len(group))])
