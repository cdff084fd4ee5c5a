"""Columnar values: profiles that choose an encoding, dictionaries, sets and presence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinals import with_ordinal

TABLE = 255  #: distinct values up to which values are stored as places in a table


def long_form(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(field_name, value)``, one row for each non-null value of each column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("long").alias("value")) for n, c in columns.items()])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null")


def numeric_profile(values: DataFrame) -> DataFrame:
    """``(field_name, format, count, min_value, max_value, gcd, distinct, bits)`` of ``(field_name, value)``.

    Formats: CONST for one value, TABLE for up to TABLE distinct ones that are wider than their places in the
    table, GCD where all differences from the least have a common divisor above 1, else DELTA. Distinct values
    are found by an aggregation; the divisor is folded over the distinct differences, batch by batch in each
    task and then over the tasks' results, so no group is collected.
    """
    distinct = values.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))
    base = distinct.groupBy("field_name").agg(F.sum("n").alias("count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("distinct"))
    diffs = distinct.join(F.broadcast(base.select("field_name", "min_value")), "field_name").select("field_name", (F.col("value") - F.col("min_value")).alias("d"))  # a row for each field

    def fold(batches):
        found: dict[str, int] = {}
        for pdf in batches:
            for name, d in pdf.groupby("field_name")["d"]:
                found[name] = int(np.gcd(np.gcd.reduce(d.to_numpy()), found.get(name, 0)))
        yield pd.DataFrame({"field_name": list(found), "d": list(found.values())}).astype({"field_name": object, "d": "int64"})

    @F.pandas_udf("long")
    def gcd(d: pd.Series) -> int:
        return int(np.gcd.reduce(d.to_numpy()))

    folded = diffs.mapInPandas(fold, "field_name string, d long").groupBy("field_name").agg(gcd("d").alias("gcd"))
    spread = F.col("max_value") - F.col("min_value")
    size = lambda c: F.when(c <= 0, 0).otherwise(F.length(F.bin(c)))
    out = base.join(folded, "field_name")
    table = (F.col("distinct") <= TABLE) & (size(F.col("distinct") - 1) < size(spread))
    kind = F.when(F.col("distinct") == 1, "CONST").when(table, "TABLE").when(F.col("gcd") > 1, "GCD").otherwise("DELTA")
    out = out.withColumn("format", kind)
    bits = F.when(F.col("format") == "CONST", 0).when(F.col("format") == "TABLE", size(F.col("distinct") - 1)).when(F.col("format") == "GCD", size(F.floor(spread / F.col("gcd")))).otherwise(size(spread))
    return out.select("field_name", "format", "count", "min_value", "max_value", "gcd", "distinct", bits.cast("long").alias("bits"))


def packed(values: DataFrame, profile: DataFrame) -> DataFrame:
    """``(field_name, packed, ...)``: what GCD, DELTA and CONST store, the differences in units of the divisor."""
    p = F.broadcast(profile.select("field_name", "min_value", "gcd"))  # a row for each field
    unit = F.greatest(F.col("gcd"), F.lit(1))
    return values.join(p, "field_name").withColumn("packed", F.expr("(value - min_value) div greatest(gcd, 1)")).withColumn("unit", unit)


def unpacked(stored: DataFrame) -> Column:
    """The value again: least value plus units."""
    return stored["min_value"] + stored["unit"] * stored["packed"]


def binary_profile(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``(field_name, count, min_length, max_length, format)`` in bytes; FIXED if all are of one length."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), F.octet_length(c).alias("size")) for n, c in columns.items()])
    rows = df.select(F.explode(pairs).alias("p")).select("p.*").where("size is not null")
    out = rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("count"), F.min("size").cast("long").alias("min_length"), F.max("size").cast("long").alias("max_length"))
    return out.withColumn("format", F.when(F.col("min_length") == F.col("max_length"), "FIXED").otherwise("VARIABLE"))


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """``(ord, value)``: distinct values numbered from 0 in byte order, which no task does for all of them."""
    values = df.select(F.lit("v").alias("_f"), F.col(value).alias("value")).where("value is not null").distinct()
    return with_ordinal(values, ["_f"], [F.col("value").cast("binary")]).select("ord", "value")


def sorted_ordinals(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, ord, value)``: each row's place in the dictionary and the value found there."""
    d = dictionary(df, value)
    return df.select(key, F.col(value).alias("value")).join(d, "value").select(key, "ord", "value")


def sorted_set(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, values)``: distinct values in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("values"))


def sorted_numeric(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, values)``: all values in order, repeats included."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def live_docs(docs: DataFrame, values: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, live)``: whether a document has a value."""
    has = values.where(F.col(value).isNotNull()).select(F.col(key)).distinct().withColumn("_live", F.lit(True))
    return docs.select(key).join(has, key, "left").select(key, F.coalesce("_live", F.lit(False)).alias("live"))


def live_summary(live: DataFrame) -> DataFrame:
    """``(live, total, kind, bytes)``: ALL_LIVE, ALL_MISSING or MIXED with a bit for each document."""
    s = live.agg(F.coalesce(F.sum(F.col("live").cast("long")), F.lit(0)).alias("live"), F.count(F.lit(1)).alias("total"))
    kind = F.when(F.col("live") == F.col("total"), "ALL_LIVE").when(F.col("live") == 0, "ALL_MISSING").otherwise("MIXED")
    return s.select("live", "total", kind.alias("kind"), F.when(kind == "MIXED", F.expr("(total + 7) div 8")).otherwise(F.lit(0)).cast("long").alias("bytes"))
