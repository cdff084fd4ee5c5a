"""One session for all tests, and the rows of queries and of SQL in a form that can be compared."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rounded(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(rounded, value))
    if isinstance(value, (int, str, bytes, bool, type(None))):
        return value
    return str(value)


def spark_rows(df) -> list[str]:
    names = sorted(df.columns)
    return sorted(repr(tuple(rounded(r[c]) for c in names)) for r in df.collect())


def sql_rows(sql: str, sf: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for t in TABLES:
        path = DATA / sf / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(repr(tuple(rounded(r[i]) for i in order)) for r in found.fetchall())
