"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a session with a plain local master (one machine, as in tests) may do
    without it and gets a temporary folder instead."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return _own[key]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path with the file system that holds it; a session that has ended leaves it."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - at exit the JVM may be gone
        return


def settle(df: DataFrame, name: str = "table", codec: str = "snappy") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again. The files survive the
    loss of executors; they are removed when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)
