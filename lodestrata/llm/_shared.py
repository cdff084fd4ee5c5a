"""Row keys, Arrow helpers and small batches for the operators of this subpackage; tables in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import delete, settle, shared_dir  # noqa: F401 - the operators take them from here

SCAN_ROWS = 512  #: rows that a scan decodes at once: a vector of texts grows with the longest of them and stays so
ARROW_BYTES = 4 << 20  #: bytes of an Arrow batch between the JVM and Python; both sides hold a few of them for each task


def small_batches(spark: SparkSession) -> None:
    """Scans of SCAN_ROWS and batches of ARROW_BYTES at most for what runs from now on in this session: texts are long, and each task
    holds batches on both sides of the pipe outside the heap."""
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > SCAN_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(SCAN_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:  # a size with a unit is the user's own, or the default
        spark.conf.set(name, str(ARROW_BYTES))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, giving memory back to the system when a task ends: Python workers are kept for later stages."""

    def inner(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return inner


def row_key(*cols: Column | str) -> Column:
    """16 bytes that stand for the values of ``cols``, nulls told from empty strings."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    shown = [F.concat(F.coalesce(F.length(p.cast("string")).cast("string"), F.lit("n")), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.unhex(F.md5(F.concat(*shown)))


def sized(batches: Iterator[pa.RecordBatch], column: str, limit: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds at most ``limit`` bytes in each, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        arr = b.column(b.schema.get_field_index(column))
        width = 4 if pa.types.is_string(arr.type) or pa.types.is_binary(arr.type) else 8
        off = np.frombuffer(arr.buffers()[1], dtype=np.int32 if width == 4 else np.int64)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, letter case aside."""
    have = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in have:
        n += 1
        name = f"{stem}_{n}"
    return name
