"""Blocks of similar vectors: the sequence of grid cells that the joins and searches over embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import lean, settle

BLOCK_BYTES = 4 << 20  #: bytes of the vectors in a block at most


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of a list column as float64; the lists must be of one length."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.array(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def clean(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> tuple[DataFrame, int]:
    """``(id, v, *more)`` of the rows whose vector can be compared: not null, of the most frequent length (ties: the
    longest), finite in every value and not all zero. Also that length, 0 without rows. Lists of float stay
    float: nothing is lost and half of the bytes are moved."""
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    v = F.col(vec_col).cast("array<float>" if single else "array<double>")
    src = df.select(F.col(id_col).alias("id"), v.alias("v"), *more).where("v is not null and size(v) > 0")
    lengths = src.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return src, 0
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.where((F.size("v") == lengths.n) & ~bad & F.exists("v", lambda x: x != 0)), lengths.n


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal(rows: DataFrame, size: int, dims: int) -> np.ndarray:
    """(size x dims) leading principal directions of the unit vectors, from sums over all rows: each task
    gives its sums once, and they are added up by key, so that the driver gets size**2 numbers at most."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([unit(matrix(b.column("v"))), np.ones(b.num_rows)])
                total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "s"])

    got = rows.select("v").mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
    flat = np.zeros((size + 1) ** 2)
    flat[np.array(got["k"])] = np.array(got["s"])
    m = flat.reshape(size + 1, size + 1)
    n = max(m[size, size], 1.0)
    mean = m[size, :size] / n
    values, vectors = np.linalg.eigh(m[:size, :size] / n - np.outer(mean, mean))
    return vectors[:, np.argsort(-values)[:dims]]


def load(raw, single: bool, size: int) -> np.ndarray:
    """Unit vectors of a block from its bytes."""
    return unit(np.frombuffer(raw, dtype=np.float32 if single else np.float64).reshape(-1, size))


def blocks(rows: DataFrame, basis: np.ndarray, width: float, block: int | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``(block, n, ids, vecs, low, high, *more)``: the rows in the order of their grid cells (``width`` wide, on the
    directions of ``basis``, the leading first), cut into sequence intervals of at most ``block`` rows (as
    BLOCK_BYTES has room for); the vectors as bytes of their own type; ``low`` and ``high`` bound the unit
    vectors' projections; ``more`` columns as lists. One range shuffle of the vectors."""
    size, dims = basis.shape
    single = isinstance(rows.schema["v"].dataType.elementType, T.FloatType)
    block = block or max(1, BLOCK_BYTES // (size * (4 if single else 8)))
    kinds = [(c, rows.schema[c].dataType.simpleString()) for c in ("id", *more)]
    own = ", ".join(f"{c} {k}" for c, k in kinds)

    @lean
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.floor(unit(matrix(b.column("v"))) @ basis / width).astype(np.int32)
                raw = np.array(b.column("v").flatten(), dtype=np.float32 if single else np.float64).reshape(b.num_rows, -1)
                vals = pa.array([r.tobytes() for r in raw], pa.binary())
                yield pa.record_batch([*(b.column(n) for n, _ in kinds), *(pa.array(c[:, k]) for k in range(dims)), vals], names=[*(n for n, _ in kinds), *(f"c{k}" for k in range(dims)), "x"])

    order = [f"c{k}" for k in range(dims)]
    table = rows.mapInArrow(cells, f"{own}, {', '.join(f'{c} int' for c in order)}, x binary")
    table = table.repartitionByRange(*order, "id").sortWithinPartitions(*order, "id").withColumn("part", F.spark_partition_id())

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, count, seq = [], 0, 0

        def out(t: pa.Table):
            nonlocal seq
            raw = b"".join(t["x"].to_pylist())
            p = load(raw, single, size) @ basis
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[n].combine_chunks()) for n, _ in kinds]
            name = (t["part"][0].as_py() << 32) + seq
            seq += 1
            return pa.record_batch([pa.array([name]), pa.array([t.num_rows], pa.int32()), lists[0], pa.array([raw], pa.binary()), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()]), *lists[1:]], names=["block", "n", "ids", "vecs", "low", "high", *more])

        for b in batches:
            if b.num_rows:
                kept.append(b)
                count += b.num_rows
            while count >= block:
                t = pa.Table.from_batches(kept)
                yield out(t.slice(0, block))
                kept, count = t.slice(block).to_batches(), count - block
        if count:
            yield out(pa.Table.from_batches(kept))

    lists = "".join(f", {c} array<{k}>" for c, k in kinds[1:])
    packed = table.mapInArrow(pack, f"block long, n int, ids array<{kinds[0][1]}>, vecs binary, low array<double>, high array<double>{lists}")
    return settle(packed, "blocks")
