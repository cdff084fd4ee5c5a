"""Exact nearest vectors of a set of queries among all vectors, by the threshold algorithm."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors
from ._shared import lean, settle, small_batches

K = 10  #: neighbours of each query
DIMS = 8  #: leading principal dimensions by which vectors are laid out in blocks
LISTS = 16  #: leading principal dimensions that have a sorted list in each block; one more list has the lengths of the rest
CELL = 0.25  #: width of the cells of the layout
BLOCK = 4096  #: vectors of a block, as vectors.BLOCK_BYTES has room for
QUERIES = 2048  #: queries of a block
TILE = 256  #: blocks of either kind that are planned together, on average
SLICE = 64  #: blocks that one task looks through for a block of queries, on average
DEPTHS = (0, 4, 16, 64, 256, 1024)  #: places in the sorted lists at which the threshold is looked at


def slack(size: int) -> float:
    """What a product of two float32 unit vectors may be off by, and a score by its rounding to 9 digits."""
    return (size + 4) * 2.0**-23 + 1e-9


@dataclass
class Lists:
    """A block in the order in which its sorted lists, read from both ends, meet the rows. By the place ``t`` in
    DEPTHS, ``cuts[t]`` rows are met; what isn't met yet has at most ``high[t]`` and at least ``low[t]`` on each
    principal dimension; the last of ``high[t]`` is the length of the vector off these dimensions."""

    ids: list
    x: np.ndarray
    cuts: np.ndarray
    high: np.ndarray
    low: np.ndarray


def sort_block(x: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows of a block for its Lists, and ``cuts``, ``high`` and ``low``."""
    n, p = len(x), x @ basis
    rest = np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1)))
    order = np.argsort(np.column_stack([p, -rest]), axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    met = np.minimum(np.minimum(rank[:, :-1], n - 1 - rank[:, :-1]).min(axis=1, initial=n), rank[:, -1])
    at = np.minimum(DEPTHS, n - 1)
    lists = np.take_along_axis(p, order[:, :-1], axis=0)
    high = np.column_stack([lists[n - 1 - at], rest[order[at, -1]]])
    by = np.argsort(met, kind="stable")
    return by, np.append(np.searchsorted(met[by], DEPTHS), n), high, lists[at]


def threshold(a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each row the most that the sum of ``a * y`` can be where y is at most ``u`` and no longer than 1, as every
    vector is. Any multiplier of the length gives an upper bound; halving finds one near the least."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(12):
        mid = (low + high) / 2
        long = (np.minimum(u, a / mid[:, None]) ** 2).sum(axis=1) > 1
        low, high = np.where(long, mid, low), np.where(long, high, mid)
    y = np.minimum(u, a / high[:, None])
    return np.minimum((a * u).sum(axis=1), (a * y).sum(axis=1) + high / 2 * (1 - (y * y).sum(axis=1)))


class Best:
    """The ``k`` best of each query so far: scores rounded to 9 digits, ties by place of the id."""

    def __init__(self, q: np.ndarray, own: list, k: int, basis: np.ndarray, bound: np.ndarray | None = None):
        self.q, self.q32, self.k, self.slack = q, q.astype(np.float32), k, slack(q.shape[1])
        p = q @ basis
        self.p = p
        self.weight = np.column_stack([np.abs(p), np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1)))])
        self.own = own
        self.found: list[list[tuple[float, object]]] = [[] for _ in own]
        self.bound = np.full(len(own), -np.inf) if bound is None else bound.copy()
        self.scored = 0

    def feed(self, lists: Lists) -> None:
        """Take in a block: read its lists deeper and deeper, score the rows that are met, and leave a query when
        the threshold, the most that a row not met yet can score, can't reach its kth result."""
        active = np.arange(len(self.own))
        for t in range(len(DEPTHS)):
            if lists.cuts[t] == lists.cuts[-1]:
                return
            most = np.column_stack([np.where(self.p[active] > 0, lists.high[t, :-1], -lists.low[t]), np.full(len(active), lists.high[t, -1])])
            active = active[threshold(self.weight[active], most) >= self.bound[active] - self.slack]
            if not len(active):
                return
            self._score(lists, active, int(lists.cuts[t]), int(lists.cuts[t + 1]))

    def _score(self, lists: Lists, active: np.ndarray, low: int, high: int) -> None:
        x = lists.x[low:high]
        x32 = x.astype(np.float32)
        self.scored += len(active) * len(x)
        for lo in range(0, len(active), 512):
            part = active[lo : lo + 512]
            s = self.q32[part] @ x32.T
            bound = self.bound[part]
            if s.shape[1] > self.k + 1:  # the own row may be among the best
                least = np.partition(s, -self.k - 1, axis=1)[:, -self.k - 1]
                bound = np.maximum(bound, least)
            i, j = np.nonzero(s >= (bound - self.slack)[:, None].astype(np.float32))
            if not len(i):
                continue
            exact = np.round(np.einsum("ij,ij->i", self.q[part[i]], x[j]), 9)
            cut = np.flatnonzero(np.diff(i)) + 1
            for a, b in zip([0, *cut], [*cut, len(i)]):
                n = int(part[i[a]])
                own = self.own[n]
                more = [(-v, y) for v, y in zip(exact[a:b].tolist(), (lists.ids[low + r] for r in j[a:b])) if y != own]
                best = sorted({*self.found[n], *more})[: self.k]
                self.found[n] = best
                if len(best) == self.k:
                    self.bound[n] = max(self.bound[n], -best[-1][0])


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _ball(x: np.ndarray) -> tuple[list[float], float]:
    centre = x.mean(axis=0)
    return centre.tolist(), float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))


def _pairs(queries: DataFrame, data: DataFrame) -> DataFrame:
    """``(qb, block, upper)``: the pairs of blocks that the balls around their vectors leave, and the most that any
    two of them can score. Every tile of TILE by TILE blocks is one group: blocks meet by an equi-join of tiles."""
    nq, nd = (max(1, -(-t.count() // TILE)) for t in (queries, data))
    q = queries.select("qb", "centre", "radius", "worst", F.pmod(F.xxhash64("qb"), F.lit(nq)).alias("g"), _each(nd).alias("h"))
    d = data.select("block", "centre", "radius", _each(nq).alias("g"), F.pmod(F.xxhash64("block"), F.lit(nd)).alias("h"))

    def plan(q: pa.Table, d: pa.Table) -> pa.Table:
        if not q.num_rows or not d.num_rows:
            return pa.table({"qb": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "upper": pa.array([], pa.float64())})
        c, e = vectors.matrix(q["centre"]), vectors.matrix(d["centre"])
        r, s = np.array(q["radius"])[:, None], np.array(d["radius"])[None, :]
        # (c + u) (e + v) with |u| <= r, |v| <= s is at most c e + r |e| + s |c| + r s
        upper = c @ e.T + r * np.linalg.norm(e, axis=1)[None, :] + s * np.linalg.norm(c, axis=1)[:, None] + r * s
        i, j = np.nonzero(upper >= np.array(q["worst"])[:, None] - slack(c.shape[1]))
        return pa.table({"qb": np.array(q["qb"])[i], "block": np.array(d["block"])[j], "upper": upper[i, j]})

    return q.groupBy("g", "h").cogroup(d.groupBy("g", "h")).applyInArrow(plan, "qb long, block long, upper double")


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, queries: Column | None = None) -> DataFrame:
    """``(vec_id, rank, neighbor_id, similarity)``: for every row that ``queries`` holds for (all without it) the
    ``k`` neighbours of the greatest cosine among all rows, exactly; ties (to 9 digits) go to the smaller id, and
    the vector's own id is left out.

    Vectors lie in blocks of similar ones, each stored once in the order in which its sorted lists meet the rows:
    lists over the leading principal dimensions, and one over the lengths of what is left, by which the scalar
    product of the rest is bounded. Each query's first bound is its kth score in its own block. A block goes to
    a block of queries if the balls around both allow a score above the least of these bounds. A task looks
    through SLICE blocks by falling upper bound and doesn't score what the threshold rules out, which knows that
    vectors are no longer than 1; what the slices find is merged.

    Null, zero, not finite vectors and such of another length than most are neither queries nor neighbours;
    null ids are left out; of repeated ids the least vector, value by value, counts, and the id is a query if
    any of its rows is. Fewer than k others give fewer rows; no rows or queries give none. Other columns, whatever
    their names, don't matter.
    """
    small_batches(df.sparkSession)
    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows, size = vectors.clean(df, id_col, vec_col, asked.alias("q"))
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, rank int, neighbor_id {kind}, similarity double"
    if not size:
        return df.sparkSession.createDataFrame([], schema)
    single = isinstance(rows.schema["v"].dataType.elementType, T.FloatType)
    rows = rows.where("id is not null").groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    basis = vectors.principal(rows, size, min(LISTS, size))
    table = vectors.blocks(rows, basis[:, : min(DIMS, size)], CELL, min(BLOCK, max(1, vectors.BLOCK_BYTES // (size * 8))), ("q",))

    @lean
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                raw = np.frombuffer(b.column("vecs")[r].as_buffer(), dtype=np.float32 if single else np.float64).reshape(-1, size)
                x = vectors.unit(raw)
                by, cuts, high, low = sort_block(x, basis)
                ids, q = b.column("ids")[r].values.take(pa.array(by)), np.array(b.column("q")[r].values.take(pa.array(by)))
                own = np.flatnonzero(q)
                found = ids.to_pylist()
                best = Best(x[by][own], [found[i] for i in own], k, basis)
                best.feed(Lists(found, x[by], cuts, high, low))
                centre, radius = _ball(x)
                one = lambda v, kind=None: pa.array([v], kind)
                whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
                values = [b.column("block").slice(r, 1), whole(ids), one(raw[by].tobytes()), whole(pa.array(cuts, pa.int32())), one(high.ravel().tolist()), one(low.ravel().tolist(), pa.list_(pa.float64())), one(centre), one(radius), whole(ids.take(pa.array(own))), one(raw[by][own].tobytes()), one(best.bound.tolist(), pa.list_(pa.float64()))]
                yield pa.record_batch(values, names=["block", "ids", "vecs", "cuts", "high", "low", "centre", "radius", "qids", "qvecs", "bounds"])

    data = table.select("block", "ids", "vecs", "q").mapInArrow(lists, f"block long, ids array<{kind}>, vecs binary, cuts array<int>, high array<double>, low array<double>, centre array<double>, radius double, qids array<{kind}>, qvecs binary, bounds array<double>")
    data = settle(data, "lists")
    asked = data.select("qids", "qvecs", "bounds").where("size(qids) > 0")
    count = asked.agg(F.sum(F.size("qids"))).first()[0] or 0

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, seq = [], 0, 0

        def out() -> pa.RecordBatch:
            nonlocal kept, n, seq
            raw = b"".join(v for _, v, _ in kept)
            centre, radius = _ball(vectors.load(raw, single, size))
            ids = pa.concat_arrays([i for i, _, _ in kept])
            bounds = np.concatenate([b for _, _, b in kept])
            name = (TaskContext.get().partitionId() << 32) + seq
            seq += 1
            kept, n = [], 0
            whole = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            return pa.record_batch([pa.array([name]), whole(ids), pa.array([raw]), whole(pa.array(bounds)), pa.array([centre]), pa.array([radius]), pa.array([float(bounds.min())])], names=["qb", "ids", "vecs", "bounds", "centre", "radius", "worst"])

        for b in batches:
            for r in range(b.num_rows):
                kept.append((b.column("qids")[r].values, b.column("qvecs")[r].as_py(), np.array(b.column("bounds")[r].values)))
                n += len(kept[-1][0])
                if n >= QUERIES:
                    yield out()
        if kept:
            yield out()

    asked = asked.coalesce(max(1, count // QUERIES))  # neighbouring partitions together
    asked = settle(asked.mapInArrow(gather, f"qb long, ids array<{kind}>, vecs binary, bounds array<double>, centre array<double>, radius double, worst double"), "queries")
    slices = max(1, math.ceil(data.count() / SLICE))
    part = F.pmod(F.xxhash64("block"), F.lit(slices))
    pairs = _pairs(asked, data).withColumn("slice", part)
    none = F.lit(None)
    sent = pairs.join(data.select("block", "ids", "vecs", "cuts", "high", "low"), "block").select("qb", "slice", F.lit(1).alias("kind"), "upper", "ids", "vecs", "cuts", "high", "low", none.cast("array<double>").alias("bounds"))
    heads = asked.select("qb", _each(slices).alias("slice"), F.lit(0).alias("kind"), none.cast("double").alias("upper"), "ids", "vecs", none.cast("array<int>").alias("cuts"), none.cast("array<double>").alias("high"), none.cast("array<double>").alias("low"), "bounds")
    sent = heads.union(sent).repartition("qb", "slice").sortWithinPartitions("qb", "slice", "kind", F.desc("upper"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids_type = None, None

        def out(best: Best) -> pa.RecordBatch:
            flat = [x for f in best.found for x in f]
            own = [o for o, f in zip(best.own, best.found) for _ in f]
            return pa.RecordBatch.from_arrays([pa.array(own, ids_type), pa.array([x[1] for x in flat], ids_type), pa.array(np.array([-x[0] for x in flat], dtype=float))], names=["vec_id", "neighbor_id", "similarity"])

        for b in batches:
            ids_type = b.schema.field("ids").type.value_type
            for r in range(b.num_rows):
                x, ids = vectors.load(b.column("vecs")[r].as_buffer(), single, size), b.column("ids")[r].as_py()
                if b.column("kind")[r].as_py() == 0:  # a block of queries, then the data blocks of its slice
                    if best is not None:
                        yield out(best)
                    best = Best(x, ids, k, basis, np.array(b.column("bounds")[r].values, dtype=float))
                elif b.column("upper")[r].as_py() >= best.bound.min() - best.slack:
                    high, low = (np.array(b.column(c)[r].values, dtype=float).reshape(len(DEPTHS), -1) for c in ("high", "low"))
                    best.feed(Lists(ids, x, np.array(b.column("cuts")[r].values), high, low))
        if best is not None:
            yield out(best)

    found = sent.mapInArrow(run, f"vec_id {kind}, neighbor_id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", "similarity")
