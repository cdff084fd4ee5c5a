"""Near copies of embeddings: an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors
from ._shared import lean, settle, small_batches
from .components import components

SIMILARITY = 0.97  #: least cosine of near copies
DIMS = 8  #: leading principal dimensions of the grid
LEAF = 128  #: intervals of so many vectors are compared exhaustively


def _apart(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> float:
    """Least squared distance of the vectors in two boxes; projections on orthonormal directions don't add any."""
    gap = np.maximum(0.0, np.maximum(low_b - high_a, low_a - high_b))
    return float(gap @ gap)


class Join:
    """Near copies between two sequence intervals with projections ``p`` and ``q``, by halving both until they are
    small and leaving out halves whose boxes are too far apart: ``pairs``, a spanning forest of them; ``links``
    and ``linked``, how many each row of the first and of the second has; ``compared``, how many were looked at."""

    def __init__(self, x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, same: bool, eps2: float, least: float):
        self.x, self.y, self.p, self.q, self.same, self.eps2, self.least = x, y, p, q, same, eps2, least
        self.pairs: list[tuple[int, int]] = []
        self.links, self.linked = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        self.compared = 0
        self._box: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._run(0, len(x), 0, len(y), same)

    def _bounds(self, side: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        key = (side, lo, hi)
        if key not in self._box:
            part = (self.q if side else self.p)[lo:hi]
            self._box[key] = part.min(axis=0), part.max(axis=0)
        return self._box[key]

    def _run(self, a: int, b: int, c: int, d: int, same: bool) -> None:
        if not same and _apart(*self._bounds(0, a, b), *self._bounds(1, c, d)) > self.eps2:
            return
        if b - a <= LEAF and d - c <= LEAF:
            self.compared += (b - a) * (d - c)
            near = self.x[a:b] @ self.y[c:d].T >= self.least
            if same:
                near = np.triu(near, 1)
            if near.any():
                self.links[a:b] += near.sum(axis=1)
                self.linked[c:d] += near.sum(axis=0)
                self.pairs += _forest(near, a, c)
            return
        i, j = (a + b + 1) // 2, (c + d + 1) // 2
        if same:
            self._run(a, i, a, i, True)
            self._run(i, b, i, b, True)
            self._run(a, i, i, b, False)
            return
        for e, f in ((a, i), (i, b)) if b - a > LEAF else ((a, b),):
            for g, h in ((c, j), (j, d)) if d - c > LEAF else ((c, d),):
                self._run(e, f, g, h, False)


def _forest(near: np.ndarray, at: int, to: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs in ``near``, so that a group of copies gives as many pairs as it has
    members and not their square."""
    if not near.any():
        return []
    rows = near.any(axis=1)
    cols = np.ones(near.shape[1], dtype=bool)
    out = []
    left = set(np.flatnonzero(rows).tolist())
    while left:
        todo = [left.pop()]
        while todo:
            r = todo.pop()
            hit = np.flatnonzero(near[r] & cols)
            cols[hit] = False
            out += [(at + r, to + c) for c in hit.tolist()]
            if left and len(hit):
                others = np.array(sorted(left))
                for o, c in zip(others, near[np.ix_(others, hit)].argmax(axis=1)):
                    if near[o, hit[c]]:
                        out.append((at + int(o), to + int(hit[c])))
                        left.discard(int(o))
                        todo.append(int(o))
    return out


def edges(rows: DataFrame, size: int, similarity: float = SIMILARITY) -> DataFrame:
    """``(a, b, n)``: pairs of ids, of which the linked sets are those of all pairs with a cosine of ``similarity``
    and more (null ``n``); and for each id ``a`` (null ``b``) counts ``n`` which add up to its number of such
    pairs. Ids must be distinct.

    Pairs of blocks are planned on their boxes alone: the blocks meet on the cells of the leading dimension that
    they and their neighbours cover, then the boxes must lie within epsilon. Blocks are of vectors.BLOCK_BYTES,
    so that a vector is sent as often as there are blocks near its own; within a task the intervals are halved.
    """
    eps2 = 2 - 2 * similarity + 1e-9
    eps = float(np.sqrt(eps2))
    basis = vectors.principal(rows, size, min(DIMS, size))
    table = vectors.blocks(rows, basis, eps)
    single = isinstance(rows.schema["v"].dataType.elementType, T.FloatType)
    kind = rows.schema["id"].dataType.simpleString()
    box = table.select("block", "low", "high")
    left = box.select(F.col("block").alias("i"), F.col("low").alias("li"), F.col("high").alias("hi"), F.explode(F.sequence(F.floor(F.col("low")[0] / eps), F.floor(F.col("high")[0] / eps))).alias("cell"))
    right = box.select(F.col("block").alias("j"), F.col("low").alias("lj"), F.col("high").alias("hj"), F.explode(F.sequence(F.floor(F.col("low")[0] / eps) - 1, F.floor(F.col("high")[0] / eps) + 1)).alias("cell"))
    gaps = F.zip_with(F.zip_with("lj", "hi", lambda a, b: a - b), F.zip_with("li", "hj", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    near = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= eps2
    pairs = left.join(right, "cell").where((F.col("i") <= F.col("j")) & near).select("i", "j").distinct()
    a = table.select(F.col("block").alias("i"), F.col("ids").alias("ids_i"), F.col("vecs").alias("vecs_i"))
    b = table.select(F.col("block").alias("j"), F.col("ids").alias("ids_j"), F.col("vecs").alias("vecs_j"))
    alone = pairs.where("i = j").join(a, "i").select("ids_i", "vecs_i", F.lit(None).cast(f"array<{kind}>").alias("ids_j"), F.lit(None).cast("binary").alias("vecs_j"))
    both = pairs.where("i < j").join(a, "i").join(b, "j").select("ids_i", "vecs_i", "ids_j", "vecs_j")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = not batch.column("vecs_j")[k].is_valid
                x = vectors.load(batch.column("vecs_i")[k].as_buffer(), single, size)
                y = x if same else vectors.load(batch.column("vecs_j")[k].as_buffer(), single, size)
                p = x @ basis
                found = Join(x, y, p, p if same else y @ basis, same, eps2, similarity - 1e-12)
                ids = batch.column("ids_i")[k].values
                others = ids if same else batch.column("ids_j")[k].values
                if found.pairs:
                    p, q = np.array(found.pairs).T
                    yield pa.record_batch([ids.take(pa.array(p)), others.take(pa.array(q)), pa.nulls(len(p), pa.int64())], names=["a", "b", "n"])
                    for own, n in ((ids, found.links), (others, found.linked)):
                        some = np.flatnonzero(n)
                        yield pa.record_batch([own.take(pa.array(some)), pa.nulls(len(some), own.type), pa.array(n[some])], names=["a", "b", "n"])

    return alone.unionByName(both).mapInArrow(run, f"a {kind}, b {kind}, n long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """``(vec_id, group_id, keep, links)`` for every distinct id: groups are the connected components of the pairs
    with a cosine of ``similarity`` or more; the vector of the least id is kept; ``links`` counts the other
    vectors, equal ones once, that are so near to the id's vector.

    Equal vectors are one class, named by its least id, and only these are joined, so that copies cost nothing
    in the join. A vector that is null, of another length than most, zero or not finite is alone, with no links.
    Rows of one id count together: all of its vectors link its group, and its links are the most that one of
    them has. Null ids are left out. Other columns, whatever their names, don't matter; no rows give none.
    """
    small_batches(df.sparkSession)
    rows, size = vectors.clean(df, id_col, vec_col)
    ids = df.select(F.col(id_col).alias("vec_id")).where("vec_id is not null").distinct()
    if not size:
        return ids.select("vec_id", F.col("vec_id").alias("group_id"), F.lit(True).alias("keep"), F.lit(0).cast("long").alias("links"))
    rows = rows.where("id is not null").select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = settle(rows.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()), "classes")
    member = settle(rows.select("id", "h1", "h2").distinct().join(classes.select(F.col("id").alias("class"), "h1", "h2"), ["h1", "h2"]).select("id", "class"), "members")
    found = settle(edges(classes.select("id", "v"), size, similarity), "near")
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    # classes and ids are the two kinds of nodes; an id's vectors, a class's ids and near classes are linked
    links = found.where("b is not null").select(F.struct(F.lit(1).alias("t"), F.col("a").alias("k")).alias("a"), F.struct(F.lit(1).alias("t"), F.col("b").alias("k")).alias("b"))
    one = member.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("first"))
    several = member.join(one.where("n > 1"), "id").select(F.struct(F.lit(1).alias("t"), F.col("first").alias("k")).alias("a"), F.struct(F.lit(1).alias("t"), F.col("class").alias("k")).alias("b"))
    roots = components(links.union(several)).select(F.col("node.k").alias("class"), F.col("root.k").alias("root"))
    grouped = member.join(roots, "class", "left").join(counts, "class", "left").select("id", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    grouped = settle(grouped.groupBy("id").agg(F.first("root").alias("root"), F.max("links").alias("links")), "grouped")
    least = grouped.groupBy("root").agg(F.min("id").alias("group_id"))
    out = ids.join(grouped.join(least, "root").select(F.col("id").alias("vec_id"), "group_id", "links"), "vec_id", "left")
    group = F.coalesce("group_id", "vec_id")
    return out.select("vec_id", group.alias("group_id"), (group == F.col("vec_id")).alias("keep"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
