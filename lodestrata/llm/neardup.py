"""Near copies of documents: MinHash sketches joined along chosen paths, then by signatures that lose no pair."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import fresh, lean, row_key, settle, sized, small_batches
from ._text import mix, shingles, words
from .components import components

WIDTH = 3  #: words in a shingle
SIZE = 256  #: values in a sketch
THRESHOLD = 0.6  #: least share of equal values, an estimate of the shingle sets' Jaccard similarity
TREES = 6  #: independent trees
BRANCH = 1 / THRESHOLD - 1  #: probability of a node's second child down to depth FIRST: a pair at the threshold keeps one child on average
DEEPER = 1.0  #: the same below FIRST, so that the children of such a pair don't die out where nodes stay large
FIRST = 3  #: depth of the first nodes that are looked at; two texts with little in common seldom share one
SMALL = 256  #: nodes of at most so many sketches are compared exhaustively
BIG = 16_384  #: nodes of more sketches than one task should hold; their rows go on one by one
PIVOTS = 8  #: sketches of a big node that each of its rows is compared with
NEAR = 0.9  #: a row of a big node that agrees so much with a pivot is linked to it and branches no further
DEPTH = 12  #: nodes of this depth don't branch
TILE = 1_024  #: sketches of a group that are compared with as many others at once, on average, to count links
SHARED = 4  #: coordinates of a signature
BUCKET = 1 << 20  #: signatures that one task sorts at once, on average
MANY = 256  #: a signature with more pairs of different groups than this gives no pairs of ids: its sketches are compared by tiles
PART = 4_096  #: sketches of such a signature that are compared with as many others at once


def _params() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    a = rng.integers(0, 2**32, SIZE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return a, rng.integers(0, 2**32, SIZE, dtype=np.uint64).astype(np.uint32)


def sketch_array(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(documents x SIZE) bytes: 8 bits of each minwise value; and which documents have any word."""
    a, b = _params()
    h, first = words(arr)
    x, at = shingles(h, first, WIDTH)
    x = (x >> np.uint64(32)).astype(np.uint32)
    n = len(at) - 1
    low = np.zeros((n, SIZE), dtype=np.uint32)
    room = np.empty((256, SIZE), dtype=np.uint32)
    for d in np.flatnonzero(np.diff(at)):
        least = None
        for lo in range(at[d], at[d + 1], 256):
            k = min(256, at[d + 1] - lo)
            part = room[:k]
            np.multiply(x[lo : lo + k, None], a, out=part)
            np.add(part, b, out=part)
            m = part.min(axis=0)
            least = m if least is None else np.minimum(least, m)
        low[d] = least
    low *= np.uint32(0x9E3779B1)
    return (low >> np.uint32(24)).astype(np.uint8), np.diff(at) > 0


@lean
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sized(batches, "text"):
        s, some = sketch_array(b.column("text"))
        keys = [md5(b"s" + r.tobytes()).digest() for r in s]
        for i in np.flatnonzero(~some):
            text, row = b.column("text")[i].as_py(), b.column("row")[i].as_py()
            keys[i] = md5(b"n" + row if text is None else b"t" + text.encode()).digest()
        vals = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIZE), len(s), [None, pa.py_buffer(s.tobytes())]).cast(pa.binary())
        yield pa.record_batch([b.column("doc_id"), b.column("row"), pa.array(some), pa.array(keys, pa.binary()), vals], names=["doc_id", "row", "some", "key", "sketch"])


def _rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), -1)


def _children(level: int, stay: float, node: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of each row's node, and the rows that they are of: the node's hash picks one coordinate of the
    sketch, and another with probability ``stay``; the child is named by the path and the value there."""
    out, of = [], []
    for c in range(2):
        pick = mix(node + np.uint64((2 * level + c + 1) * 0x9E3779B97F4A7C15 % 2**64))
        use = np.arange(len(s)) if c == 0 else np.flatnonzero((pick >> np.uint64(11)).astype(np.float64) / 2**53 < stay)
        i = (mix(pick[use]) % np.uint64(SIZE)).astype(np.int64)
        out.append(mix(mix(node[use] ^ pick[use]) + s[use, i].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        of.append(use)
    return np.concatenate(out), np.concatenate(of)


def _roots(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, keys = _rows(b.column("sketch")), b.column("key")
                for t in range(trees):
                    node, of = np.full(len(s), t * 7_919 + 1, dtype=np.uint64), np.arange(len(s))
                    for level in range(FIRST):
                        node, more = _children(level, BRANCH, node, s[of])
                        of = of[more]
                    yield pa.record_batch([pa.array(node.view(np.int64)), keys.take(pa.array(of))], names=["node", "key"])

    return run


def _compare(s: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of rows of which at least ``least`` values agree: each search compares
    a reached row with the rows not yet reached, so that groups of copies cost their size, not its square."""
    left, out = np.arange(len(s)), []
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            p = queue.pop()
            near = np.zeros(len(left), dtype=bool)
            for lo in range(0, len(left), 8192):
                near[lo : lo + 8192] = (s[left[lo : lo + 8192]] == s[p]).sum(axis=1) >= least
            hit = left[near]
            out += [(root, q) for q in hit]
            queue += hit.tolist()
            left = left[~near]
    return out


def _least(threshold: float) -> int:
    """Values that must agree: unequal minwise values still share 8 bits once in 256."""
    return int(np.ceil(SIZE * (threshold + (1 - threshold) / 256) - 1e-9))


def _likeness(s: np.ndarray) -> float:
    """Mean share of equal values over all pairs of rows, from every eighth coordinate and all rows."""
    cols = range(0, SIZE, 8)
    return float(np.mean([(np.bincount(s[:, c]).astype(float) ** 2).sum() for c in cols]) / len(s) ** 2)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Batches of whole nodes, with the nodes' numbers, of rows that come sorted by node."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        if kept[0].column("node")[0].as_py() == b.column("node")[-1].as_py():
            continue
        t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        node = np.array(t.column("node"))
        whole = int(np.flatnonzero(node != node[-1])[-1]) + 1
        yield node[:whole], t.slice(0, whole)
        kept = [t.slice(whole)]
    if kept:
        t = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        yield np.array(t.column("node")), t


def _runs(node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's rows begin, and how many they are."""
    cut = np.flatnonzero(np.diff(node)) + 1
    return np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(node)]]))


def _few(starts: np.ndarray, sizes: np.ndarray, s: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs that agree in ``least`` values within nodes of 2 to 8 rows, many nodes at once."""
    for m in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):
        i, j = np.triu_indices(m, 1)
        at = starts[sizes == m][:, None]
        p, q = (at + i).ravel(), (at + j).ravel()
        for lo in range(0, len(p), 8192):
            near = (s[p[lo : lo + 8192]] == s[q[lo : lo + 8192]]).sum(axis=1) >= least
            yield p[lo : lo + 8192][near], q[lo : lo + 8192][near]


def _visit(level: int, threshold: float):
    """Small nodes, and those of which the sketches are on average as alike as ``threshold``, give edges
    ``(a, b)``; other nodes give their children ``(node, a)``. Rows come sorted by node."""
    least = _least(threshold)

    def groups(node: np.ndarray, keys: pa.Array, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, sizes = _runs(node)
        names, of = [], []
        found = list(_few(starts, sizes, s, least))
        for at, m in zip(starts[sizes > 8], sizes[sizes > 8]):
            part = s[at : at + m]
            if m > SMALL and level < DEPTH and _likeness(part) < threshold:
                child, row = _children(level, DEEPER, node[at : at + m].view(np.uint64), part)
                names.append(child.view(np.int64))
                of.append(at + row)
            elif pairs := _compare(part, least):
                p, q = np.array(pairs).T
                found.append((at + p, at + q))
        if found:
            p, q = (np.concatenate(x) for x in zip(*found))
            yield pa.record_batch([pa.nulls(len(p), pa.int64()), keys.take(pa.array(p)), keys.take(pa.array(q))], names=["node", "a", "b"])
        if of:
            yield pa.record_batch([pa.array(np.concatenate(names)), keys.take(pa.array(np.concatenate(of))), pa.nulls(sum(map(len, of)), pa.binary())], names=["node", "a", "b"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, b in _whole(batches):
            yield from groups(node, b.column("key"), _rows(b.column("sketch")))

    return run


def _pass(level: int, threshold: float):
    """Rows of big nodes, in any order, each with its node's pivots: edges to the pivots that a row agrees with, and
    its children unless a pivot is very near. No node is gathered."""
    least = _least(threshold)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 2048) for at in range(0, whole.num_rows, 2048)):
                s, keys, lists = _rows(b.column("sketch")), b.column("key"), b.column("pivots")
                n = b.num_rows
                pivot, sketch = lists.flatten().field("key"), _rows(lists.flatten().field("sketch"))
                sizes = np.array(lists.value_lengths())
                row = np.repeat(np.arange(n), sizes)
                agree = (s[row] == sketch).sum(axis=1)
                hit = np.flatnonzero(agree >= least)
                if len(hit):
                    yield pa.record_batch([pa.nulls(len(hit), pa.int64()), keys.take(pa.array(row[hit])), pivot.take(pa.array(hit))], names=["node", "a", "b"])
                if level < DEPTH:
                    other = np.array(keys.take(pa.array(row)).to_pylist(), object) != np.array(pivot.to_pylist(), object)
                    near = np.bincount(row, weights=other & (agree >= SIZE * NEAR), minlength=n) > 0
                    own = np.bincount(row, weights=~other, minlength=n) > 0  # a pivot goes on and stands for those near it
                    on = np.flatnonzero(own | ~near)
                    if len(on):
                        child, of = _children(level, DEEPER, np.array(b.column("node"))[on].view(np.uint64), s[on])
                        yield pa.record_batch([pa.array(child.view(np.int64)), keys.take(pa.array(on[of])), pa.nulls(len(of), pa.binary())], names=["node", "a", "b"])

    return run


def chosen_path_edges(nodes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """Edges ``(a, b)`` between the keys of ``nodes (key, sketch)`` found to agree in ``threshold`` of the values; not
    between all that do: see ``near_roots``.

    Every tree starts with all sketches in one node, and a node branches by the minwise values at the
    coordinates which its path picks, 1 + BRANCH on average. From depth FIRST on, nodes of one sketch are
    dropped; nodes of at most SMALL, and those filled with near copies, which no branching would part, are
    compared exhaustively and give a spanning forest; the others branch again. A level costs one count of
    small rows and one shuffle of the sketches in nodes of two or more.

    Nodes of more than BIG sketches are never gathered: their rows are compared with PIVOTS of them, go on to
    their children one by one, and stop where they are linked to a pivot at NEAR. What such a row is like only
    just is then found by way of the pivot, which goes on, or in another node or tree.
    """
    rows = nodes.select("key", "sketch").mapInArrow(_roots(trees), "node long, key binary")
    done: list[DataFrame] = []
    for level in range(FIRST, DEPTH + 1):
        rows = settle(rows, "paths")
        shared = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = rows.join(shared.where(F.col("n") <= BIG), "node", "left_semi").join(nodes, "key").repartition("node").sortWithinPartitions("node")
        met = met.select("node", "key", "sketch").mapInArrow(_visit(level, threshold), "node long, a binary, b binary")
        big = settle(shared.where(F.col("n") > BIG), "big")
        if not big.isEmpty():
            large = rows.join(big, "node", "left_semi")
            rank = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("key", "node"), "key"))
            pivots = large.select("node", "key", rank.alias("k")).where(F.col("k") <= PIVOTS).join(nodes, "key")
            pivots = pivots.groupBy("node").agg(F.collect_list(F.struct("key", "sketch")).alias("pivots"))  # PIVOTS of each
            sent = large.join(nodes, "key").join(pivots, "node").select("node", "key", "sketch", "pivots")
            met = met.union(sent.mapInArrow(_pass(level, threshold), "node long, a binary, b binary"))
        met = settle(met, "visited")
        done.append(met.where("b is not null").select("a", "b"))
        rows = met.where("node is not null").select("node", F.col("a").alias("key"))
        if rows.isEmpty():
            break
    edges = done[0]
    for d in done[1:]:
        edges = edges.union(d)
    return edges


def signatures(least: int) -> np.ndarray:
    """Sets of SHARED coordinates, one a row: two sketches that agree in ``least`` values agree in all of some set.

    The coordinates are cut into parts of which all subsets are taken. A pair that has no subset of a part in common
    differs in all of its n coordinates but SHARED - 1; the parts are so few, and as many are taken, that this
    adds up to more than SIZE - ``least``.
    """
    if least < SHARED:
        raise ValueError(f"a threshold of {least} of {SIZE} values is too low for signatures of {SHARED}")
    sets, differ = [], 0
    for part in np.array_split(np.arange(SIZE), min((least - 1) // (SHARED - 1), SIZE // SHARED)):
        if differ > SIZE - least:
            break
        sets += combinations(part, SHARED)
        differ += len(part) - SHARED + 1
    return np.array(sets)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 64-bit integers, all lowest ones first: most of the high ones are 0 and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _sign(sets: np.ndarray, buckets: int):
    """``(node, blob)``: the signatures of the rows, parted into ``buckets`` by their hashes; a blob holds 32 more bits of
    each hash, then the rows' numbers and in what those of their groups differ from them, byte by byte."""
    salt = mix(np.arange(1, len(sets) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32  # 16 bits are sorted by their digits

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(at, 8192) for at in range(0, whole.num_rows, 8192)):
                s, ids = _rows(b.column("sketch")), np.array(b.column("id"))
                other = ids ^ np.array(b.column("grp"))
                h = np.empty((len(sets), len(s)), np.uint64)
                for k, cols in enumerate(sets):
                    h[k] = mix(np.ascontiguousarray(s[:, cols]).view(np.uint32).ravel().astype(np.uint64) ^ salt[k])
                h = h.ravel()
                low = (h & np.uint64(buckets - 1)).astype(kind)
                order = np.argsort(low, kind="stable")
                low, h = low[order], (h[order] >> np.uint64(32)).astype(np.uint32)
                row = order % len(s)
                starts, sizes = _runs(low)
                blobs, names, held = [], [], 0
                for at, m in zip(starts, sizes):
                    r = row[at : at + m]
                    blobs.append(h[at : at + m].tobytes() + _planes(ids[r]) + _planes(other[r]))
                    names.append(int(low[at]))
                    held += len(blobs[-1])
                    if held > 4 << 20 or at + m == len(low):
                        yield pa.record_batch([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "blob"])
                        blobs, names, held = [], [], 0

    return run


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, numbers and groups in order of the hashes."""
    h, ids, grp = [], [], []
    for blob in blobs:
        m = len(blob) // 20
        h.append(np.frombuffer(blob, np.uint32, m))
        two = np.frombuffer(blob, np.uint8, 16 * m, 4 * m).reshape(2, 8, m)
        n, x = (np.ascontiguousarray(two[k].T).view(np.int64).ravel() for k in range(2))
        ids.append(n)
        grp.append(n ^ x)
    h = np.concatenate(h)
    order = np.argsort(h)
    return h[order], np.concatenate(ids)[order], np.concatenate(grp)[order]


@lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of numbers ``(a, b)`` of different groups that have a signature in common, of blobs that come sorted
    by bucket. Where these are more than MANY, each row ``a`` and its group ``b`` under the signature's name ``g``."""
    for node, b in _whole(batches):
        for lo, k in zip(*_runs(node)):
            h, ids, grp = _unpack(b.column("blob").slice(lo, k).to_pylist())
            starts, sizes = _runs(h)
            mixed = np.minimum.reduceat(grp, starts) != np.maximum.reduceat(grp, starts)
            starts, sizes = starts[mixed], sizes[mixed]
            p, q, hot, names = [], [], [], []
            for m in np.unique(sizes[sizes <= 8]):
                i, j = np.triu_indices(m, 1)
                at = starts[sizes == m][:, None]
                p.append((at + i).ravel())
                q.append((at + j).ravel())
            for at, m in zip(starts[sizes > 8], sizes[sizes > 8]):
                own = np.unique(grp[at : at + m], return_counts=True)[1]
                if (m * m - (own * own).sum()) // 2 > MANY:
                    hot.append(np.arange(at, at + m))
                    names.append(np.full(m, (int(h[at]) << 31) ^ int(node[lo]), np.int64))
                else:
                    i, j = np.triu_indices(m, 1)
                    p.append(at + i)
                    q.append(at + j)
            if p:
                p, q = np.concatenate(p), np.concatenate(q)
                apart = grp[p] != grp[q]
                p, q = ids[p[apart]], ids[q[apart]]
                pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=["a", "b", "g"])
            if hot:
                at = np.concatenate(hot)
                yield pa.record_batch([pa.array(ids[at]), pa.array(grp[at]), pa.array(np.concatenate(names))], names=["a", "b", "g"])


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many values each row of ``x`` agrees with each of ``y``."""
    out = np.zeros((len(x), len(y)), np.uint16)
    same = np.empty(out.shape, bool)
    for lo in range(0, SIZE, 128):
        part = np.zeros(out.shape, np.uint8)
        for u, v in zip(x[:, lo : lo + 128].T.copy(), y[:, lo : lo + 128].T.copy()):
            np.equal(u[:, None], v[None], out=same)
            np.add(part, same.view(np.uint8), out=part)
        out += part
    return out


def _distinct(p: list[np.ndarray], q: list[np.ndarray]) -> pa.RecordBatch:
    p, q = np.concatenate([np.zeros(0, np.int64), *p]), np.concatenate([np.zeros(0, np.int64), *q])
    pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], axis=1), axis=0)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _verify(least: int):
    """Groups ``(a, b)`` of the pairs of rows that agree in ``least`` values."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_rows(b.column("sketch_a")) == _rows(b.column("sketch_b"))).sum(axis=1) >= least
                yield _distinct([np.array(b.column("grp_a"))[near]], [np.array(b.column("grp_b"))[near]])

    return run


def _verify_tiles(least: int):
    """Different groups ``(a, b)`` of rows that agree in ``least`` values, of rows that come sorted by tile; in a tile of
    two parts, only rows of both."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, b in _whole(batches):
            s, grp, second = _rows(b.column("sketch")), np.array(b.column("grp")), np.array(b.column("second"))
            for at, m in zip(*_runs(node)):
                i, j = at + np.flatnonzero(~second[at : at + m]), at + np.flatnonzero(second[at : at + m])
                j = j if len(j) else i
                p, q = [], []
                for lo in range(0, len(i), 128):
                    own = i[lo : lo + 128]
                    for to in range(0, len(j), 1024):
                        others = j[to : to + 1024]
                        apart = grp[own][:, None] != grp[others][None]
                        if apart.any():
                            u, v = np.nonzero(apart & (_agree(s[own], s[others]) >= least))
                            p.append(grp[own[u]])
                            q.append(grp[others[v]])
                yield _distinct(p, q)

    return run


def missed_links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(a, b)``: all pairs of groups of ``rows (id, grp, sketch)`` that hold two sketches which agree in ``threshold`` of
    the values. Exact: such sketches have a signature in common (see ``signatures``).

    Signatures are shuffled with two numbers each and without sketches. Rows of one group aren't paired, so that
    a large group costs its size. Where many groups share a signature, its rows are cut into parts of PART and these
    compared with each other, which grows with the square of these rows, but is held by no task and gives no row
    that isn't a link.
    """
    least = _least(threshold)
    sets = signatures(least)
    buckets = 1 << max(4, (rows.count() * len(sets) // BUCKET).bit_length())
    signed = rows.mapInArrow(_sign(sets, buckets), "node long, blob binary")
    met = settle(signed.repartitionById(buckets, F.col("node").cast("int")).sortWithinPartitions("node").mapInArrow(_meet, "a long, b long, g long"), "met")
    one, two = ([F.col("id").alias(c), F.col("grp").alias(f"grp_{c}"), F.col("sketch").alias(f"sketch_{c}")] for c in "ab")
    pairs = met.where("g is null").select("a", "b").distinct().join(rows.select(*one), "a").join(rows.select(*two), "b")
    found = pairs.select("grp_a", "sketch_a", "grp_b", "sketch_b").mapInArrow(_verify(least), "a long, b long")
    hot = met.where("g is not null")
    if not hot.isEmpty():
        rank = F.row_number().over(Window.partitionBy("g").orderBy("b", "a"))
        hot = settle(hot.select("g", F.col("a").alias("id"), F.col("b").alias("grp"), F.floor((rank - 1) / PART).alias("own")), "hot")
        ends = hot.groupBy("g", "own").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        i, j = (ends.select("g", F.col("own").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}")) for c in "ij")
        tiles = i.join(j, "g").where("i <= j AND NOT (lo_i = hi_j)").select("g", "i", "j")  # parts are in order of groups
        first = hot.join(tiles.withColumn("own", F.col("i")), ["g", "own"]).withColumn("second", F.lit(False))
        second = hot.join(tiles.where("i < j").withColumn("own", F.col("j")), ["g", "own"]).withColumn("second", F.lit(True))
        sent = first.unionByName(second).join(rows.select("id", "sketch"), "id")
        sent = sent.select(F.xxhash64("g", "i", "j").alias("node"), "grp", "sketch", "second")
        found = found.union(sent.repartition("node").sortWithinPartitions("node").mapInArrow(_verify_tiles(least), "a long, b long"))
    return found.distinct()


def near_roots(nodes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """``(key, root)`` of the keys of ``nodes (key, sketch)`` that are like another one: the components of all pairs that
    agree in ``threshold`` of the values. Chosen paths find most of them and make the groups between which
    ``missed_links`` has to look."""
    roots = settle(components(chosen_path_edges(nodes, threshold, trees)), "roots")
    roots = roots.select(F.col("node").alias("key"), "root")
    ids = settle(nodes.select("key", F.monotonically_increasing_id().alias("id")), "numbers")
    grp = roots.join(ids.select(F.col("key").alias("root"), F.col("id").alias("grp")), "root").select("key", "grp")
    rows = nodes.join(ids, "key").join(grp, "key", "left").select("id", F.coalesce("grp", "id").alias("grp"), "sketch")
    links = settle(missed_links(settle(rows, "numbered"), threshold), "links")
    if links.isEmpty():
        return roots
    for c in "ab":
        links = links.join(ids.select(F.col("id").alias(c), F.col("key").alias(f"key_{c}")), c)
    merged = settle(components(links, "key_a", "key_b"), "merged").select(F.col("node").alias("was"), F.col("root").alias("now"))
    known = roots.join(merged, F.col("root") == F.col("was"), "left").select("key", F.coalesce("now", "root").alias("root"))
    alone = merged.join(roots.select(F.col("key").alias("was")), "was", "left_anti").select(F.col("was").alias("key"), F.col("now").alias("root"))
    return settle(known.union(alone), "roots")


def _count(threshold: float):
    """``(key, n)`` of rows that come sorted by tile: how many others of its tile each agrees with; in a tile of two
    parts, only those of the other part."""
    least = _least(threshold)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, b in _whole(batches):
            s, second = _rows(b.column("sketch")), np.array(b.column("second"))
            n = np.zeros(len(node), np.int64)
            starts, sizes = _runs(node)
            mixed = np.add.reduceat(second.astype(np.int64), starts) > 0
            for p, q in _few(starts[~mixed], sizes[~mixed], s, least):
                np.add.at(n, p, 1)
                np.add.at(n, q, 1)
            for at, m, two in zip(starts, sizes, mixed):
                if m > 8 and not two:
                    part = s[at : at + m]
                    for lo in range(0, m, 64):
                        n[at + lo : at + min(m, lo + 64)] += ((part[lo : lo + 64, None] == part[None]).sum(axis=2) >= least).sum(axis=1) - 1
                elif two:
                    i, j = at + np.flatnonzero(~second[at : at + m]), at + np.flatnonzero(second[at : at + m])
                    for lo in range(0, len(i), 64):
                        near = (s[i[lo : lo + 64], None] == s[j][None]).sum(axis=2) >= least
                        n[i[lo : lo + 64]] += near.sum(axis=1)
                        n[j] += near.sum(axis=0)
            some = np.flatnonzero(n)
            yield pa.record_batch([b.column("key").take(pa.array(some)), pa.array(n[some])], names=["key", "n"])

    return run


def link_counts(nodes: DataFrame, roots: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(key, links)`` of the keys of ``roots (key, root)`` that have any: how many other sketches of its group each
    agrees with in ``threshold``, counted over all pairs of the group. The sketches of a large group are spread
    over tiles of TILE by TILE, so that no task holds a group and no pair is written."""
    size = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.col("size") / TILE).cast("long")
    rows = roots.join(size, "root").select("key", "root", parts.alias("parts")).withColumn("own", F.pmod(F.xxhash64("key"), "parts"))
    rows = rows.join(nodes, "key").select("key", "sketch", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    tile = F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(tile.alias("node"), "key", "sketch", (F.col("own") > F.col("other")).alias("second"))
    counted = rows.repartition("node").sortWithinPartitions("node").mapInArrow(_count(threshold), "key binary, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("links"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, trees: int = TREES, links: bool = False) -> DataFrame:
    """``(doc_id, row, group_id, group_row, keep, copies)``, one row for each distinct (id, text); with ``links`` also
    the number of other sketches that the row's agrees with in ``threshold``.

    ``row`` stands for the (id, text) in 16 bytes, ``copies`` counts the rows that have them, and
    ``group_id, group_row`` name the row that its group keeps. Groups are the connected components of the
    pairs of which the sketches agree in ``threshold``, and of all of them; each keeps the row of the least id (ties: the least
    key; a null id comes last). Equal texts are one sketch and no link. Texts without a word go only with equal
    texts; a row of null text is alone; very long texts are sketched whole. Other columns of ``docs`` may have any
    names and don't matter; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    src = src.select("doc_id", "text", row_key("doc_id", "text").alias("row"))
    sk = settle(src.mapInArrow(_sketches, f"doc_id {kind}, row binary, some boolean, key binary, sketch binary"), "sketches")
    nodes = settle(sk.where("some").groupBy("key").agg(F.first("sketch").alias("sketch")), "nodes")
    roots = near_roots(nodes, threshold, trees)
    rows = sk.groupBy("doc_id", "row", "key").agg(F.count(F.lit(1)).alias("copies"))
    more = []
    if links:
        roots = roots.join(link_counts(nodes, roots, threshold), "key", "left")
        more = [F.coalesce("links", F.lit(0).cast("long")).alias("links")]
    rows = settle(rows.join(roots, "key", "left").select("doc_id", "row", "copies", F.coalesce("root", "key").alias("grp"), *more), "rows")
    kept = rows.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"))
    more = ["links"] if links else []
    return rows.join(kept, "grp").select("doc_id", "row", F.col("kept.doc_id").alias("group_id"), F.col("kept.row").alias("group_row"), (F.col("row") == F.col("kept.row")).alias("keep"), "copies", *more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, group_id, keep, links)`` for each distinct (id, text): a document of which ``group_id`` is its own
    id is alone or the kept one of its group; ``links`` counts the other texts that are like it. Odd rows: see
    ``near_groups``."""
    return near_groups(docs, id_col, text_col, threshold, links=True).select("doc_id", "group_id", "keep", "links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they were. Of repeated rows of equal
    id and text one stays. The texts are shuffled once, by row key, for the join and the choice among repeats.
    Odd rows: see ``near_groups``; other columns, whatever their names, stay."""
    key, rank = fresh(docs, "row_key"), fresh(docs, "row_rank")
    kept = near_groups(docs, id_col, text_col, threshold).where("keep").select(F.col("row").alias(key))
    rows = docs.withColumn(key, row_key(id_col, text_col)).join(kept, key)
    first = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return rows.withColumn(rank, first).where(F.col(rank) == 1).drop(key, rank)
