"""Near-duplicate search against all pairs."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import neardup
from lodestrata.llm.components import components

from ..conftest import DATA


def shingle_set(text):
    import re

    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + neardup.WIDTH]) for i in range(max(1, len(w) - neardup.WIDTH + 1))} if w else set()


@pytest.fixture(scope="module")
def found(spark):
    return neardup.near_duplicates(spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))).collect()


def test_recall_and_precision_against_all_pairs(spark, found):
    docs = {r.doc_id: shingle_set(r.text) for r in spark.read.parquet(str(DATA / "sf0.01/documents.parquet")).collect()}
    group = {r.doc_id: r.group_id for r in found}
    assert set(group) == set(docs)
    close, linked = [], defaultdict(list)
    for a, b in combinations(sorted(docs), 2):
        both = len(docs[a] & docs[b])
        j = both / max(1, len(docs[a]) + len(docs[b]) - both)
        if j >= neardup.THRESHOLD + 0.05:
            close.append((a, b))
        if j >= neardup.THRESHOLD - 0.15:
            linked[a].append(b)
            linked[b].append(a)
    assert close
    assert sum(group[a] == group[b] for a, b in close) >= 0.9 * len(close)
    for d, g in group.items():  # whoever is in a group is like another member of it
        if g != d:
            assert any(group[o] == g for o in linked[d]), d


def test_one_of_each_group_is_kept(found):
    kept = defaultdict(list)
    for r in found:
        assert r.keep == (r.doc_id == r.group_id)
        kept[r.group_id].append(r.keep)
    assert all(sum(k) == 1 for k in kept.values())


def test_large_groups_and_ties(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{base} end{i % 3}") for i in range(700)] + [(10_000 + i, " ".join(f"other{i}x{j}" for j in range(30))) for i in range(300)]
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(700))
    assert all(got[10_000 + i] == 10_000 + i for i in range(300))


def test_links_are_those_of_all_pairs_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (3, neardup.SIZE)).astype(np.uint8)
    s = base[rng.integers(0, 3, 150)]
    s = np.where(rng.random(s.shape) < rng.random((150, 1)) * 0.45, rng.integers(0, 256, s.shape), s).astype(np.uint8)
    rows = [(k.to_bytes(16, "big"), bytearray(r.tobytes())) for k, r in enumerate(s)]
    nodes = spark.createDataFrame(rows, "key binary, sketch binary")
    agree = (s[:, None] == s[None]).sum(axis=2) >= neardup._least(neardup.THRESHOLD)
    np.fill_diagonal(agree, False)
    pairs = spark.createDataFrame([(rows[i][0], rows[j][0]) for i, j in np.argwhere(agree)], "a binary, b binary")
    roots = components(pairs).withColumnRenamed("node", "key")
    got = {int.from_bytes(r.key, "big"): r.links for r in neardup.link_counts(nodes, roots).collect()}
    assert got == {k: int(n) for k, n in enumerate(agree.sum(axis=1)) if n}
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(80)) + f" e{i % 4}") for i in range(20)] + [(50, "alone here")], "doc_id long, text string")
    assert {r.doc_id: r.links for r in neardup.near_duplicates(docs).collect()} == {i: 3 for i in range(20)} | {50: 0}


def test_big_nodes_are_not_gathered_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BIG", 40)
    base = " ".join(f"word{i}" for i in range(60))
    rng = np.random.default_rng(1)
    rows = [(i, f"{base} end{i} and {rng.integers(9)}") for i in range(600)]  # near copies, all different
    rows += [(1_000 + i, f"{base} " + " ".join(f"other{i // 2}x{j}" for j in range(90))) for i in range(400)]  # pairs that share a passage
    got = {r.doc_id: r.group_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(600))
    assert all(got[1_000 + i] == 1_000 + i // 2 * 2 for i in range(400))


def test_recall_at_the_threshold_under_a_shared_passage(spark):
    """6,000 sketches of which each has 65 % of its values from one passage: nodes stay large down to depth 8."""
    rng = np.random.default_rng(5)
    n, pairs = 6_000, 1_500  # the even pairs agree in 0.605, the odd ones in 0.65

    def drawn(rows, passage):
        return np.where(rng.random((rows, neardup.SIZE)) < 0.65, passage, rng.integers(0, 256, (rows, neardup.SIZE))).astype(np.uint8)

    passage = rng.integers(0, 256, neardup.SIZE)
    s = drawn(n, passage)
    for k in range(pairs):
        other = rng.permutation(neardup.SIZE)[: int(neardup.SIZE * (0.35 if k % 2 else 0.395))]
        s[pairs + k] = s[k]
        v = drawn(1, passage)[0][other]
        s[pairs + k, other] = np.where(v == s[k, other], v + np.uint8(1), v)
    nodes = spark.createDataFrame([(k.to_bytes(16, "big"), bytearray(r.tobytes())) for k, r in enumerate(s)], "key binary, sketch binary")
    root = {int.from_bytes(r.node, "big"): r.root for r in components(neardup.chosen_path_edges(nodes)).collect()}
    found = np.array([k in root and root[k] == root.get(pairs + k) for k in range(pairs)])
    assert found[::2].mean() >= 0.93 and found[1::2].mean() >= 0.97, (found[::2].mean(), found[1::2].mean())
    assert not set(root) & set(range(2 * pairs, n))  # the rest have only the passage in common


def roots_of_all_pairs(s):
    """The first row of each row's component, and how many rows each row is like, from all pairs."""
    like = (neardup._agree(s, s) >= neardup._least(neardup.THRESHOLD)) & ~np.eye(len(s), dtype=bool)
    root = np.arange(len(s))
    while True:
        low = np.minimum(root, np.where(like, root[None], len(s)).min(axis=1))
        if (low == root).all():
            return root, like.sum(axis=1)
        root = low


def pairs_at_the_threshold():
    """1,500 pairs of texts, each like nothing else, that agree in about the threshold: a miss leaves both alone."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(1_500):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 120)]
        rows += [(2 * k, " ".join(w[:80])), (2 * k + 1, " ".join(w[: 58 + k % 5] + w[98 + k % 5 :]))]
    s, _ = neardup.sketch_array(pa.array([t for _, t in rows]))
    root, links = roots_of_all_pairs(s)
    assert 500 < links.sum() / 2 < 1_400
    return rows, root, links


def test_no_pair_at_the_threshold_is_missed(spark):
    rows, root, links = pairs_at_the_threshold()
    got = {r.doc_id: (r.group_id, r.links) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (root[k], links[k]) for k in range(len(rows))}


def test_signatures_that_many_groups_share_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MANY", 2)
    monkeypatch.setattr(neardup, "PART", 16)
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 256, neardup.SIZE)
    s = np.where(rng.random((600, neardup.SIZE)) < 0.65, passage, rng.integers(0, 256, (600, neardup.SIZE))).astype(np.uint8)
    s[:100] = np.where(rng.random((100, neardup.SIZE)) < 0.9, s[0], s[:100])  # near copies
    for k in range(100, 300):  # pairs that agree in the least and in one value less
        differ = rng.permutation(neardup.SIZE)[: neardup.SIZE - neardup._least(neardup.THRESHOLD) + k % 2]
        s[k + 200] = s[k]
        s[k + 200, differ] += rng.integers(1, 256, len(differ)).astype(np.uint8)
    nodes = spark.createDataFrame([(k.to_bytes(16, "big"), bytearray(r.tobytes())) for k, r in enumerate(s)], "key binary, sketch binary")
    root, links = roots_of_all_pairs(s)
    assert all(root[100:300] == np.arange(100, 300)) and all(root[300:500] == np.where(np.arange(200) % 2, np.arange(300, 500), np.arange(100, 300)))
    got = {int.from_bytes(r.key, "big"): int.from_bytes(r.root, "big") for r in neardup.near_roots(nodes, trees=1).collect()}
    assert got == {k: root[k] for k in range(600) if links[k]}


@pytest.mark.parametrize("least", [100, 154, 180, 200, 231, 256])
def test_sketches_that_agree_enough_share_a_signature(least):
    sets = neardup.signatures(least)
    parts = [np.unique(p) for p in _parts(sets)]
    differ = sum(len(p) - neardup.SHARED + 1 for p in parts)  # the least that a pair without a signature in common differs in
    assert len(np.unique(np.concatenate(parts))) == sum(map(len, parts)) and differ > neardup.SIZE - least


def _parts(sets):
    """Coordinates that are in sets together."""
    parts = []
    for s in map(set, sets.tolist()):
        if parts and parts[-1] & s:
            parts[-1] |= s
        else:
            parts.append(s)
    return [np.array(sorted(p)) for p in parts]


def test_odd_rows(odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs).collect()
    assert len(got) == 10  # distinct (id, text)
    group = defaultdict(set)
    for r in got:
        group[r.doc_id].add(r.group_id)
    assert group[7] == {6} and group[6] == {6} and group[5] == {5}
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (False, 6), (False, 2**60 + 1), (True, 0), (True, 0)]
    assert neardup.keep_one(no_docs).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 5)], "a int, b int")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert components(edges.where("false")).count() == 0
