"""Exact nearest vectors and near copies of vectors against all pairs."""

import numpy as np
import pytest

from lodestrata.llm import egojoin, queries, topk

from ..conftest import DATA, spark_rows, sql_rows


@pytest.mark.parametrize("name", ["op1_exact_top_k", "op7_embedding_near_dedup"])
def test_query_has_the_rows_of_its_sql(spark, name):
    names, rows = sql_rows(queries.ORACLES[name], "sf0.001")
    df = queries.QUERIES[name](spark, str(DATA / "sf0.001"))
    assert sorted(df.columns) == names and spark_rows(df) == rows


def some_vectors(n=900, d=12, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 4 * rng.normal(size=(6, d))[rng.integers(0, 6, n)]
    x[n // 2 : n // 2 + 60] = x[:60] * rng.uniform(0.1, 9, (60, 1))  # the same directions
    x[-40:] = x[0]
    return x


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<double>")


@pytest.fixture(params=[64, 2048])
def small_blocks(request, monkeypatch):
    from lodestrata.llm import vectors

    monkeypatch.setattr(topk, "BLOCK", request.param)
    monkeypatch.setattr(topk, "SLICE", 5)
    monkeypatch.setattr(topk, "TILE", 4)
    monkeypatch.setattr(topk, "QUERIES", 100)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", request.param * 12 * 8)


def test_top_k_is_exact_with_ties(spark, small_blocks):
    x = some_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    got = {}
    for r in topk.top_k(frame(spark, x), k=5).collect():
        got.setdefault(r.vec_id, {})[r.rank] = (r.similarity, r.neighbor_id)
    assert set(got) == set(range(len(x)))
    for i, ranked in got.items():
        want = sorted((-v, j) for j, v in enumerate(s[i]))[:5]
        assert sorted(ranked) == [1, 2, 3, 4, 5]
        assert np.allclose([ranked[k + 1][0] for k in range(5)], [-w[0] for w in want], atol=2e-9)
        if len({round(w[0], 7) for w in want}) == 5:
            assert [ranked[k + 1][1] for k in range(5)] == [w[1] for w in want]


def test_only_the_queries_are_answered_from_all_rows(spark):
    x = some_vectors(300)
    df = frame(spark, x)
    every = {(r.vec_id, r.rank): (r.neighbor_id, r.similarity) for r in topk.top_k(df, k=4).collect()}
    some = {(r.vec_id, r.rank): (r.neighbor_id, r.similarity) for r in topk.top_k(df, k=4, queries=df.vec_id % 20 == 0).collect()}
    assert some == {k: v for k, v in every.items() if k[0] % 20 == 0} and len(some) == 60
    assert topk.top_k(df, queries=df.vec_id < 0).count() == 0


def searched(x, q, k, basis):
    """Share of the rows that a search of one block scores, and the results."""
    by, cuts, high, low = topk.sort_block(x, basis)
    best = topk.Best(x[q], [int(i) for i in q], k, basis)
    best.feed(topk.Lists([int(i) for i in by], x[by], cuts, high, low))
    for i, found in zip(q, best.found):
        s = np.round(x @ x[i], 9)
        s[i] = -9
        assert [-v for v, _ in found] == sorted(s, reverse=True)[:k]
    return best.scored / (len(q) * len(x))


def test_the_threshold_stops_early():
    rng = np.random.default_rng(0)
    x = 0.06 * rng.normal(size=(4096, 32))
    x[:, :4] += rng.normal(size=(4096, 4))  # most of it lies in four dimensions
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:3] = np.eye(32)[:3]  # along one dimension its list alone gives the best
    assert searched(x, np.arange(3), 3, np.eye(32)[:, :16]) < 0.1


def test_no_vector_within_the_bounds_scores_more_than_the_threshold():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.abs(rng.normal(size=(1, 6)))
        a /= np.linalg.norm(a)
        u = rng.normal(size=(1, 6)) * 0.5
        y = np.minimum(rng.normal(size=(20_000, 6)) * 0.4, u)
        y = y[(y * y).sum(axis=1) <= 1]
        assert (y @ a[0]).max(initial=-9) <= topk.threshold(a, u)[0] + 1e-12
    assert np.isclose(topk.threshold(np.array([[0.6, 0.8]]), np.array([[1.0, 1.0]])), 1)
    assert np.isclose(topk.threshold(np.array([[0.6, 0.8]]), np.array([[1.0, 0.5]])), 0.6 * 0.75**0.5 + 0.4, atol=1e-3)


def test_no_threshold_helps_where_no_direction_stands_out():
    """The table's own vectors fill all 64 dimensions alike; the search is exact and scores nearly all."""
    import pyarrow.parquet as pq

    t = pq.read_table(str(DATA / "sf0.01/embeddings.parquet"))["embedding"].combine_chunks()
    x = np.array(t.flatten(), dtype=np.float64).reshape(len(t), -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    basis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :16]
    assert searched(x, np.arange(0, len(x), 20), 10, basis) > 0.9


@pytest.mark.parametrize("d", [1, 3, 64, 1500])
def test_the_slack_covers_float32(d):
    rng = np.random.default_rng(d)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(2, 200, d)))
    off = np.abs((x.astype(np.float32) @ y.astype(np.float32).T).astype(float) - x @ y.T).max()
    assert off < topk.slack(d)


def test_distant_blocks_are_skipped():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4096, 8)) * np.array([4, 3, 2, 1, 1, 1, 1, 1])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = np.floor(x / 0.245)
    x = x[np.lexsort(cells.T[::-1])]
    j = egojoin.Join(x, x, x, x, True, 0.06, 0.97)
    near = np.triu(x @ x.T >= 0.97, 1)
    assert (j.links + j.linked == near.sum(0) + near.sum(1)).all()
    assert j.compared < 0.3 * len(x) ** 2


def test_near_copies_are_the_components_of_all_pairs(spark, small_blocks):
    x = some_vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    group = np.arange(len(x))
    while True:
        new = np.array([group[r].min() for r in near])
        if (new == group).all():
            break
        group = new
    got = egojoin.near_vectors(frame(spark, x), similarity=0.9).collect()
    assert {r.vec_id: r.group_id for r in got} == dict(enumerate(group.tolist()))
    assert all(r.keep == (r.vec_id == r.group_id) for r in got)
    other = near & ~(x[:, None, :] == x[None, :, :]).all(-1)
    distinct = [len({tuple(x[j]) for j in np.flatnonzero(other[i])}) for i in range(len(x))]
    assert [r.links for r in sorted(got, key=lambda r: r.vec_id)] == distinct


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (9, [1e300, 1e-300]), (10, [0.0, -1.0]), (11, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id int, embedding array<double>, block string, v int, id int")
    got = {r.vec_id: (r.group_id, r.keep, r.links) for r in egojoin.near_vectors(df).collect()}
    assert got == {i: (i, True, 0) for i in range(1, 12)} | {1: (1, True, 2), 2: (1, False, 2), 9: (1, False, 2)}
    top = {}
    for r in topk.top_k(df).collect():
        top.setdefault(r.vec_id, []).append((r.rank, r.neighbor_id, r.similarity))
    assert {i: sorted(t) for i, t in top.items()} == {
        1: [(1, 2, 1.0), (2, 9, 1.0), (3, 10, 0.0)],
        2: [(1, 1, 1.0), (2, 9, 1.0), (3, 10, 0.0)],
        9: [(1, 1, 1.0), (2, 2, 1.0), (3, 10, 0.0)],
        10: [(1, 1, 0.0), (2, 2, 0.0), (3, 9, 0.0)],
    }
    assert egojoin.near_vectors(df.where("false")).count() == 0 and topk.top_k(df.where("false")).count() == 0
    assert egojoin.near_vectors(df.where("vec_id = 3")).collect()[0].keep and topk.top_k(df.where("vec_id = 3")).count() == 0


def test_an_id_of_several_vectors_links_their_groups(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.0])], "vec_id int, embedding array<float>")
    got = {r.vec_id: (r.group_id, r.links) for r in egojoin.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1), 5: (5, 0)}


def test_one_vector_for_each_repeated_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.2])], "vec_id int, embedding array<double>")
    got = [(r.vec_id, r.rank, r.neighbor_id) for r in topk.top_k(df).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]  # the least vector of id 1 is [0, 1]
