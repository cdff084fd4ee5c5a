"""The index reader against what was written: round trips, boundaries, damage, and what planning prunes."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.functions import codec
from lodestrata.functions.codec import Corrupt, Cursor
from lodestrata.sources import segidx
from lodestrata.sources import segments as S
from lodestrata.sources import segwrite as W
from lodestrata.sources.segwrite import Field

FIELDS = [
    Field("id", stored="long", dv="numeric"),
    Field("text", options=3, norms=True, stored="string"),
    Field("tag", options=1, stored="string"),
    Field("price", dv="numeric", stored="int"),
    Field("few", dv="numeric"),
    Field("kind", dv="sorted"),
    Field("tags", dv="sorted_set"),
    Field("nums", dv="sorted_numeric"),
    Field("ratio", stored="double"),
    Field("single", stored="float"),
    Field("pt", points=8),
    Field("pt2", points=4, dims=2),
    Field("blob", dv="binary", stored="binary"),
]


def documents(n: int, seed: int = 1) -> list[dict]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(3 * n)]
    return [
        {
            "id": i,
            "text": " ".join(rng.choice(words) if rng.random() < 0.6 else "the" for _ in range(rng.randint(0, 60))),
            "tag": rng.choice(["x", "y"]),
            "price": rng.randint(-1000, 1000) * 10,
            "few": i * 7 if i % 40 == 0 else None,
            "kind": None if i % 11 == 0 else b"k%d" % rng.randint(0, 9),
            "tags": [b"t%d" % rng.randint(0, 30) for _ in range(rng.randint(0, 3))],
            "nums": [rng.randint(-5, 10**12) for _ in range(rng.randint(0, 3))],
            "ratio": rng.choice([rng.random(), float(rng.randint(-2, 130)), 0.5]),
            "single": rng.choice([1.0, 0.25, -3.5]),
            "pt": rng.randint(-(10**6), 10**6),
            "pt2": [rng.randint(0, 50), rng.randint(-50, 50)],
            "blob": None if i % 3 == 0 else rng.randbytes(rng.randint(0, 9)),
        }
        for i in range(n)
    ]


def put(folder, docs, fields=FIELDS, names=("_0",), **how) -> str:
    for name in names:
        for n, raw in W.segment(name, fields, docs, **how).items():
            (folder / n).write_bytes(raw)
    (folder / "segments_a").write_bytes(W.commit(list(names), user_data={"by": "test"}))
    return str(folder)


def opened(path, name="_0") -> S.Segment:
    return S.Segment(*S.open_path(path), name)


@pytest.mark.parametrize("compound", [False, True])
@pytest.mark.parametrize("sets", [None, S.ADDRESSES])
@pytest.mark.parametrize("n", [1, 130, 2_000])
def test_round_trip(tmp_path, compound, sets, n):
    docs = documents(n)
    g = opened(put(tmp_path, docs, compound=compound, sets=sets, leaf=64, chunk=2_000))
    assert g.size == n
    for name, c in g.all_files():
        S.header(c)
        assert S.footer(c)["ok"], name
    want = defaultdict(dict)
    for i, d in enumerate(docs):
        for w in W.tokens(d["text"]):
            want[w.encode()][i] = want[w.encode()].get(i, 0) + 1
    assert {t: dict(zip(a.tolist(), f.tolist())) for t, a, f in g.postings(1)} == want
    terms = list(g.terms(1))
    assert [t["term"] for t in terms] == sorted(want)
    assert all((t["doc_freq"], t["total_term_freq"]) == (len(want[t["term"]]), sum(want[t["term"]].values())) for t in terms)
    assert [f for _, _, f in g.postings(2)] == [None] * len({d["tag"] for d in docs})
    assert g.term_fields[2]["sum_total_term_freq"] == -1 and g.term_fields[1]["num_terms"] == len(want)
    got = defaultdict(dict)
    for r in g.stored([c["start_pointer"] for c in g.chunks()]):
        got[r["doc_id"]][r["field_name"]] = next(r[k] for k in ("str", "bin", "int", "float", "long", "double") if k in r)
    kept = [f.name for f in FIELDS if f.stored]
    assert dict(got) == {i: {k: d[k] for k in kept if d[k] is not None} for i, d in enumerate(docs)}
    for f in ("id", "price", "few"):
        assert {r["doc_id"]: r["long_value"] for r in g.dv_values(f)} == {i: d[f] for i, d in enumerate(docs) if d[f] is not None}
    for f in ("blob", "kind"):
        assert {r["doc_id"]: r["bin_value"] for r in g.dv_values(f)} == {i: d[f] for i, d in enumerate(docs) if d[f] is not None}
    for f, c in (("tags", "bin_value"), ("nums", "long_value")):
        many = defaultdict(list)
        for r in g.dv_values(f):
            assert r["ord"] == len(many[r["doc_id"]])
            many[r["doc_id"]].append(r[c])
        assert dict(many) == {i: sorted(set(d[f])) if f == "tags" else sorted(d[f]) for i, d in enumerate(docs) if d[f]}
    assert g.norms(1).tolist() == [len(W.tokens(d["text"])) for d in docs]
    for number, f in ((10, "pt"), (11, "pt2")):
        found = {}
        for _, ids, raw in g.points(number):
            for k, i in enumerate(ids):
                found[i] = [int.from_bytes(raw[k, d].tobytes(), "big") - (1 << 8 * raw.shape[2] - 1) for d in range(raw.shape[1])]
        assert found == {i: d[f] if f == "pt2" else [d[f]] for i, d in enumerate(docs)}
    assert len(g.leaves(g.tree(10, g.open(".dim")))) == g.tree(10, g.open(".dim"))["num_leaves"]


@pytest.mark.parametrize("df", [1, 2, 127, 128, 129, 256, 300])
def test_postings_at_block_boundaries(tmp_path, df):
    docs = [{"t": "a" if i % 3 else "a a b"} for i in range(df)]
    g = opened(put(tmp_path, docs, [Field("t", options=2)]))
    assert [a.tolist() for t, a, _ in g.postings(0) if t == b"a"] == [list(range(df))]
    assert [f.tolist() for t, _, f in g.postings(0) if t == b"a"] == [[1 if i % 3 else 2 for i in range(df)]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-(2**63) // 4, 2**63 // 4)), min_size=1, max_size=80))
def test_numbers_of_any_size(values):
    c = W._Columns()
    c.numbers(3, values)
    seg = S.Segment.__new__(S.Segment)
    e = seg._number_entry(Cursor(c.meta, len(W.head("dv-meta"))), 3)
    import io

    got, there = seg._numbers(S.Pages(io.BytesIO(c.data), 0, len(c.data)), e, len(values))
    assert [int(v) if t else None for v, t in zip(got, there)] == values


def test_number_formats(tmp_path):
    docs = [{"const": 5, "table": (i % 3) * 10**9, "gcd": i * 1_000, "delta": i * i, "sparse": 4 if i == 17 else None, "gone": None} for i in range(400)]
    fields = [Field(n, dv="numeric") for n in docs[0]]
    g = opened(put(tmp_path, docs, fields))
    assert [S._NUMBER_FORMATS[m["numeric"]["format"]] for m in g.dv_meta()] == ["CONST", "TABLE", "GCD", "DELTA", "SPARSE", "CONST"]
    for f in fields:
        assert [(r["doc_id"], r["long_value"]) for r in g.dv_values(f.name)] == [(i, d[f.name]) for i, d in enumerate(docs) if d[f.name] is not None]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 64), st.lists(st.integers(0, 2**64 - 1), max_size=70))
def test_packed_values_of_every_width(bits, values):
    values = [v & (1 << bits) - 1 for v in values]
    raw = codec.pack(values, bits, whole_words=False)
    assert codec.unpack(raw, len(values), bits).tolist() == values
    assert Cursor(raw).packed(len(values), bits) == values


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**63 - 1), st.integers(-(2**40), 2**40), st.floats(allow_nan=False), st.binary(max_size=600))
def test_scalars(v, t, x, raw):
    assert Cursor(codec.put_varied(v)).vlong() == v
    assert codec.unzigzag(codec.zigzag(t)) == t
    assert Cursor(codec.put_tlong(t)).tlong() == t
    if np.isfinite(x):
        assert Cursor(codec.put_zdouble(x)).zdouble() == x
    data = raw * 3
    assert codec.lz4_decode(Cursor(codec.lz4_encode(data)), len(data)) == data


def test_long_numbers_are_errors():
    with pytest.raises(Corrupt):
        Cursor(b"\xff" * 9).vlong()
    with pytest.raises(Corrupt):
        Cursor(b"ab").take(3)


@pytest.fixture(scope="module")
def index(tmp_path_factory):
    return put(tmp_path_factory.mktemp("index"), documents(300), names=("_0", "_1"), leaf=64)


@pytest.mark.parametrize("table", sorted(segidx.SCHEMAS))
def test_every_relation_can_be_read(spark, index, table):
    rows = segidx.read(spark, index, table)
    got = rows.collect()
    assert (len(got) > 0) == (table != "compound_entries")
    if "segment" in rows.columns and table != "compound_entries":
        assert {r.segment for r in got} == {"_0", "_1"}


def test_columns_and_filters(spark, index):
    p = segidx.read(spark, index, "postings")
    want = len({w for d in documents(300) for w in W.tokens(d["text"])})
    assert p.where("segment = '_1' AND field_name = 'text'").select("term").distinct().count() == want
    reader = segidx.SegmentReader(p.schema, {"path": index, "table": "postings"})
    assert len(reader.partitions()) == 4  # segments and fields
    assert list(reader.pushFilters([segidx.EqualTo(("segment",), "_1"), segidx.In(("field_name",), ("text", "no")), segidx.EqualTo(("doc_id",), 3)])) == [segidx.EqualTo(("doc_id",), 3)]
    assert [(q.segment, q.number) for q in reader.partitions()] == [("_1", 1)]


def test_damage(spark, tmp_path):
    path = put(tmp_path, documents(50))
    raw = bytearray((tmp_path / "_0.fnm").read_bytes())
    raw[60] ^= 0xFF
    (tmp_path / "_0.fnm").write_bytes(raw)
    bad = segidx.read(spark, path, "file_headers").where("NOT ok").collect()
    assert [r.file for r in bad] == ["_0.fnm"]
    (tmp_path / "_0.fnm").write_bytes(b"nonsense")
    with pytest.raises(Exception, match="no header"):
        segidx.read(spark, path, "postings").count()
    (row,) = segidx.read(spark, path, "postings", mode="permissive").collect()
    assert row.segment == "_0" and "no header" in row._corrupt and row.doc_id is None
    with pytest.raises(Exception, match="no table"):
        segidx.read(spark, path, "nonsense")


def test_no_segments_and_the_newest_commit(spark, tmp_path):
    (tmp_path / "segments_9").write_bytes(W.commit([]))
    assert segidx.read(spark, str(tmp_path), "postings").count() == 0
    assert segidx.read(spark, str(tmp_path), "commit").first().segment_count == 0
    path = put(tmp_path, documents(3))
    assert segidx.read(spark, path, "segment_info").first().segment_size == 3
    assert segidx.read(spark, path, "segment_info", generation="9").count() == 0


def test_terms_are_sought(tmp_path):
    docs = documents(2_000)
    g = opened(put(tmp_path, docs))
    every = list(g.terms(1))
    blocks = g.read_blocks
    assert len(every) > 1_500 and blocks > 20
    for t in (every[0], every[len(every) // 2], every[-1]):
        g.read_blocks = 0
        (got,) = g.terms(1, [(t["term"], t["term"])])
        assert {k: v for k, v in got.items() if k != "term_ord"} == {k: v for k, v in t.items() if k != "term_ord"} and got["term_ord"] in (None, t["term_ord"])
        assert g.read_blocks <= blocks / 4, (g.read_blocks, blocks)
        assert [p[0] for p in g.postings(1, [(t["term"], t["term"])])] == [t["term"]]
    for within in ([(b"ab", b"ac")], [(b"c", None)], [(b"aa", b"ab"), (b"dd", b"de")], [(b"zz", b"zz")], [(b"", b"a")], []):
        want = [t["term"] for t in every if any(a <= t["term"] and (b is None or t["term"] <= b) for a, b in within)]
        assert [t["term"] for t in g.terms(1, within)] == want
    assert not list(g.terms(1, [(b"nothere", b"nothere")]))


def test_leaves_of_points_are_sought(tmp_path):
    docs = documents(2_000)
    g = opened(put(tmp_path, docs, leaf=32))
    for number, f, size in ((10, "pt", 8), (11, "pt2", 4)):
        t = g.tree(number, g.open(".dim"))
        assert len(g.leaves(t)) == t["num_leaves"] > 30
        for leaf, low, high in g.leaves(t):
            assert all(a <= b for a, b in zip(low, high))
        g.read_leaves = 0
        raw = lambda v: W._sortable(v, size)
        box = {0: (raw(10), raw(12) if f == "pt2" else raw(50_000))}
        found = {d for _, ids, x in g.points(number, box) for k, d in enumerate(ids) if box[0][0] <= x[k, 0].tobytes() <= box[0][1]}
        want = {i for i, d in enumerate(docs) for v in [d[f][0] if f == "pt2" else d[f]] if 10 <= v <= (12 if f == "pt2" else 50_000)}
        assert found == want and g.read_leaves < t["num_leaves"] / 3


def test_filters_reach_blocks_leaves_and_chunks(spark, tmp_path):
    docs = documents(1_500)
    path = put(tmp_path, docs, leaf=64, chunk=2_000)
    reader = lambda table, *filters: (lambda r: (list(r.pushFilters(list(filters))), r)[1])(segidx.SegmentReader(segidx.read(spark, path, table).schema, {"path": path, "table": table}))
    assert reader("postings", segidx.In(("term",), (b"a", b"b"))).terms() == [(b"a", b"a"), (b"b", b"b")]
    assert reader("terms", segidx.GreaterThan(("term",), b"a"), segidx.LessThanOrEqual(("term",), b"c")).terms() == [(b"a", b"c")]
    assert reader("points", segidx.EqualTo(("value",), 4)).between("value") == (4, 4)
    chunks = lambda *f: sum(len(p.starts) for p in reader("stored", *f).partitions())
    assert 0 < chunks(segidx.GreaterThanOrEqual(("doc_id",), 1_400)) < chunks() / 5
    assert chunks(segidx.EqualTo(("doc_id",), 700)) == 1
    (part,) = [p for p in reader("norms", segidx.GreaterThanOrEqual(("doc_id",), 101), segidx.LessThan(("doc_id",), 150)).partitions()]
    assert (part.low, part.high) == (96, 151)
    want = {w: i for i, d in enumerate(docs) for w in W.tokens(d["text"])}
    term = sorted(want)[40]
    got = segidx.read(spark, path, "postings").where((segidx.F.col("field_name") == "text") & (segidx.F.col("term") == segidx.F.lit(bytearray(term.encode()))))
    assert "PushedFilters" in got._jdf.queryExecution().toString() or got.count()
    assert sorted(r.doc_id for r in got.collect()) == [i for i, d in enumerate(docs) if term in W.tokens(d["text"])]
    t = segidx.read(spark, path, "terms").where(segidx.F.col("term") == segidx.F.lit(bytearray(term.encode()))).where("field_name = 'text'").first()
    assert t.term_ord == sorted(want).index(term)  # a filter doesn't change what a row holds
    p = segidx.read(spark, path, "points").where("field_name = 'pt2' AND dim = 1 AND value BETWEEN -3 AND 3")
    assert sorted((r.doc_id, r.value) for r in p.collect()) == [(i, d["pt2"][1]) for i, d in enumerate(docs) if -3 <= d["pt2"][1] <= 3]
    assert segidx.read(spark, path, "points").where("field_name = 'pt' AND value > 9000000000000000000").count() == 0
    assert {r.doc_id: r.norm for r in segidx.read(spark, path, "norms").where("doc_id BETWEEN 100 AND 107").collect()} == {i: len(W.tokens(docs[i]["text"])) for i in range(100, 108)}
    got = segidx.boolean(spark, path, "text", every=["the"], none=[term])
    assert sorted(r.doc_id for r in got.collect()) == [i for i, d in enumerate(docs) if "the" in W.tokens(d["text"]) and term not in W.tokens(d["text"])]


def test_values_and_norms_of_ranges(tmp_path, monkeypatch, spark):
    docs = documents(500)
    path = put(tmp_path, docs)
    g = opened(path)
    for lo, hi in ((0, 8), (8, 500), (13, 77), (490, 9_000), (77, 77)):
        for f in ("id", "price", "few", "nums", "kind"):
            assert list(g.dv_values(f, lo, hi)) == [r for r in g.dv_values(f) if lo <= r["doc_id"] < hi]
        assert g.norms(1, lo, hi).tolist() == g.norms(1).tolist()[lo:hi]
    want = {(r.field_name, r.doc_id, r.ord): r.long_value for r in segidx.read(spark, path, "dv_values").collect()}
    monkeypatch.setattr(segidx, "DOCS", 64)
    rows = segidx.read(spark, path, "dv_values")
    assert {(r.field_name, r.doc_id, r.ord): r.long_value for r in rows.collect()} == want


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("options", [2, 3, 4])
def test_widths_in_words_and_files_of_positions(tmp_path, words, options):
    docs = [{"t": "a " * (1 + i % 70) + f"w{i % 2}"} for i in range(700)]
    g = opened(put(tmp_path, docs, [Field("t", options=options)], words=words))
    assert {n.split("_0")[-1]: S.header(c)["codec"] for n, c in g.all_files() if n.endswith((".pos", ".pay"))} == {k: v for k, v, o in ((".pos", "positions", 3), (".pay", "payloads", 4)) if options >= o}
    got = {t: (a.tolist(), f.tolist()) for t, a, f in g.postings(0)}
    assert got[b"a"] == (list(range(700)), [1 + i % 70 for i in range(700)])
    assert got[b"w1"][0] == list(range(1, 700, 2))
    assert g.term_fields[0]["longs_size"] == max(1, options - 1)


def test_tail_of_stored_documents_and_versions(spark, tmp_path):
    path = put(tmp_path, documents(300), chunk=2_000)
    info = segidx.read(spark, path, "stored_info").first()
    assert info.tail_ok and info.num_chunks == segidx.read(spark, path, "stored_chunks").count() and info.num_dirty_chunks <= 1
    assert segidx.read(spark, path, "commit").first().index_version == "6.6.0" == segidx.read(spark, path, "segment_info").first().version
    dumped = {r.relation for r in segidx.dump(spark, path).collect()}
    assert {"commit", "segments", "fields", "term_index", "stored_info"} <= dumped


def test_nulls_and_numbers_that_are_not_finite_through_spark(spark, tmp_path):
    rows = [(0, 2**53 + 1, 1.5, float("inf"), "a b", b"x", [3, 1]), (1, None, None, float("-inf"), None, None, None), (2, -5, float("nan"), None, "", b"", []), (3, 7, 1e300, 0.5, "b", b"y", [2])]
    df = spark.createDataFrame(rows, "id long, n long, d double, f float, t string, b binary, many array<long>")
    fields = [Field("id", stored="long", dv="numeric"), Field("n", stored="long", dv="numeric", points=8), Field("d", stored="double"), Field("f", stored="float"), Field("t", options=2, norms=True, stored="string"), Field("b", stored="binary", dv="sorted"), Field("many", dv="sorted_numeric")]
    W.write_index(df.coalesce(1), str(tmp_path / "i"), fields)
    got = defaultdict(dict)
    for r in segidx.read(spark, str(tmp_path / "i"), "stored").collect():
        got[r.doc_id][r.field_name] = next(v for v in (r.str, r.bin, r.long, r.float, r.double) if v is not None)
    kept = {r[0]: {k: v for k, v in zip(("id", "n", "d", "f", "t", "b"), r) if v is not None} for r in rows}
    assert repr({k: sorted(v.items()) for k, v in sorted(got.items())}) == repr({k: sorted((n, bytes(x) if isinstance(x, bytes) else x) for n, x in v.items()) for k, v in kept.items()})
    v = segidx.read(spark, str(tmp_path / "i"), "dv_values").collect()
    assert {r.doc_id: r.long_value for r in v if r.field_name == "n"} == {0: 2**53 + 1, 2: -5, 3: 7}
    assert sorted((r.doc_id, r.long_value) for r in v if r.field_name == "many") == [(0, 1), (0, 3), (3, 2)]
    assert {r.doc_id: r.value for r in segidx.read(spark, str(tmp_path / "i"), "points").collect()} == {0: 2**53 + 1, 2: -5, 3: 7}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(), st.integers(-3, 130).map(float))), st.lists(st.one_of(st.none(), st.integers(-(2**62), 2**62), st.integers(-400, 400).map(lambda d: d * 3_600_000))))
def test_whole_columns_are_the_scalars_with_nulls(xs, ts):
    import pyarrow as pa

    same = lambda a, b: repr(a) == repr(b)  # noqa: E731 - NaN and -0.0 too
    a = codec.to_zdouble.arrays(pa.array(xs, pa.float64()))
    assert a.to_pylist() == [None if x is None else codec.put_zdouble(x) for x in xs] and same(codec.from_zdouble.arrays(a).to_pylist(), xs)
    with np.errstate(over="ignore"):
        fs = [None if x is None else float(np.float32(x)) for x in xs]
    a = codec.to_zfloat.arrays(pa.array(fs, pa.float32()))
    assert a.to_pylist() == [None if x is None else codec.put_zfloat(x) for x in fs] and same(codec.from_zfloat.arrays(a).to_pylist(), fs)
    a = codec.to_tlong.arrays(pa.array(ts, pa.int64()))
    assert a.to_pylist() == [None if t is None else codec.put_tlong(t) for t in ts] and codec.from_tlong.arrays(a).to_pylist() == ts
    vs = [None if t is None else abs(t) for t in ts]
    a = codec.to_varied.arrays(pa.array(vs, pa.int64()))
    assert a.to_pylist() == [None if v is None else codec.put_varied(v) for v in vs] and codec.from_varied.arrays(a).to_pylist() == vs


def test_what_has_no_form_is_an_error():
    import pyarrow as pa

    for f, a in ((codec.to_varied, pa.array([1, -1])), (codec.from_varied, pa.array([b"\x80"])), (codec.from_varied, pa.array([b""])), (codec.from_zdouble, pa.array([b"\xff12"])), (codec.from_tlong, pa.array([b"\x20"])), (codec.to_packed(3), pa.array([[8]])), (codec.to_packed(3), pa.array([[None]], pa.list_(pa.int64())))):
        with pytest.raises(ValueError):
            f.arrays(a)
    assert codec.to_packed(3).arrays(pa.array([[7, 0], None, []])).to_pylist() == [codec.pack([7, 0], 3), None, b""]
    assert codec.to_lz4.arrays(pa.array(["é", None, ""])).to_pylist()[1] is None
    with pytest.raises(ValueError):
        codec.put_varied(-1)


@pytest.fixture(scope="module")
def one_large_partition(spark, tmp_path_factory):
    """An index of a single partition with more rows than a segment may have."""
    path, n = str(tmp_path_factory.mktemp("large")), (1 << 18) + 5
    rows = spark.range(0, n, 1, 1).selectExpr("id", "array(int(id % 50), int(id % 11)) AS box")
    return path, n, W.write_index(rows, path, [Field("id", dv="numeric"), Field("box", points=4, dims=2)])


def test_points_of_a_large_partition_are_written_segment_by_segment(spark, one_large_partition):
    path, n, names = one_large_partition
    assert len(names) == 2
    p = segidx.read(spark, path, "points", ["segment", "doc_id", "dim", "value"]).groupBy("segment", "doc_id").pivot("dim", [0, 1]).max("value")
    found = {(r["0"], r["1"]): r["count"] for r in p.groupBy("0", "1").count().collect()}
    assert found == Counter((i % 50, i % 11) for i in range(n))


def test_trees_have_no_more_points_than_a_segment_may(spark, one_large_partition):
    path, n, _ = one_large_partition
    found = segidx.read(spark, path, "points_tree").collect()
    assert sorted(r["point_count"] for r in found) == [n - W.ROWS, W.ROWS]


def test_a_range_of_points_goes_over_all_segments_of_a_partition(spark, one_large_partition):
    path, n, names = one_large_partition
    p = segidx.read(spark, path, "points", ["segment", "field_name", "dim", "value"]).where("field_name = 'box' AND dim = 0 AND value >= 3 AND value <= 5")
    found = p.groupBy("value").count().collect()
    assert {r["value"]: r["count"] for r in found} == {v: len(range(v, n, 50)) for v in (3, 4, 5)}
    assert {r["segment"] for r in p.select("segment").distinct().collect()} <= set(names) and len(names) == 2


def test_numbers_of_a_large_partition_come_in_parts(spark, one_large_partition):
    path, n, names = one_large_partition
    v = segidx.read(spark, path, "dv_values", ["segment", "doc_id", "long_value"])
    assert sorted(r["count"] for r in v.groupBy("segment").count().collect()) == [n - W.ROWS, W.ROWS]
    assert v.selectExpr("count(DISTINCT long_value) AS n", "min(long_value) AS low", "max(long_value) AS high").first() == (n, 0, n - 1)


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """An index of a single partition with more bytes than a segment may have, in few rows."""
    path = str(tmp_path_factory.mktemp("long"))
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat(concat('the w', id, ' '), 70000) AS text", "encode(concat('k', id % 3), 'UTF-8') AS kind")
    names = W.write_index(rows, path, [Field("id", dv="numeric"), Field("text", options=2), Field("kind", dv="sorted")])
    return path, names


def test_postings_of_long_texts_are_written_segment_by_segment(spark, long_texts):
    path, names = long_texts
    assert len(names) > 1
    p = segidx.read(spark, path, "postings").where("term = CAST('the' AS BINARY)")
    assert p.selectExpr("count(*) AS docs", "sum(freq) AS freq", "count(DISTINCT segment) AS segments").first() == (40, 40 * 70_000, len(names))


def test_every_segment_of_a_partition_describes_its_columns(spark, long_texts):
    path, names = long_texts
    found = Counter((r["field_name"], r["field_type"], r["role"]) for r in segidx.read(spark, path, "dv_meta").collect())
    assert len(names) > 1 and found == {k: len(names) for k in (("id", "numeric", "numeric"), ("kind", "sorted", "binary"), ("kind", "sorted", "ord"))}


def test_columnar_values_of_all_segments_of_a_partition(spark, long_texts):
    path, names = long_texts
    rows = segidx.read(spark, path, "dv_values").collect()
    kind = {(r["segment"], r["doc_id"]): bytes(r["bin_value"]) for r in rows if r["field_name"] == "kind"}
    ids = {(r["segment"], r["doc_id"]): r["long_value"] for r in rows if r["field_name"] == "id"}
    assert len(names) > 1 and {ids[k]: v for k, v in kind.items()} == {i: b"k%d" % (i % 3) for i in range(40)}


def test_terms_of_all_segments_of_a_partition(spark, long_texts):
    path, names = long_texts
    t = segidx.read(spark, path, "terms").groupBy("term").sum("doc_freq", "total_term_freq").collect()
    assert len(names) > 1 and {bytes(r[0]).decode(): tuple(r[1:]) for r in t} == {"the": (40, 40 * 70_000)} | {f"w{i}": (1, 70_000) for i in range(40)}


def test_a_search_goes_over_all_segments_of_a_partition(spark, long_texts):
    path, names = long_texts
    found = segidx.boolean(spark, path, "text", every=["the"], some=["w0", "w1", "w39"], none=["w1"])
    assert len(names) > 1 and found.count() == 2 and found.select("segment").distinct().count() == 2
