"""Sum-of-squares packing against the rule tried bin by bin."""

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import packing, pieces

from ..conftest import DATA


def brute(sizes, capacity):
    room, out = [], []

    def squares(r):
        return sum(n * n for g, n in Counter(r).items() if 0 < g < capacity)

    for s in sizes:
        tries = [(squares(room[:b] + [g - s] + room[b + 1 :]), 0, g, b) for b, g in enumerate(room) if g >= s]
        tries.append((squares([*room, capacity - s]), 1, capacity, len(room)))
        best = min(t[:3] for t in tries)
        b = max(t[3] for t in tries if t[:3] == best)
        out.append(best)
        if b == len(room):
            room.append(capacity)
        room[b] -= s
    return out, sorted(room)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_every_step_is_the_best(sizes):
    bins, starts = packing.sum_of_squares(np.array(sizes, dtype=np.int64), 12)
    want, room = brute(sizes, 12)
    assert [12 - s for s in starts.tolist()] == [g for _, _, g in want]
    assert sorted(12 - v for v in Counter({int(b): sum(s for s, x in zip(sizes, bins) if x == b) for b in bins}).values()) == room


def test_all_tokens_lie_in_bins_without_overlap(spark, monkeypatch):
    monkeypatch.setattr(pieces, "GIANT", 3_000)
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    v = pieces.Vocabulary()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert max(map(len, texts.values())) > 6_000
    packed = packing.pack(docs, capacity=256).cache()
    have, bins = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        assert len(r.ids) == r.n_tokens
        have[r.doc_id].append((r.piece, r.ids))
        if r.bin is not None:
            bins[r.bin_group, r.bin].append((r.start, r.start + r.n_tokens))
    assert {d: v.decode([i for _, ids in sorted(p) for i in ids]) for d, p in have.items()} == texts
    short = {r.doc_id: r.ids for r in pieces.encode(docs).collect() if len(texts[r.doc_id]) <= 3_000}
    assert all([i for _, ids in sorted(have[d]) for i in ids] == x for d, x in short.items())
    for spans in bins.values():
        spans.sort()
        assert spans[-1][1] <= 256 and spans[0][0] == 0
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = sum(len(ids) for p in have.values() for _, ids in p)
    assert len(bins) <= 1.1 * total / 256 + 1
    again = defaultdict(list)
    rows = packing.sequences(packed).collect()
    assert len(rows) == len(bins) and sum(r.n_tokens for r in rows) == total
    for r in rows:  # from the sequences alone every document can be had again
        assert len(r.ids) == r.n_tokens <= 256
        for p in r.pieces:
            again[p.doc_id].append((p.piece, r.ids[p.start : p.start + p.n_tokens]))
    assert {d: v.decode([i for _, ids in sorted(p) for i in ids]) for d, p in again.items()} == {d: t for d, t in texts.items() if t}


def test_texts_without_spaces_are_cut_all_the_same():
    text = "x" * 95_000 + " é😀" * 20_000
    v = pieces.Vocabulary()
    got = packing.Tokens(v).encode([text, "x", None, ""])
    assert v.decode(got[0].tolist()) == text and v.decode(got[1].tolist()) == "x" and not len(got[2]) and not len(got[3])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(1, 20))
def test_items_may_come_in_parts(sizes, part):
    p, got = packing.Packer(30), []
    for lo in range(0, len(sizes), part):
        got += zip(*(x.tolist() for x in p.put(np.array(sizes[lo : lo + part], dtype=np.int64))))
    assert got == list(zip(*(x.tolist() for x in packing.sum_of_squares(np.array(sizes, dtype=np.int64), 30))))


def test_partitions_cut_the_work_and_not_the_result(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).repartition(5)
    got = packing.pack(docs)
    assert got.select("bin_group").distinct().count() == 5
    assert got.select("doc_id").distinct().count() == docs.count()


def test_odd_rows(odd_docs, no_docs):
    got = packing.pack(odd_docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(by[1]) == 2 and len(by[None]) == 3 and 2**60 + 1 in by
    for d in (2, 3):
        (r,) = by[d]
        assert (r.n_tokens, r.bin, r.start, r.ids) == (0, None, None, [])
    assert by[4][0].n_tokens and sum(r.n_tokens == 0 for r in by[None]) == 1
    assert packing.sequences(packing.pack(no_docs)).count() == 0
    assert len(by[5]) > 1 and [r.n_tokens for r in sorted(by[5], key=lambda r: r.piece)][0] == packing.CAPACITY
    assert packing.pack(no_docs).count() == 0
