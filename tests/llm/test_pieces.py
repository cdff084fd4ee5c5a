"""SentencePiece encoding: chunks against the library's search, and round trips."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import pieces

from ..conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="the vocabulary file isn't here")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def by_chunks(v, text, chunk):
    """The scan without Spark: matrices, prefix products, each chunk traced back for itself."""
    import numpy as np

    norm = v.prefix + text
    parts = [norm[i : i + chunk + v.longest] for i in range(0, len(norm), chunk)]
    sizes = [min(chunk, len(norm) - i) for i in range(0, len(norm), chunk)]
    lattice = pieces.Lattice(v, [p.replace(" ", "▁") for p in parts], sizes)
    first = np.full(v.longest, pieces._NEVER)
    first[0] = 0
    entries = np.stack([first, *pieces.scan(lattice.matrices())[:-1, 0, :]])
    out, exit_ = [], 0
    for shared, exits in reversed(lattice.paths(entries)):
        entry, ids = exits[exit_]
        out, exit_ = shared + ids + out, entry
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("abcdefghinorst   .,éß日本😀\n▁"), max_size=300))
def test_chunks_give_the_ids_of_the_library(vocabulary, text):
    v = vocabulary
    want = v.library().encode(text) if text else []
    if text and "▁" not in text:
        assert by_chunks(v, text, v.longest + 1) == want
        assert v.decode(want) == text


def test_scan_is_the_running_product():
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.integers(-50, 0, (7, 4, 4))
    got = pieces.scan(m)
    acc = m[0]
    for k in range(7):
        acc = m[0] if k == 0 else (acc[:, :, None] + m[k][None]).max(axis=1)
        assert (got[k] == acc).all()


def test_all_documents_survive_and_both_ways_agree(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    whole = {r.doc_id: r for r in pieces.encode(docs).collect()}
    cut = {r.doc_id: r for r in pieces.encode(docs, giant=400, chunk=300).collect()}
    assert len(whole) == docs.count() == len(cut)
    for d, r in whole.items():
        assert r.round_trip and r.n_tokens == len(r.ids) and cut[d].round_trip
        assert cut[d].ids == r.ids
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()} == text


def test_odd_rows(odd_docs, no_docs):
    got = pieces.encode(odd_docs, giant=1_000, chunk=500).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id == 2:
            assert r.ids is None and r.n_tokens is None and r.round_trip is None
        elif r.doc_id == 3:
            assert r.ids == [] and r.n_tokens == 0 and r.round_trip
        elif r.ids is not None:
            assert r.round_trip, r
    assert pieces.encode(no_docs).count() == 0
    back = {(r.doc_id, r.text) for r in pieces.decode(pieces.encode(odd_docs)).collect()}
    assert back == {(r.doc_id, r.text) for r in odd_docs.collect()}
