"""Terms, postings and their statistics on rows that the tables don't have: far ids, repeated rows, no field."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import inverted

IDS = sorted({k * 1_000 for k in range(300)} | {k * 70_000 for k in range(40)})  # many ranges, of few ids and of more


@pytest.fixture(scope="module")
def docs(spark):
    """Every document twice, in different partitions, half of them without a field."""
    rows = [(i, None if k % 2 else "f", "A b-b" if k % 3 else "a") for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows + rows, "doc_id long, lang string, text string").repartition(5)


def _lists(docs):
    return inverted.invert(docs, F.col("lang"), F.col("doc_id"), F.col("text"))


def _want(field: str | None, term: str) -> list[int]:
    return [i for k, i in enumerate(IDS) if (None if k % 2 else "f") == field and (term == "a" or k % 3)]


def test_differences_give_the_ids_again(docs):
    found = inverted.from_deltas(inverted.posting_lists(_lists(docs))).collect()
    assert sorted((r["field_name"] or "", r["term"], r["doc_id"]) for r in found) == sorted((f or "", t, i) for f in (None, "f") for t in "ab" for i in _want(f, t))


def test_blocks_go_over_ranges_and_begin_with_the_last_id_before(docs):
    lists = inverted.posting_lists(_lists(docs))
    found = {(r["field_name"], r["term"], r["block"]): (r["base"], r["doc_ids"]) for r in lists.collect()}
    want = {}
    for f in (None, "f"):
        for t in "ab":
            ids = _want(f, t)
            want |= {(f, t, k // 128): (ids[k - 1] if k else 0, ids[k : k + 128]) for k in range(0, len(ids), 128)}
    assert found == want and len(_want(None, "a")) > 128


def test_lists_are_shuffled_once(docs):
    plan = inverted.posting_lists(_lists(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(field_name") == 1 and "Exchange rangepartitioning" not in plan


def test_blocks_of_ids_in_several_ranges_have_their_width(docs):
    found = {(r["field_name"], r["term"], r["block"]): (r["n"], r["full"], r["bits"]) for r in inverted.posting_blocks(_lists(docs)).collect()}
    for f in (None, "f"):
        ids = _want(f, "a")
        steps = [b - a for a, b in zip([0, *ids], ids)]
        for k in range(0, len(ids), 128):
            own = steps[k : k + 128]
            assert found[f, "a", k // 128] == (len(own), len(own) == 128, max(own).bit_length())


def test_a_repeated_document_counts_once_and_its_tokens_twice(docs):
    found = {(r["field_name"], r["term"]): (r["doc_freq"], r["total_term_freq"], r["term_ord"]) for r in inverted.term_ordinals(inverted.term_freqs(_lists(docs))).collect()}
    assert found == {(f, t): (n := len(_want(f, t)), n * (2 if t == "a" else 4), k) for f in (None, "f") for k, t in enumerate("ab")}


def test_statistics_of_documents_without_a_field(docs):
    found = {r["field_name"]: r for r in inverted.term_fields(docs, F.col("lang"), F.col("doc_id"), F.col("text")).collect()}
    for f in (None, "f"):
        r = found[f]
        assert (r["num_terms"], r["doc_count"], r["sum_doc_freq"], r["min_term"], r["max_term"]) == (2, len(_want(f, "a")), len(_want(f, "a")) + len(_want(f, "b")), "a", "b")
