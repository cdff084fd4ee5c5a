"""The classifier chain: held-out accuracy, out-of-fold training, seeds that feed later models."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from lodestrata.llm import toxicity

from ..conftest import DATA


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(DATA / "sf0.1/documents.parquet"))
    labels = spark.read.parquet(str(DATA / "sf0.1/labels.parquet"))
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    true = {r.doc_id: r.toxic for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs.join(labels.where("doc_id % 3 = 0").select("doc_id"), "doc_id"), chain).collect()}
    assert len(got) == len(true)
    caught = np.mean([got[d] for d, t in true.items() if t])
    wrong = np.mean([got[d] for d, t in true.items() if not t])
    # 300 toxic documents to learn four languages from, and a twentieth of the labels has nothing in the text to tell them by
    assert caught >= 0.8 and wrong <= 0.01, (caught, wrong)


def test_earlier_categories_tell_toxic_documents_of_every_language(spark):
    docs = spark.read.parquet(str(DATA / "sf0.1/documents.parquet"))
    labels = spark.read.parquet(str(DATA / "sf0.1/labels.parquet"))
    held = labels.where("doc_id % 3 = 0 and toxic is not null")
    got = toxicity.classify(docs.join(held.select("doc_id"), "doc_id"), toxicity.train(docs, labels.where("doc_id % 3 <> 0")))
    true = {r.doc_id: (r.lang, r.toxic) for r in held.join(docs, "doc_id").select("doc_id", "lang", "toxic").collect()}
    rows = [Row(lang=true[r.doc_id][0], y=true[r.doc_id][1], **r.asDict()) for r in got.collect()]
    early = {r: max(r[f"p_{c}"] for c in toxicity.CATEGORIES[:-1]) > toxicity.CUT for r in rows}
    for g in ("de", "en", "es", "fr"):
        mine = [r for r in rows if r.lang == g and r.y]
        each = {c: round(float(np.mean([r[f"p_{c}"] > toxicity.CUT for r in mine])), 3) for c in toxicity.CATEGORIES}
        print(g, len(mine), each, "any earlier", np.mean([early[r] for r in mine]), "clean flagged early", np.mean([early[r] for r in rows if r.lang == g and not r.y]))
        assert np.mean([early[r] for r in mine]) >= 0.5, (g, each)
    assert np.mean([early[r] for r in rows if not r.y]) <= 0.02


def test_toxic_documents_without_a_seed_are_no_negatives(monkeypatch, spark):
    seen = {}
    monkeypatch.setattr(toxicity, "fit_chain", lambda at, first, labels, known=None: seen.update(labels=labels, known=known))
    docs = spark.createDataFrame([(1, "du Trottel"), (2, "gruselwort hier"), (3, "guten Tag")], "doc_id long, text string").coalesce(1)
    toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int"))
    got = sorted(zip(seen["labels"].astype(int).tolist(), seen["known"].astype(int).tolist()))
    assert got == [([0, 0, 0, 0, 0], [1, 1, 1, 1, 1]), ([0, 0, 0, 1, 1], [0, 0, 0, 1, 1]), ([1, 0, 0, 0, 1], [1, 1, 1, 0, 1])]


def flat(rows):
    """Features of rows of whole words, which are odd numbers."""
    return np.array([2 * w + 1 for r in rows for w in sorted(set(r))], dtype=np.int64), np.concatenate([[0], np.cumsum([len(set(r)) for r in rows])])


def test_later_models_are_trained_on_predictions_out_of_their_fold():
    """The chain fitted step by step, with each fold's rows predicted by a model that hasn't seen them."""
    rng = np.random.default_rng(3)
    rows = [[int(w) for w in rng.integers(0, 40, 12)] for _ in range(2_000)]
    y = np.array([[3 in r or 4 in r, (3 in r) ^ (rng.random() < 0.1)] for r in rows])
    at, first = flat(rows)
    group = np.arange(len(rows))
    chain = toxicity.fit_chain(at, first, y, None, group)
    fold = (toxicity.mix(group.astype(np.uint64)) % np.uint64(toxicity.FOLDS)).astype(int)
    keys, place = np.unique(at, return_inverse=True)
    w, none = np.ones(len(rows)), np.zeros((len(rows), 0))
    held = np.zeros(len(rows))
    for f in range(toxicity.FOLDS):
        m = toxicity._fit(place, first, len(keys), none, y[:, 0].astype(float), w * (fold != f))
        held[fold == f] = m.predict(place, first, none)[fold == f]
    own = toxicity._fit(place, first, len(keys), none, y[:, 0].astype(float), w)
    fitted = own.predict(place, first, none)
    assert not np.allclose(held, fitted)
    want = toxicity._fit(place, first, len(keys), toxicity._logit(held)[:, None], y[:, 1].astype(float), w)
    used = np.isin(keys, chain.keys.astype(np.int64))
    for got, ref in zip(chain.links, (own, want)):
        assert np.allclose(got.word, ref.word[used]) and np.allclose(got.earlier, ref.earlier) and np.isclose(got.bias, ref.bias)
    # and the scores are those of sums by hand, row by row
    weight = [dict(zip(chain.keys.tolist(), link.word)) for link in chain.links]
    at2, first2 = np.searchsorted(chain.keys, at[np.isin(at, chain.keys.astype(np.int64))].astype(np.uint64)), np.concatenate([[0], np.cumsum([sum(2 * v + 1 in weight[0] for v in set(r)) for r in rows])])
    p = toxicity.score(chain.links, at2, first2)
    for k, r in enumerate(rows):
        a = 1 / (1 + np.exp(-sum(weight[0].get(2 * v + 1, 0.0) for v in set(r)) - chain.links[0].bias))
        b = 1 / (1 + np.exp(-sum(weight[1].get(2 * v + 1, 0.0) for v in set(r)) - chain.links[1].bias - chain.links[1].earlier[0] * toxicity._logit(np.array([a]))[0]))
        assert np.allclose(p[k], (a, b))
    assert ((p[:, 0] > 0.5) == y[:, 0]).mean() > 0.95


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda at, first, *more: seen.append(len(first) - 1))
    docs = spark.createDataFrame([(i % 9, f"text number {i} of {i % 9}") for i in range(300)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 50)
    toxicity.train(docs, labels)
    assert seen[0] == 5 and 1 <= seen[1] <= 3


def test_each_model_is_fed_with_those_before_it():
    texts = pa.array(["a b", "c", ""])
    keys = np.unique(toxicity.features(texts)[0]).astype(np.uint64)
    at, first = toxicity.features(texts, keys)
    words = len(keys)
    chain = [toxicity.Link(np.zeros(words), np.zeros(k), 1.0) for k in range(2)]
    chain[1].earlier[0] = 2.0
    p = toxicity.score(chain, at, first)
    assert words == 3 and np.allclose(p[:, 0], 1 / (1 + np.exp(-1.0)))
    assert np.allclose(p[:, 1], 1 / (1 + np.exp(-(2.0 * 1.0 + 1.0))), atol=1e-6)


def test_features_are_the_distinct_words():
    at, first = toxicity.features(pa.array(["One one TWO", None, "two"]))
    one, two = (set(at[first[k] : first[k + 1]]) for k in (0, 2))
    assert first[1] == first[2] and two < one and len(one) == 2


def test_beginnings_are_shared_and_keys_pick_features():
    at, first = toxicity.features(pa.array(["abcdefgh", "abcdexyz"]))
    a, b = set(at[: first[1]]), set(at[first[1] :])
    assert len(a) == 1 + 4 and len(a & b) == 2  # beginnings of 4 to 7 bytes; those of 4 and 5 are the same
    keys = np.array(sorted(a & b), dtype=np.uint64)
    at, first = toxicity.features(pa.array(["abcdefgh", "zzz", "abcde"]), keys)
    assert first.tolist() == [0, 2, 2, 3] and set(at) <= {0, 1}


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    chain = toxicity.train(odd_docs, labels)
    got = toxicity.classify(odd_docs, chain).collect()
    assert len(got) == odd_docs.count()
    assert len({r.p_toxic for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.classify(no_docs, chain).count() == 0
    none = toxicity.classify(odd_docs, toxicity.train(odd_docs, labels.where("false"))).collect()
    assert all(r.p_toxic == 0.5 and not r.toxic for r in none)
