"""The rule ensemble: held-out accuracy, and columns against numpy."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import quality

from ..conftest import DATA


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(str(DATA / "sf0.01/documents.parquet")), spark.read.parquet(str(DATA / "sf0.01/labels.parquet"))


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    true = {r.doc_id: r.quality for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r.accepted for r in quality.score(docs, model).collect() if r.doc_id in true}
    assert len(got) == len(true)
    assert np.mean([got[d] == bool(q) for d, q in true.items()]) >= 0.95
    assert np.mean([got[d] for d, q in true.items() if q]) >= 0.97


def test_rules_are_sparse_conjunctions_and_columns_agree_with_numpy(tables):
    docs, labels = tables
    model = quality.train(docs, labels)
    assert model.rules and all(1 <= len(r.conditions) <= quality.LEVELS and r.weight for r in model.rules)
    rows = docs.where("length(text) > 0").orderBy("doc_id").collect()
    stats = np.array([brute_statistics(r.text) for r in rows])
    got = [r.quality for r in quality.score(docs.where("length(text) > 0"), model).orderBy("doc_id").collect()]
    assert np.allclose(got, model.probability(stats), atol=2e-6)


def brute_statistics(t):
    words, lines, n = re.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n"), max(1, len(t))
    count = lambda p: len(regex.findall(p, t))
    return [
        math.log1p(len(t)), math.log1p(len(words)), n / len(words), count(r"[#$%&*@^~<>{}\\]") / n, count("!") / n, count(r"\|") / n, count("[0-9]") / n,
        count(r"\p{Lu}{2,}") / len(words), len(lines) / len(words), len(set(words)) / len(words), len(set(lines)) / len(lines),
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAÄb \n\t!|7#\u2029É😀", max_size=12), max_size=6))
def test_statistics_are_those_of_the_definitions(texts):
    assert np.allclose(quality.statistics(pa.array(texts, pa.string())), np.array([brute_statistics(t) for t in texts]).reshape(-1, 11))


def test_the_lasso_is_at_its_optimum(tables):
    """Subgradient conditions of the penalised mean loss, over the rules that were kept and those that weren't."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5) ^ (rng.random(800) < 0.05)).astype(float)
    model = quality.fit(x, y)
    err = (model.probability(x) - y) / len(y)
    assert abs(err.sum()) < 1e-4 and model.rules
    for r in model.rules:
        assert abs(r.holds(x) @ err + np.sign(r.weight) * quality.PENALTY) < 3e-4, r
    kept = {r.conditions for r in model.rules}
    others = [quality.Rule(((f, t, above),), 0.0) for f in range(3) for t in (-0.5, 0.0, 0.5) for above in (False, True) if ((f, t, above),) not in kept]
    assert np.mean([(r.probability(x) >= 0.5) == (y > 0) for r in [model]]) > 0.9 and others


def test_the_sample_is_bounded_however_often_an_id_is_repeated(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 5)
    docs = spark.createDataFrame([(i % 9, f"text number {i} of {i % 9}") for i in range(300)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append((len(x), len(y))))
    quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"))
    assert seen == [(5, 5)]


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    got = quality.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(r.quality == 0 and not r.accepted for r in got if r.doc_id in (2, 3))
    kept = quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.accepted for r in got)
    assert quality.score(no_docs, model).count() == 0
    assert quality.train(no_docs, labels).rules == () and quality.train(odd_docs, labels.where("false")).rules == ()
