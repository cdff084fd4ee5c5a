"""The pipeline against its stages done by hand on a small table."""

from collections import Counter, defaultdict

import corpus_pipeline
from lodestrata.llm import packing, pieces, secrets

from ..conftest import DATA
from .test_neardup import pairs_at_the_threshold


def test_stages_are_in_order_and_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_dedup", "secret_scans", "best_fit_packing"]


def test_every_stage_acts_on_all_that_was_kept(spark, tmp_path):
    sf = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, quality = docs.columns, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert set(seen[k + 1]) <= set(seen[k])
    assert len(seen[1]) >= 0.9 * len(seen[0])
    good = [d for d in seen[1] if quality.get(d) == 1]
    assert sum(d in seen[2] for d in good) >= 0.97 * len(good)
    bad = [d for d in seen[1] if quality.get(d) == 0]
    assert sum(d in seen[2] for d in bad) <= 0.1 * len(bad)
    assert len(seen[3]) < len(seen[2]) and len(set(seen[3].values())) == len(seen[3])
    assert set(seen[4]) == set(seen[3])
    assert all(seen[4][d] == t or "[" in seen[4][d] for d, t in seen[3].items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    v = pieces.Vocabulary()

    def texts(rows):
        have = defaultdict(list)
        for r in rows:
            assert len(r.ids) == r.n_tokens <= packing.CAPACITY
            for p in r.pieces:
                have[p.doc_id].append((p.piece, r.ids[p.start : p.start + p.n_tokens]))
        return {d: v.decode([i for _, ids in sorted(p) for i in ids]) for d, p in have.items()}

    assert texts(packed.collect()) == seen[4]
    assert texts(corpus_pipeline.run(spark, sf).collect()) == seen[4]
    assert secrets.findings(docs).count() == 0


def test_near_dedup_keeps_one_of_every_pair_at_the_threshold(spark):
    rows, root, _ = pairs_at_the_threshold()
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root.tolist()))


def test_odd_rows_go_through_every_stage(spark, odd_docs, no_docs, tmp_path):
    sf = str(DATA / "sf0.001")
    left = {}
    for k, start in enumerate((odd_docs, no_docs)):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            if name != "best_fit_packing":
                assert docs.columns == start.columns
            docs.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            left[k, name] = docs.collect()
    kept = [r.doc_id for r in left[0, "language_id"]]
    assert kept.count(1) in (0, 2) and not {2, 3} & set(kept)  # repeated rows alike; null and empty texts go
    ids = [r.doc_id for r in left[0, "near_dedup"]]
    assert ids.count(1) <= 1 and set(ids) <= {r.doc_id for r in left[0, "quality_classifier"]} <= set(kept)
    assert sorted(map(repr, left[0, "secret_scans"])) == sorted(map(repr, left[0, "near_dedup"]))  # none has a secret
    assert Counter(p.doc_id for r in left[0, "best_fit_packing"] for p in r.pieces if p.piece == 0) == Counter(ids)
    assert not any(rows for (k, _), rows in left.items() if k == 1)
