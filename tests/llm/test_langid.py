"""Languages by compression: held-out accuracy, whole texts, margins."""

import numpy as np
import pyarrow as pa
import zstandard

from lodestrata.llm import langid

from ..conftest import DATA


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(str(DATA / "sf0.01/documents.parquet"))
    dicts = langid.dictionaries(docs.where("doc_id % 2 = 0"))
    assert set(dicts) == {"de", "en", "es", "fr"}
    held = docs.where("doc_id % 2 = 1")
    true = {r.doc_id: r.lang for r in held.collect()}
    got = langid.identify(held, dicts).collect()
    ok = [r for r in got if r.accepted]
    assert len(got) == len(true) and len(ok) >= 0.9 * len(got)
    assert np.mean([r.lang == true[r.doc_id] for r in ok]) >= 0.97


def test_sizes_are_those_of_the_blocks_one_by_one():
    dicts = {"a": b"the cat sat on the mat " * 20, "b": b"le chat est sur la table " * 20}
    texts = ["The cat sat", "", "le chat " * 2_000]
    got = langid.sizes(pa.array(texts), langid._encoders(dicts))
    for t, row in zip(texts, got):
        raw = t.lower().encode()
        for k, e in enumerate(langid._encoders(dicts)):
            d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dicts[sorted(dicts)[k]], dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            parts = [e.compress(raw[i : i + langid.BLOCK]) for i in range(0, len(raw), langid.BLOCK)]
            assert row[k] == sum(map(len, parts))
            assert b"".join(d.decompress(p, max_output_size=langid.BLOCK) for p in parts) == raw


def test_narrow_margins_are_rejected():
    best, gap, ok = langid.decide(np.array([[100, 100], [90, 100], [0, 0]]), 0.05)
    assert best.tolist() == [0, 0, 0] and gap.tolist() == [0.0, 0.1, 0.0] and ok.tolist() == [False, True, False]


def test_odd_rows(odd_docs, no_docs):
    dicts = langid.dictionaries(odd_docs)
    got = langid.identify(odd_docs, dicts).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id in (2, 3):
            assert not r.accepted and r.margin == 0
    assert [r.lang for r in got if r.doc_id == 5] == ["de"]
    kept = langid.keep_identified(odd_docs, dicts)
    assert kept.schema == odd_docs.schema and kept.count() == sum(r.accepted for r in got)
    assert langid.dictionaries(no_docs) == {} and langid.identify(no_docs, {}).count() == 0
    assert not any(r.accepted for r in langid.identify(odd_docs, {}).collect())
