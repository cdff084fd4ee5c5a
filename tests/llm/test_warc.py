"""Web archives: round trips, what is read of a file, and damaged ones."""

import gzip

import numpy as np
import pytest
from pyspark.sql import types as T

from lodestrata.llm import queries, warc

from ..conftest import DATA, spark_rows, sql_rows


@pytest.fixture
def pages(spark):
    warc.register(spark)
    rows = [(1, "http://a/", "<p>one</p>"), (2, "http://b/\nx", "é" * 50_000), (3, None, ""), (4, "http://d/", None), (None, "http://e/", "WARC/1.1\r\n\r\nnot a record"), (1, "http://a/", "<p>one</p>")]
    return spark.createDataFrame([(*r, "t", "f") for r in rows], "page_id long, url string, html string, type string, file string")


def test_query_has_the_rows_of_its_sql(spark):
    names, rows = sql_rows(queries.ORACLES["op9_warc"], "sf0.001")
    df = queries.op9_warc(spark, str(DATA / "sf0.001"))
    assert sorted(df.columns) == names and spark_rows(df) == rows


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("split", [warc.SPLIT, 300])
def test_round_trip(spark, pages, tmp_path, compression, split):
    path = str(tmp_path / "w")
    warc.from_pages(pages).coalesce(1).write.format("warc").option("compression", compression).mode("append").save(path)
    rows = spark.read.format("warc").option("splitBytes", split).load(path)
    if split == 300:
        assert rows.rdd.getNumPartitions() > 2
    got = [(r.headers.get("page-id"), r.uri, r.body) for r in rows.where("type = 'response'").collect()]
    want = [(None if p.page_id is None else str(p.page_id), p.url and p.url.replace("\n", "%0A"), p.html) for p in pages.collect() if p.html is not None]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rows.where("type = 'request'").count() == 6 and rows.where("type = 'warcinfo'").count() >= 1
    assert spark.read.format("warc").load(path).where("uri LIKE 'http://a%' AND type = 'response'").count() == 2


def test_payloads_are_not_inflated_unless_wanted(pages, tmp_path, monkeypatch, spark):
    from pyspark.sql.datasource import EqualTo
    from pyspark.sql.types import StructType

    path = str(tmp_path / "w")
    warc.from_pages(pages).coalesce(1).write.format("warc").mode("append").save(path)
    read = []
    real = warc._Gzip.payload
    monkeypatch.setattr(warc._Gzip, "payload", lambda self, h, s: (read.append(h["warc-type"]), real(self, h, s))[1])
    source = warc.WarcReader(StructType().add("type", "string").add("body", "string"), {"path": path})
    assert list(source.pushFilters([EqualTo(("type",), "response"), EqualTo(("body",), "x")])) == [EqualTo(("body",), "x")]
    n = sum(b.num_rows for p in source.partitions() for b in source.read(p))
    assert n == 5 and read == ["response"] * 5
    read.clear()
    heads = warc.WarcReader(StructType().add("uri", "string"), {"path": path})
    assert sum(b.num_rows for p in heads.partitions() for b in heads.read(p)) == 12 and not read


def test_plain_gzip_members_and_bare_line_ends(spark, tmp_path):
    warc.register(spark)
    a = warc.record("response", "http://x/", "2024-01-01T00:00:00Z", "text/plain", b"hello", [("X-A", "1")], "<urn:uuid:1>")
    b = b"WARC/1.0\nWARC-Type: metadata\nContent-Length: 2\nX-Folded: a\n b\n\nhi\n\n"
    (tmp_path / "m.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b))
    (tmp_path / "p.warc").write_bytes(a + b)
    (tmp_path / "ignored.txt").write_text("no")
    rows = spark.read.format("warc").load(str(tmp_path)).collect()
    want = [("response", "hello", None), ("metadata", "hi", "a b")]
    assert sorted((r.file[-3:], r.type, r.body, r.headers.get("x-folded")) for r in rows) == sorted([(e, *t) for e in (".gz", "arc") for t in want], key=lambda t: t[:2])


def test_damage_is_an_error_or_dropped(spark, tmp_path):
    warc.register(spark)
    a = warc.record("response", "http://x/", "2024-01-01T00:00:00Z", "text/plain", b"hello", [], "<urn:uuid:1>")
    (tmp_path / "p.warc").write_bytes(a + b"garbage here\r\n\r\n")
    with pytest.raises(Exception, match="no record begins"):
        spark.read.format("warc").load(str(tmp_path)).count()
    assert spark.read.format("warc").option("mode", "dropmalformed").load(str(tmp_path)).count() == 1


def test_no_pages(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.from_pages(pages.where("false")).write.format("warc").mode("append").save(path)
    assert warc.responses(spark, path).count() == 0


def _records(n, seed=0):
    """Records, some with a payload that looks like records and gzip members."""
    rng = np.random.default_rng(seed)
    for i in range(n):
        inner = warc.record("response", "http://in/", "d", "text/plain", b"x", [], "<i>")
        payload = bytes(rng.integers(0, 256, int(rng.integers(0, 3_000)), dtype=np.uint8)) + (b"\r\n\r\n" + inner + warc.member(inner)) * (i % 3 == 0)
        yield f"http://h/{i}", payload, warc.record("response", f"http://h/{i}", "2024", "text/plain", payload, [], f"<urn:{i}>")


@pytest.mark.parametrize("how", ["plain", "members", "one", "several"])
@pytest.mark.parametrize("split", [1_000, 20_000, 1 << 30])
def test_every_record_is_read_once_however_files_are_cut(tmp_path, how, split):
    made = list(_records(60))
    raw = [r for _, _, r in made]
    if how == "plain":
        (tmp_path / "a.warc").write_bytes(b"".join(raw))
    elif how == "members":
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.member, raw)))
    elif how == "one":  # compressed as a whole, without lengths
        (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(raw)))
    else:  # several records a member, with lengths
        (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(b"".join(raw[i : i + 7])) for i in range(0, 60, 7)))
    schema = T.StructType.fromDDL("uri string, payload binary")
    reader = warc.WarcReader(schema, {"path": str(tmp_path), "splitBytes": str(split)})
    parts = reader.partitions()
    assert (len(parts) > 1) == (how != "one" and split < 100_000) and len(parts) <= 64
    got = [(u, p) for part in parts for b in reader.read(part) for u, p in zip(b.column("uri").to_pylist(), b.column("payload").to_pylist())]
    assert got == [(u, p) for u, p, _ in made]
    heads = warc.WarcReader(T.StructType.fromDDL("uri string"), {"path": str(tmp_path), "splitBytes": str(split)})
    assert [u for part in heads.partitions() for b in heads.read(part) for u in b.column("uri").to_pylist()] == [u for u, _, _ in made]
