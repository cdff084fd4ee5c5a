"""Every query that is no part of the subpackage for training data against its SQL."""

import pytest

from lodestrata.plans import catalog

from .conftest import DATA, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA / "sf0.001"))
    names, rows = sql_rows(catalog.ORACLES[name], "sf0.001")
    assert sorted(df.columns) == names
    assert spark_rows(df) == rows


def test_checksum_is_that_of_all_but_the_last_eight_bytes(spark):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).select("doc_id", "text").collect()}
    for r in catalog.QUERIES["checksum"](spark, str(DATA / "sf0.001")).collect():
        assert r.crc == zlib.crc32(docs[r.doc_id].encode()[:-8])


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_a_lookup_is_a_filter_on_the_fields_of_all_documents(spark):
    sf = str(DATA / "sf0.001")
    every = catalog.QUERIES["doc_lookup"](spark, sf)
    assert every.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sorted(r.doc_id for r in every.where("doc_id IN (3, 7, 24, 99)").collect()) == [3, 7, 24, 99]
