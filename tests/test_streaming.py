"""An index that grows with a stream."""

from lodestrata.sources import segidx
from lodestrata.sources.segwrite import Field, write_index
from lodestrata.streaming.indexing import base36, index_stream


def test_generations():
    assert [base36(n) for n in (0, 1, 9, 10, 35, 36, 37)] == ["0", "1", "9", "a", "z", "10", "11"]


def test_streams_onto_an_index_that_exists(spark, tmp_path):
    """A new stream's first batch, another stream, and one whose last batch runs again."""
    index, fields = str(tmp_path / "index"), [Field("id", stored="long")]
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1)
    write_index(frame(1, 2), index, fields)

    def run(name, *ids):
        frame(*ids).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / name))
        index_stream(stream, index, fields, str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.long for r in segidx.read(spark, index, "stored").collect())

    assert run("a", 3, 4) == [1, 2, 3, 4]
    assert run("b", 5) == [1, 2, 3, 4, 5]
    assert run("a", 6) == [1, 2, 3, 4, 5, 6]
    (tmp_path / "a-state/commits/1").unlink()  # as if the run had failed after its commit point
    (tmp_path / "a-state/commits/.1.crc").unlink(missing_ok=True)
    assert run("a", 7) == [1, 2, 3, 4, 5, 6, 7]
    assert len(segidx.read(spark, index, "commit").first().user_data) == 2


def test_batches_become_segments_once(spark, tmp_path):
    source, index, state = (str(tmp_path / n) for n in ("in", "index", "state"))
    fields = [Field("id", stored="long"), Field("text", options=2, norms=True)]
    rows = [(i, f"word{i % 3} common") for i in range(30)]

    def run():
        stream = spark.readStream.schema("id long, text string").parquet(source)
        index_stream(stream, index, fields, state).trigger(availableNow=True).start().awaitTermination()

    for k in range(2):
        spark.createDataFrame(rows[k * 15 : k * 15 + 15], "id long, text string").coalesce(1).write.mode("append").parquet(source)
        run()
        assert sorted(r.long for r in segidx.read(spark, index, "stored").collect()) == list(range(15 * (k + 1)))
    run()  # nothing new
    assert segidx.read(spark, index, "segments").count() == 2
    assert segidx.read(spark, index, "terms").where("decode(term, 'UTF-8') = 'common'").groupBy().sum("doc_freq").first()[0] == 30
    assert segidx.read(spark, index, "segments", generation="1").count() == 1
