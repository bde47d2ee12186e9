import pyarrow as pa

from foliospark.llm.common import cut, pieces, qualified, shared_dir, sized


def hinted(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_broadcast_only_what_is_small(spark, monkeypatch):
    table = cut(spark.range(1000), "some")
    assert hinted(sized(table)) and not hinted(sized(table, rows=999))
    monkeypatch.setattr("foliospark.llm.common.BROADCAST_BYTES", 100)
    assert not hinted(sized(table))


def test_cut_keeps_rows_and_schema(spark):
    empty = cut(spark.createDataFrame([], "a int, b array<string>"), "none")
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    assert shared_dir(spark) == shared_dir(spark)
    assert shared_dir(spark).removeprefix("file://") in cut(spark.range(5), "five").inputFiles()[0]


def test_qualified(spark):
    assert qualified(spark, "/a/b") == "file:/a/b" and qualified(spark, "file:///a/b") == "file:/a/b"


def test_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1201))], names=["x"])
    assert [p.num_rows for p in pieces([batch, batch.slice(0, 0)])] == [500, 500, 201]
