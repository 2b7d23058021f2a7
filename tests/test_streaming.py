"""Windowed group-by: a stream of files gives what the bounded table gives."""

import pytest

from loomframe.streaming.windows import group_by_window

SF = "/root/testdata/sf0.001"


def test_stream_and_table_agree(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) as ts", "event_type", "value")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    ask = lambda df: group_by_window(df, "ts", "1 day", ["event_type"], {"n": (len, "event_id"), "value": max, "first": (min, "event_id")}, late="1000 days")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ask(stream).writeStream.outputMode("complete").format("memory").queryName("lf_windows").start()
    try:
        query.processAllAvailable()
        found = sorted(map(tuple, spark.table("lf_windows").collect()))
    finally:
        query.stop()
    assert found == sorted(map(tuple, ask(events).collect())) and sum(r[3] for r in found) == events.count()
    with pytest.raises(ValueError):
        group_by_window(events, "ts", "1 day", [], {"value": lambda x: x.sum()})
