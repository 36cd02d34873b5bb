import datetime as dt

from panelforge.streaming.ewm import ewm_stream


def test_stream_equals_batch_and_drops_what_is_late(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "panel string, asset string, ts timestamp, y double"
    row = lambda a, i, v: ("p", a, start + dt.timedelta(minutes=i), v)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([row("a", i, float(i)) for i in (2, 0, 1)] + [row("b", 0, 8.0)], schema).coalesce(1).write.parquet(src)

    def drain():
        rows = spark.readStream.schema(schema).parquet(src)
        q = ewm_stream(rows, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    drain()
    spark.createDataFrame([row("a", 1, 100.0), row("a", 3, 3.0), row("b", 1, None)], schema).coalesce(1).write.mode("append").parquet(src)
    drain()
    got = sorted((r.asset, (r.ts - start).seconds // 60, r.ewm) for r in spark.read.parquet(out).collect())
    assert got == [("a", 0, 0.0), ("a", 1, 0.5), ("a", 2, 1.25), ("a", 3, 2.125), ("b", 0, 8.0)]
