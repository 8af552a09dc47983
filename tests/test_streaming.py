"""The same windows on a stream as on a table."""

import datetime as dt

from tessera.streaming.events import live_density, windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=37 * i), f"t{i % 3}", i / 4) for i in range(500)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("windows").collect()))
    assert got == sorted(map(tuple, windowed_counts(batch).collect())) and sum(r[2] for r in got) == 500


def test_live_density(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, i), 100 * i, 50) for i in range(10)]
    got = live_density(spark.createDataFrame(rows, "ts timestamp, mlat int, mlon int"), 8).collect()
    assert sum(r["n"] for r in got) == 10
