"""Streams over several micro-batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from snapcat.operators import logs
from snapcat.operators.labels import Label
from snapcat.schema import PROGRESS
from snapcat.streaming import progress, staleness
from tests.conftest import snapshots, values

LINES = [
    [("a", 0, "x: 10 B", "\r", 0), ("b", 0, "x: 7 B 0:0:1 [1B/s] [] ETA 0:00:09 ETA 1", "\r", 0)],
    [("a", 1, "x: 30 B", "\r", 1), ("a", 2, "x: 35 B", "\n", 2), ("a", 3, "x: 5 B", "\r", 3)],
    [("a", 4, "x: 9 B 0:0:1 [1B/s] [] ETA 0:00:02 ETA 1", "\r", 200)],
]


@pytest.fixture
def stream(spark, tmp_path):
    """Three files, read one per micro-batch."""
    table = None
    for i, rows in enumerate(LINES):
        df = spark.createDataFrame(rows, "file STRING, seq BIGINT, line STRING, terminator STRING, ts LONG")
        df = df.withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
        table = df if table is None else table.union(df)
    reader = spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", 1)
    return reader.parquet(str(tmp_path / "in" / "part=*")), table


def finish(writer, tmp_path):
    running = writer.option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    running.awaitTermination()


def final_state(df, tmp_path):
    seen = {}
    finish(df.writeStream.outputMode("complete").foreachBatch(lambda b, i: seen.update({i: b.collect()})), tmp_path)
    assert len(seen) == 3
    return seen[max(seen)]


def test_bytes(stream, tmp_path):
    got = {r["file"]: r["bytes"] for r in final_state(progress.stream_progress(stream[0]), tmp_path)}
    assert got == {"a": 44, "b": 7} == dict(values(logs.bytes_transferred(stream[1]), "file", "bytes"))


def test_deltas_carry_over_batches(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    writer = progress.stream_deltas(
        stream[0], str(tmp_path / "open"), lambda rows, i: rows.write.mode("overwrite").parquet(f"{out}/batch={i}"), bits=1
    )
    finish(writer, tmp_path)
    got = spark.read.parquet(out)
    assert values(got, "file", "seq", "delta") == values(logs.bytes_delta(stream[1], bits=1), "file", "seq", "delta")
    assert got.select("batch").distinct().count() == 3


def test_eta(spark, stream, tmp_path):
    rows = final_state(progress.stream_eta(stream[0]), tmp_path)
    assert {r["file"]: r["eta"].timestamp() for r in rows} == {"a": 202.0, "b": 9.0}
    latest = progress.latest_eta(spark.createDataFrame(rows)).first()
    assert latest["file"] == "a" and latest["tail"] == "[] ETA 0:00:02 ETA 1"


def test_rate_windows(spark, stream, tmp_path):
    deltas = stream[0].withColumn("delta", F.lit(10))
    out = str(tmp_path / "out")
    rates = progress.stream_rate(deltas, "2 seconds", "1 second")
    finish(rates.writeStream.outputMode("append").format("parquet").option("path", out), tmp_path)
    got = spark.read.parquet(out).select(F.unix_seconds("start").alias("s"), "bytes", "bytes_per_second")
    assert values(got, "s", "bytes", "bytes_per_second") == [(-1, 20, 10.0), (0, 30, 15.0), (1, 20, 10.0), (2, 20, 10.0), (3, 10, 5.0)]


def test_monitor(spark, tmp_path):
    labels = [Label("o_", "", "_hourly")]
    for i, (age, name) in enumerate([(100, "a"), (50, "b"), (10, "a")]):
        rows = snapshots(spark, [(f"tank/{name}@o_202{i}_hourly", str(i), 1000 - age, i)], root="tank")
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    schema = spark.read.parquet(str(tmp_path / "in" / "part=0")).schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "part=*"))
    alerts = spark.createDataFrame(
        [("o_", "", "_hourly", "latest", 20_000, None, False)],
        "prefix STRING, infix STRING, suffix STRING, which STRING, warning_ms BIGINT, critical_ms BIGINT, skip_holds BOOLEAN",
    )
    seen = {}
    writer = staleness.stream_monitor(feed, labels, alerts, lambda: 1000, lambda rows, i: seen.update({i: values(rows, "dataset", "level")}))
    finish(writer, tmp_path)
    assert seen == {0: [("tank/a", 1)], 1: [("tank/a", 1), ("tank/b", 1)], 2: [("tank/a", 0), ("tank/b", 1)]}
