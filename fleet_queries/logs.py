"""Transfer logs, in batch and as streams. Log lines are rendered from events: one log per user."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, NOW, SRC_ROOT, event_columns, query, table
from snapcat.functions.periods import micros_from_ntz
from snapcat.functions.sizes import with_line_bytes
from snapcat.operators import logs
from snapcat.plans.monitor import build_alerts
from snapcat.plans.policy import PLAN_TYPES, plan_rows
from snapcat.operators.labels import Label, literal_frame
from snapcat.session import ensure_checkpoint_dir
from snapcat.streaming import progress, staleness

# what the rendered lines stand for, straight from the event columns
LINES_SQL = """
WITH l AS (
  SELECT 'u' || user_id AS file, event_id AS seq, ts, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS second,
    event_type = 'error' AS final, CAST(floor(value * 100) AS BIGINT) AS w,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events
), lines AS (
  SELECT *, CAST(CASE WHEN k < 5 THEN 0 WHEN k < 30 THEN w * 1024 WHEN k < 60 THEN w * 1000000
    WHEN k < 80 THEN round_even(w / 8.0, 0) ELSE w * 1073741824 END AS BIGINT) AS bytes,
    CASE WHEN k < 5 THEN 0 WHEN k >= 90 THEN 2 * 86400 + 39 ELSE k * 60 + 3 END AS remaining FROM l
), deltas AS (
  SELECT *, bytes - coalesce(lag(CASE WHEN final THEN 0 ELSE bytes END) OVER (PARTITION BY file ORDER BY seq), 0) AS delta FROM lines
)"""


def log_lines(df):
    k, written = F.col("k"), F.floor(F.col("value") * 100).cast("bigint").cast("string")
    unit = F.when(k < 30, "KiB").when(k < 60, " MB").when(k < 80, "b").otherwise("GiB")
    hours, minutes = F.floor(k / 60).cast("string"), F.lpad((k % 60).cast("string"), 2, "0")
    eta = F.when(k >= 90, "2+0:00:39").otherwise(F.concat(hours, F.lit(":"), minutes, F.lit(":03")))
    line = F.concat(
        F.lit("pool 40 GiB/ 3 B: "), written, unit, F.lit(" 0:07:31 [ 77MiB/s] [ 64MiB/s] [####....] 51% ETA "), eta,
        F.lit(" ETA 09:14:20"),
    )
    ts = F.col("ts").cast("timestamp_ntz")
    return df.withColumn("k", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("bigint")).select(
        F.concat(F.lit("u"), "user_id").alias("file"),
        F.col("event_id").alias("seq"),
        F.when(k < 5, "starting").otherwise(line).alias("line"),
        F.when(F.col("event_type") == "error", "\n").otherwise("\r").alias("terminator"),
        F.timestamp_micros(micros_from_ntz(ts)).alias("ts"),
        F.floor(micros_from_ntz(ts) / 1_000_000).cast("bigint").alias("second"),
        F.col("event_type").alias("job"),
    )


@query(
    LINES_SQL + """
, last AS (SELECT file, arg_max(CASE WHEN final THEN 0 ELSE bytes END, seq) AS open FROM lines GROUP BY file)
SELECT file, CAST(coalesce(sum(bytes) FILTER (WHERE final), 0) + any_value(open) AS BIGINT) AS bytes FROM lines JOIN last USING (file) GROUP BY file"""
)
def log_bytes(spark, sf_dir):
    rows = logs.bytes_transferred(log_lines(table(spark, sf_dir, "events")))
    return rows.withColumn("bytes", F.col("bytes").cast("bigint"))


@query(LINES_SQL + "SELECT file, seq, bytes, delta FROM deltas")
def log_deltas(spark, sf_dir):
    rows = logs.bytes_delta(log_lines(table(spark, sf_dir, "events")))
    return rows.select("file", "seq", F.col("bytes").cast("bigint"), F.col("delta").cast("bigint"))


@query(
    LINES_SQL + """
, s AS (SELECT event_type AS job, second, sum(delta) AS d FROM deltas GROUP BY 1, 2
), r AS (
  SELECT job, second, sum(d) OVER (PARTITION BY job ORDER BY second RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS bytes,
    least(30, second - min(second) OVER (PARTITION BY job) + 1) AS elapsed FROM s
)
SELECT job, second, CAST(bytes AS BIGINT) AS bytes, elapsed, CAST(round_even(bytes / elapsed, 0) AS BIGINT) AS rate FROM r"""
)
def log_rate(spark, sf_dir):
    rows = logs.sliding_rate(logs.bytes_delta(log_lines(table(spark, sf_dir, "events"))))
    return rows.withColumn("bytes", F.col("bytes").cast("bigint"))


# --- streams: the events arrive as a file stream and are processed to the end ------------------------------------


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def run(spark, stream, mode, name):
    """Processes what is there and returns the result as a table in the shared checkpoint folder."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    result = f"{base}/result"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        running = writer.outputMode("append").format("parquet").start(result)
    else:
        def overwrite(batch, batch_id):
            batch.write.mode("overwrite").parquet(result)

        running = writer.outputMode(mode).foreachBatch(overwrite).start()
    running.awaitTermination()
    return spark.read.parquet(result)


@query(LINES_SQL + """
, last AS (SELECT file, arg_max(CASE WHEN final THEN 0 ELSE bytes END, seq) AS open FROM lines GROUP BY file)
SELECT file, CAST(coalesce(sum(bytes) FILTER (WHERE final), 0) + any_value(open) AS BIGINT) AS bytes FROM lines JOIN last USING (file) GROUP BY file""")
def stream_bytes(spark, sf_dir):
    rows = run(spark, progress.stream_progress(log_lines(event_stream(spark, sf_dir))), "complete", "stream_bytes")
    return rows.withColumn("bytes", F.col("bytes").cast("bigint"))


@query(LINES_SQL + "SELECT file, seq, delta FROM deltas")
def stream_deltas(spark, sf_dir):
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream_deltas-{uuid.uuid4().hex}")

    def sink(deltas, batch_id):
        deltas.write.mode("overwrite").parquet(f"{base}/result/batch={batch_id}")

    writer = progress.stream_deltas(log_lines(event_stream(spark, sf_dir)), f"{base}/open", sink)
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/result").select("file", "seq", F.col("delta").cast("bigint"))


@query(
    LINES_SQL + """
, last AS (SELECT file, arg_max(remaining + CAST(floor(epoch(ts)) AS BIGINT), seq) AS eta FROM lines GROUP BY file)
SELECT file, eta FROM last"""
)
def stream_eta(spark, sf_dir):
    etas = run(spark, progress.stream_eta(log_lines(event_stream(spark, sf_dir))), "complete", "stream_eta")
    return etas.select("file", F.unix_seconds("eta").alias("eta"))


@query(
    LINES_SQL + """
, windows AS (
  SELECT second // 1800 * 1800 - n * 1800 AS start, bytes FROM lines, range(0, 2) t(n)
), late AS (SELECT max(epoch_us(ts)) - 60000000 AS mark FROM lines)
SELECT start, CAST(sum(bytes) AS BIGINT) AS bytes FROM windows WHERE (start + 3600) * 1000000 <= (SELECT mark FROM late)
GROUP BY start"""
)
def stream_rate(spark, sf_dir):
    """Hourly windows every half hour; windows still open at the watermark are not reported yet."""


    sized = with_line_bytes(log_lines(event_stream(spark, sf_dir)), "delta")
    rates = run(spark, progress.stream_rate(sized, "1 hour", "30 minutes"), "append", "stream_rate")
    return rates.select(F.unix_seconds("start").alias("start"), F.col("bytes").cast("bigint"))


STREAM_LABELS = [Label("prod_", "onsite_", "_hourly"), Label("prod_", "", "_weekly")]


@query(
    CATALOG_SQL + f"""
, labels(suffix, pat, warning, critical) AS (VALUES ('_hourly', 'prod_onsite_.*_hourly', 86400000 + 3600000, 864000000 + 3600000),
  ('_weekly', 'prod_[1-9][0-9]{{3}}.*_weekly', 86400000 + 604800000, 864000000 + 604800000)
), found AS (
  SELECT '{SRC_ROOT}' || rel_dataset AS dataset, suffix, warning, critical, ({NOW} - arg_max(creation, event_id)) * 1000 AS age_ms
  FROM ev2 JOIN labels ON regexp_full_match(tag0, pat) GROUP BY ALL
)
SELECT dataset, suffix, age_ms, CASE WHEN age_ms > critical THEN 2 WHEN age_ms > warning THEN 1 ELSE 0 END AS level FROM found"""
)
def stream_staleness(spark, sf_dir):
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream_staleness-{uuid.uuid4().hex}")
    stream = event_stream(spark, sf_dir)
    types = {"org": "string", "target": "string", "period": "string", "warning": "string", "critical": "string"}
    plan = {"prod": {"onsite": {"hourly": 36}, "": {"weekly": 4}}}
    limits = [{**row, "warning": "1days", "critical": "10days"} for row in plan_rows(plan)]
    alerts = build_alerts(
        literal_frame(spark, limits, types), literal_frame(spark, plan_rows(plan), PLAN_TYPES), check_oldest=False
    )
    rows = snapshot_stream(stream)
    writer = staleness.stream_monitor(
        rows, STREAM_LABELS, alerts, lambda: NOW, lambda alert, _: alert.write.mode("overwrite").parquet(f"{base}/result")
    )
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/result").select("dataset", "suffix", "age_ms", "level")


def snapshot_stream(stream):


    ev = event_columns(stream)
    return ev.select(
        F.concat(F.lit(SRC_ROOT), "rel_dataset").alias("dataset"), F.lit("snapshot").alias("kind"), "tag",
        F.col("event_id").alias("createtxg"), "creation",
    )
