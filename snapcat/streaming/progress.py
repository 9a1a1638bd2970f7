"""Progress of running transfers as Structured Streaming queries.

Input: a stream of log lines ``file, seq, line, terminator, ts``. The aggregations are built-in and keep one row of
state per file. Only the per-line byte deltas need the previous line of a file; they carry it from batch to batch in a
table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from snapcat.functions.sizes import with_line_bytes, with_progress
from snapcat.operators.ordered import CHUNK_BITS, ordered_scan

OPEN_SCHEMA = "file STRING, seq BIGINT, open DECIMAL(38,0)"


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    old = context._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)


def stream_progress(lines: DataFrame) -> DataFrame:
    """Bytes per file so far: all final lines plus the open transfer. Update or complete mode.

    The deltas of a file telescope to exactly this sum, so no per-line state is needed."""
    intermediate = F.col("terminator") == "\r"
    sized = with_line_bytes(lines, "b")
    return sized.groupBy("file").agg(
        (
            F.coalesce(F.sum(F.when(~intermediate, F.col("b"))), F.lit(0))
            + F.max(F.struct("seq", F.when(intermediate, F.col("b")).otherwise(0).alias("open")))["open"]
        ).cast("decimal(38,0)").alias("bytes")
    )


def stream_eta(lines: DataFrame) -> DataFrame:
    """Newest line per file with its expected end (null-free: a line without ETA ends now). Update or complete mode;
    :func:`latest_eta` picks the last one to finish."""
    rows = with_progress(lines.select("file", "seq", "ts", "line"))
    eta = F.timestamp_seconds((F.unix_seconds("ts") + F.col("remaining_seconds")).cast("bigint"))
    return rows.groupBy("file").agg(
        F.max(F.struct("seq", eta.alias("eta"), "tail")).alias("last")
    ).select("file", "last.eta", "last.seq", "last.tail")


def latest_eta(etas: DataFrame) -> DataFrame:
    """The transfer that ends last; one row. For the batch inside ``foreachBatch``, or a batch table."""
    return etas.agg(F.max(F.struct("eta", "file", "tail")).alias("m")).select("m.eta", "m.file", "m.tail")


def stream_deltas(
    lines: DataFrame, state_path: str, sink: Callable[[DataFrame, int], None], bits: int = CHUNK_BITS
) -> DataStreamWriter:
    """A writer that hands ``file, seq, ts, delta`` of each micro-batch to ``sink(rows, batch_id)``. Set trigger and
    checkpoint, then start.

    What a transfer had sent when the last batch ended is a small table under ``state_path`` (a folder all executors
    share), one version per batch: a batch reads the version before its own, so repeating it after a failure gives
    the same rows. A busy log is split into chunks as in batch, never handled as one group."""

    def step(batch: DataFrame, batch_id: int) -> None:
        sized = with_line_bytes(batch.select("file", "seq", "ts", "terminator", "line")).drop("line")
        open_bytes = F.when(F.col("terminator") == "\r", F.col("bytes")).otherwise(F.lit(0).cast("decimal(38,0)"))
        rows = sized.withColumn("open", open_bytes).drop("terminator").withColumn("is_new", F.lit(True))
        if batch_id > 0:
            before = batch.sparkSession.read.schema(OPEN_SCHEMA).parquet(f"{state_path}/{batch_id - 1}")
            rows = rows.unionByName(before.withColumn("is_new", F.lit(False)), allowMissingColumns=True)
        last = F.max(F.struct("seq", "open")).alias("last")
        # a file whose transfer has ended starts from nothing, so only open ones are kept
        state = rows.groupBy("file").agg(last).select("file", "last.seq", "last.open").filter("open <> 0")
        state.write.mode("overwrite").parquet(f"{state_path}/{batch_id}")
        scanned = ordered_scan(rows, ["file"], ["seq"], lasts={"base": F.col("open")}, bits=bits)
        delta = F.col("bytes") - F.coalesce("base", F.lit(0).cast("decimal(38,0)"))
        sink(scanned.filter("is_new").select("file", "seq", "ts", delta.alias("delta")), batch_id)
        if batch_id > 1:  # the version before the one just read is of no use to any repeat
            _delete(batch.sparkSession, f"{state_path}/{batch_id - 2}")

    return lines.writeStream.foreachBatch(step)


def stream_rate(deltas: DataFrame, window: str = "30 seconds", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """Bytes per sliding window; rows later than the watermark are dropped."""
    seconds = F.unix_seconds(F.col("window.end")) - F.unix_seconds(F.col("window.start"))
    return (
        deltas.withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide))
        .agg(F.sum("delta").alias("bytes"))
        .select("window.start", "window.end", "bytes", (F.col("bytes") / seconds).alias("bytes_per_second"))
    )


RATE_SCHEMA = "start TIMESTAMP, end TIMESTAMP, bytes DECIMAL(38,0), bytes_per_second DOUBLE, batch BIGINT"


def stream_rate_table(
    deltas: DataFrame, path: str, window: str = "30 seconds", slide: str = "1 second", late: str = "1 minute"
) -> DataStreamWriter:
    """A writer that keeps the rates of all windows, also of those still open, under ``path`` (a folder all executors share).

    Each micro-batch writes the windows it changed as one version, so repeating a batch changes nothing; late samples make
    a new version of their window until the watermark has passed it, and the stream holds no state of older windows. Read
    the table with :func:`current_rates`. Set trigger and checkpoint, then start."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        numbers = {"bytes": "decimal(38,0)", "bytes_per_second": "double"}
        rows = batch.withColumns({c: F.col(c).cast(t) for c, t in numbers.items()})
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream_rate(deltas, window, slide, late).writeStream.outputMode("update").foreachBatch(keep)


def current_rates(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each window: ``start, end, bytes, bytes_per_second``."""
    versions = spark.read.schema(RATE_SCHEMA).parquet(path)
    newest = versions.groupBy("start", "end").agg(F.max(F.struct("batch", "bytes", "bytes_per_second")).alias("v"))
    return newest.select("start", "end", "v.bytes", "v.bytes_per_second")
