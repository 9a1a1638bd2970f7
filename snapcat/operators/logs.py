"""Transfer logs in batch.

Two forms: ``transfers`` from the reader (one row per finished or open transfer, with its updates in order), and the
line table ``file, seq, line, terminator, ts``. A transfer ends at its final line, so byte deltas never cross
transfers: with the first form they are computed inside the row, without any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcat.functions.sizes import line_bytes, with_line_bytes
from snapcat.operators.ordered import CHUNK_BITS, ordered_scan, salted_join

# Seconds of a job that are windowed together.
RATE_SPAN = 4096


def _intermediate() -> Column:
    return F.col("terminator") == "\r"


def bytes_delta(log: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds ``bytes`` and ``delta``: bytes sent since the previous line of the file; a final line resets the base."""
    sized = with_line_bytes(log)
    in_flight = F.when(_intermediate(), F.col("bytes")).otherwise(F.lit(0).cast("decimal(38,0)"))
    scanned = ordered_scan(sized, ["file"], ["seq"], lasts={"__base": in_flight}, bits=bits)
    zero = F.lit(0).cast("decimal(38,0)")
    return scanned.withColumn("delta", F.col("bytes") - F.coalesce("__base", zero)).drop("__base")


def bytes_transferred(log: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Bytes per file (or other grouping that keeps files whole): all final lines, plus the last line of the file if it
    is an intermediate one. One map-side combined aggregation, no sort of a file."""
    keys = ["file", *[c for c in by if c != "file"]]
    sized = with_line_bytes(log.select(*keys, "seq", "terminator", "line"), "b")
    per_file = sized.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~_intermediate(), F.col("b"))), F.lit(0)).alias("final"),
        F.max(F.struct("seq", F.when(_intermediate(), F.col("b")).otherwise(0).alias("open")))["open"].alias("open"),
    )
    total = F.col("final") + F.col("open")
    if tuple(by) == ("file",):
        return per_file.select("file", total.alias("bytes"))
    return per_file.groupBy(*by).agg(F.sum(total).alias("bytes"))


def transfer_bytes(transfers: DataFrame) -> DataFrame:
    """Bytes per file from the reader's form: the last update of each transfer, final or not."""
    last = line_bytes(F.element_at("updates", -1))
    return transfers.groupBy("file").agg(F.sum(last).alias("bytes"))


def transfer_deltas(transfers: DataFrame) -> DataFrame:
    """``file, pos, line, bytes, delta`` per update, computed within the row."""
    # each update beside the one before it, so that no output row carries the array
    steps = F.arrays_zip(
        F.col("updates").alias("line"), F.concat(F.array(F.lit(None).cast("string")), F.col("updates")).alias("before")
    )
    lines = transfers.select("file", F.posexplode(F.slice(steps, 1, F.size("updates"))).alias("pos", "step"))
    sent = line_bytes(F.col("step.line"))
    before = F.when(F.col("step.before").isNull(), F.lit(0).cast("decimal(38,0)")).otherwise(line_bytes(F.col("step.before")))
    return lines.select("file", "pos", "step.line", sent.alias("bytes"), (sent - before).alias("delta"))


def sliding_rate(
    deltas: DataFrame, window: int = 30, by: Sequence[str] = ("job",), second: str = "second"
) -> DataFrame:
    """Bytes per second over the last ``window`` seconds, for every second with a sample. At the start of a job the
    window only reaches back to its first sample.

    Samples are first summed per second. A job is cut into spans of time, each with the seconds before it that its
    windows reach back to, so a row is copied at most once and no job is ever windowed as a whole."""
    per_second = deltas.groupBy(*by, second).agg(F.sum("delta").alias("delta"))
    start = per_second.groupBy(*by).agg(F.min(second).alias("__start"))
    span = max(RATE_SPAN, window)
    own = F.floor(F.col(second) / span)
    reaches_on = F.pmod(F.col(second), F.lit(span)) >= span - (window - 1)
    spans = F.when(reaches_on, F.array(own, own + 1)).otherwise(F.array(own))
    spread = per_second.select("*", own.alias("__own"), F.explode(spans).alias("__span"))
    reach = Window.partitionBy(*by, "__span").orderBy(second).rangeBetween(-(window - 1), 0)
    summed = spread.withColumn("bytes", F.sum("delta").over(reach)).filter("__own = __span").select(*by, second, "bytes")
    rows = salted_join(summed, start, list(by), "inner", [second])
    elapsed = F.least(F.lit(window), F.col(second) - F.col("__start") + 1)
    rate = F.bround(F.col("bytes").cast("double") / elapsed, 0).cast("bigint")
    return rows.select(*by, second, "bytes", elapsed.cast("bigint").alias("elapsed"), rate.alias("rate"))
