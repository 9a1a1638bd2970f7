"""Continuous staleness monitor over a stream of snapshot rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from snapcat.operators.labels import LABEL, LABEL_TYPES, Label, label_frame, literal_rows, match_labels, minmax_columns
from snapcat.plans.monitor import monitor
from snapcat.schema import SNAPSHOT


def stream_minmax(snaps: DataFrame, labels: Sequence[Label]) -> DataFrame:
    """Newest and oldest row per (dataset, label) of everything seen so far; complete or update mode. State is one row
    per series, however many snapshots arrive."""
    held = F.coalesce("held", F.lit(False)) if "held" in snaps.columns else F.lit(False)
    rows = snaps.filter(F.col("kind") == SNAPSHOT).withColumn("held", held)
    narrow = rows.select("dataset", "tag", "createtxg", "creation", "held")
    position = F.struct("createtxg", "creation", "tag")
    best = match_labels(narrow, label_frame(snaps.sparkSession, labels)).groupBy("dataset", *LABEL).agg(
        F.max(position).alias("latest"),
        F.min(position).alias("oldest"),
        F.min(F.when(~F.col("held"), position)).alias("oldest_free"),
    )
    return best.select("dataset", *LABEL, *minmax_columns(("latest", "oldest", "oldest_free")))


def stream_monitor(
    snaps: DataFrame,
    labels: Sequence[Label],
    alerts: DataFrame,
    now: Callable[[], int],
    sink: Callable[[DataFrame, int], None],
    datasets: DataFrame | None = None,
) -> DataStreamWriter:
    """A writer that checks all series at every trigger and hands the alert rows to ``sink(rows, batch_id)``. Complete
    mode, because a series also goes stale when nothing arrives for it. Set trigger and checkpoint, then start.

    With ``datasets`` (column ``dataset``) every label is checked for each of them, also where no snapshot was ever seen."""

    def check(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if datasets is not None:
            every = F.inline(literal_rows([asdict(label) for label in dict.fromkeys(labels)], LABEL_TYPES))
            grid = datasets.select("dataset").distinct().select("dataset", every)
            rows = grid.join(batch, ["dataset", *LABEL], "left").fillna(0).fillna("")
        sink(monitor(rows, alerts, now()), batch_id)

    return stream_minmax(snaps, labels).writeStream.outputMode("complete").foreachBatch(check)
