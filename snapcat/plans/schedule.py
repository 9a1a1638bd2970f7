"""What is due: next period boundary per series, and the work that follows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.periods import PERIOD_MILLIS, Anchors, ntz_from_micros, round_up_micros, wall_micros
from snapcat.operators.labels import LABEL, minmax_by_label
from snapcat.plans.policy import Plan, check_periods, plan_frame, plan_labels, plan_units


def with_next_boundary(
    df: DataFrame, created: Column, zone: str, anchors: Anchors, units: Iterable[str] = tuple(PERIOD_MILLIS)
) -> DataFrame:
    """Adds ``__event``, the first boundary strictly after an instant (UTC seconds) as wall-clock microseconds of the
    zone, for the period in columns n and unit. The wall clock is a column of its own because rounding reads it often.
    """
    timed = df.withColumn("__wall", wall_micros(created, zone) + 1)
    event = round_up_micros(F.col("__wall"), F.col("n"), F.col("unit"), anchors, units)
    return timed.withColumn("__event", event).drop("__wall")


def due_series(
    datasets: DataFrame,
    minmax: DataFrame,
    plan: Plan,
    now: int,
    zone: str = "UTC",
    anchors: Anchors = Anchors(),
    always: bool = False,
) -> DataFrame:
    """Each (dataset, label) with the newest creation, the next event after it and whether that has passed. A dataset
    without any row of the series is due, as is everything with ``always`` and every label without a period.

    ``minmax`` comes from :func:`snapcat.operators.labels.minmax_by_label`, or from valid refresh state."""
    check_periods(plan)
    entries = plan_frame(datasets, plan).filter(F.col("amount") > 0).select(*LABEL, "n", "unit", "period_ms")
    rows = minmax.join(datasets.select("dataset").distinct(), "dataset", "left_semi").join(entries, list(LABEL))
    wall_now = wall_micros(F.lit(now), zone)
    timed = with_next_boundary(rows, F.col("latest_creation"), zone, anchors, plan_units(plan))
    due = F.lit(always) | (F.col("n") == 0) | (F.col("latest_creation") == 0) | (wall_now >= F.col("__event"))
    return timed.select(
        "dataset", *LABEL, "period_ms", "latest_creation", ntz_from_micros(F.col("__event")).alias("next_event"),
        due.alias("due"),
    )


def due_from_catalog(
    snaps: DataFrame,
    datasets: DataFrame,
    plan: Plan,
    now: int,
    zone: str = "UTC",
    anchors: Anchors = Anchors(),
    always: bool = False,
) -> DataFrame:
    minmax = minmax_by_label(snaps, datasets, plan_labels(plan))
    return due_series(datasets, minmax, plan, now, zone, anchors, always)


def next_event(
    plan: DataFrame, now: Column | int, zone: str = "UTC", anchors: Anchors = Anchors(), by: Sequence[str] = ()
) -> DataFrame:
    """The earliest boundary after ``now`` over all plan rows (columns n, unit), per ``by``."""
    now = now if isinstance(now, Column) else F.lit(now)
    rows = with_next_boundary(plan.filter(F.col("n") > 0), now, zone, anchors)
    return rows.groupBy(*by).agg(F.min("__event").alias("__event")).select(
        *by, ntz_from_micros(F.col("__event")).alias("next_event")
    )


def schedule_report(due: DataFrame) -> DataFrame:
    """All events by time, dataset and label, with the remark `` has passed`` on those that are due."""
    return due.select(
        "next_event", "dataset", *LABEL, F.when(F.col("due"), " has passed").otherwise("").alias("remark")
    ).orderBy("next_event", "dataset", *LABEL)


def merge_due(*parts: DataFrame) -> DataFrame:
    """Union of due (dataset, label) rows from several origins, each once."""
    merged = parts[0].select("dataset", *LABEL)
    for part in parts[1:]:
        merged = merged.unionByName(part.select("dataset", *LABEL))
    return merged.distinct()


def work_list(due: DataFrame) -> DataFrame:
    """What to snapshot: (label, dataset) rows, long periods first. A label may cover every dataset, so the rows stay
    rows (sorted by range) instead of one list per label."""
    wanted = due.filter("due").select("period_ms", *LABEL, "dataset").distinct()
    return wanted.orderBy(F.desc("period_ms"), *LABEL, "dataset")


def work_counts(due: DataFrame) -> DataFrame:
    return due.filter("due").groupBy(*LABEL).agg(F.count_distinct("dataset").alias("datasets"))
