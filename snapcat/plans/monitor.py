"""Staleness alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.human import human_duration
from snapcat.functions.periods import duration_millis
from snapcat.operators.labels import LABEL
from snapcat.plans.policy import period_columns

# Exit codes.
OK, WARNING, CRITICAL, DIE, STILL_RUNNING = 0, 1, 2, 3, 4


RowPlan = Mapping[str, Mapping[str, Mapping[str, Mapping[str, Mapping[str, object]]]]]
PLAN_ROW_TYPES = {
    "org": "string",
    "target": "string",
    "period": "string",
    "which": "string",
    "warning": "string",
    "critical": "string",
    "cycles": "int",
    "skip_holds": "boolean",
}


def monitor_plan_rows(plan: RowPlan) -> list[dict[str, object]]:
    """Rows of a nested plan {org: {target: {period: {latest / oldest: {warning, critical, cycles}}}}}; an oldest entry may
    have oldest_skip_holds. Cycles default to 1. What is none of that is an error."""
    rows = []
    for org, targets in plan.items():
        for target, periods in targets.items():
            for period, checks in periods.items():
                for which, limits in checks.items():
                    known = {"warning", "critical", "cycles", *(["oldest_skip_holds"] if which == "oldest" else [])}
                    holds = limits.get("oldest_skip_holds", False)
                    if which not in ("latest", "oldest") or not set(limits) <= known or not isinstance(holds, bool):
                        raise ValueError(f"no such check of {org}/{target}/{period}: {which} {dict(limits)}")
                    texts = {k: None if limits.get(k) is None else str(limits[k]) for k in ("warning", "critical")}
                    cycles = max(0, int(str(limits.get("cycles", 1))))
                    where = {"org": org, "target": target, "period": period, "which": which}
                    rows.append(where | texts | {"cycles": cycles, "skip_holds": holds})
    return rows


def alerts_of_rows(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Alerts like those of :func:`build_alerts` from rows of :func:`monitor_plan_rows`, with own limits and cycles for
    the latest and the oldest snapshot of a series."""
    timed = rows.withColumn("amount", F.col("cycles")).withColumns(period_columns())

    def threshold(name: str) -> Column:
        base = duration_millis(F.col(name), strict=True)
        return F.when(base > 0, base + F.col("cycles") * F.col("period_ms"))

    limits = timed.select(
        *keys, *LABEL, "period_ms", "which", threshold("warning").alias("warning_ms"),
        threshold("critical").alias("critical_ms"), F.coalesce("skip_holds", F.lit(False)).alias("skip_holds"),
    )
    return limits.filter(F.col("warning_ms").isNotNull() | F.col("critical_ms").isNotNull())


def build_alerts(
    monitor: DataFrame,
    plan: DataFrame,
    side: str = "src",
    check_latest: bool = True,
    check_oldest: bool = True,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Thresholds per label and ``which`` (latest / oldest).

    ``monitor``: org, target, period, warning, critical (duration text), optionally src_snapshot_cycles /
    dst_snapshot_cycles and oldest_skip_holds. The oldest row may be as many periods older as the snapshot plan
    (org, target, period, amount) keeps, or as the cycles column says; the latest one period. A threshold that is not
    set is null: it never fires."""
    on = [*keys, "org", "target", "period"]
    rows = monitor.join(plan.select(*on, "amount"), on, "left")
    override = f"{side}_snapshot_cycles"
    cycles = F.coalesce(F.col(override) if override in monitor.columns else F.lit(None), F.col("amount"), F.lit(1))
    holds = F.col("oldest_skip_holds") if "oldest_skip_holds" in monitor.columns else F.lit(False)
    checks = []
    if check_latest:
        checks.append(F.struct(F.lit("latest").alias("which"), F.lit(1).alias("cycles"), F.lit(False).alias("skip_holds")))
    if check_oldest:
        checks.append(
            F.struct(F.lit("oldest").alias("which"), cycles.cast("int").alias("cycles"),
                     F.coalesce(holds, F.lit(False)).alias("skip_holds"))
        )
    timed = rows.withColumns(period_columns()).withColumn("__check", F.explode(F.array(*checks)))

    def threshold(name: str) -> Column:
        base = duration_millis(F.col(name), strict=True)
        return F.when(base > 0, base + F.col("__check.cycles") * F.col("period_ms"))

    limits = timed.select(
        *keys,
        *LABEL,
        "period_ms",
        F.col("__check.which").alias("which"),
        threshold("warning").alias("warning_ms"),
        threshold("critical").alias("critical_ms"),
        F.col("__check.skip_holds").alias("skip_holds"),
    )
    return limits.filter(F.col("warning_ms").isNotNull() | F.col("critical_ms").isNotNull())


def monitor(
    minmax: DataFrame, alerts: DataFrame, now: int, dont_warn: bool = False, dont_crit: bool = False
) -> DataFrame:
    """One row per dataset and alert: age, code (0 ok, 1 warning, 2 critical) and message. A missing series has age
    ``now``. Limits are exceeded strictly; the mutes turn a level into code 0 but leave the level readable.

    An alert with ``skip_holds`` looks at the oldest row that is not held where ``minmax`` has it (``free`` of
    ``minmax_by_label``); otherwise the rule given there holds."""
    rows = minmax.join(alerts, list(LABEL))
    is_latest = F.col("which") == "latest"

    def chosen(name: str) -> Column:
        oldest = F.col(f"oldest_{name}")
        if f"oldest_free_{name}" in minmax.columns:
            oldest = F.when(F.col("skip_holds"), F.col(f"oldest_free_{name}")).otherwise(oldest)
        return F.when(is_latest, F.col(f"latest_{name}")).otherwise(oldest)

    created, tag = chosen("creation"), chosen("tag")
    age = (F.lit(now).cast("bigint") - created) * 1000
    timed = rows.withColumns({"creation": created, "tag": tag, "age_ms": age})
    level = F.when(F.col("age_ms") > F.col("critical_ms"), CRITICAL).when(
        F.col("age_ms") > F.col("warning_ms"), WARNING
    ).otherwise(OK)
    muted = (F.lit(dont_crit) & (F.col("level") == CRITICAL)) | (F.lit(dont_warn) & (F.col("level") == WARNING))
    kind = F.when(is_latest, "Latest").otherwise("Oldest")
    return timed.withColumn("level", level).select(
        "dataset",
        *LABEL,
        "which",
        "creation",
        "tag",
        "age_ms",
        "level",
        F.when(muted, OK).otherwise(F.col("level")).alias("code"),
        kind.alias("kind"),
        alert_message(kind, now).alias("message"),
    )


def alert_message(kind: Column, now: int) -> Column:
    series = F.concat("dataset", F.lit("@"), "prefix", "infix", F.lit("<timestamp>"), "suffix")
    limit = F.when(F.col("level") == CRITICAL, F.col("critical_ms")).when(F.col("level") == WARNING, F.col("warning_ms"))
    return F.when(F.col("age_ms") >= now * 1000, F.concat(F.lit("No snapshot exists for "), series)).otherwise(
        F.concat(
            kind, F.lit(" snapshot for "), series, F.lit(" is "), human_duration(F.col("age_ms"), "ms"), F.lit(" old"),
            F.when(limit.isNull(), "").otherwise(
                F.concat(F.lit(" but should be at most "), human_duration(limit, "ms"), F.lit(" old"))
            ),
            F.when(F.col("tag") == "", "").otherwise(F.concat(F.lit(": @"), "tag")),
        )
    )


def worst_alert(*results: DataFrame) -> DataFrame:
    """The worst of all alerts as one row: highest code, then Latest before Oldest, then message."""
    rank = F.struct((-F.col("code")).alias("neg"), "kind", "message")
    merged = None
    for result in results:
        part = result.filter(F.col("code") > 0).agg(F.min(rank).alias("worst"))
        merged = part if merged is None else merged.unionByName(part)
    worst = merged.agg(F.min("worst").alias("worst"))
    return worst.select(
        F.coalesce(-F.col("worst.neg"), F.lit(OK)).alias("code"),
        F.coalesce("worst.kind", F.lit("")).alias("kind"),
        F.coalesce("worst.message", F.lit("")).alias("message"),
    )
