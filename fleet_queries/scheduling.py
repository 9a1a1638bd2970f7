"""Newest and oldest per series, calendar rounding, due events and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, NOW, catalog, dataset_list, query, table
from snapcat.functions.periods import Anchors, round_up
from snapcat.operators.labels import Label, literal_frame, minmax_by_label, without_snapshots
from snapcat.plans import monitor as monitoring
from snapcat.plans import policy, schedule

LABELS = [
    Label("prod_", "onsite_", "_minutely"),
    Label("prod_", "onsite_", "_hourly"),
    Label("prod_", "onsite_", "_daily"),
    Label("prod_", "", "_weekly"),
    Label("prod_", "", "_monthly"),
]
SCHEDULE = {"prod": {"onsite": {"minutely": 2, "hourly": 36, "daily": 31}, "": {"weekly": 4, "monthly": 6}}}
ANCHORS = Anchors(
    weekly_weekday=2, weekly_hour=3, daily_hour=4, daily_minute=30, hourly_minute=15, monthly_monthday=31,
    monthly_month=2, monthly_hour=6, yearly_year=2022, yearly_month=2, yearly_monthday=29, yearly_hour=1,
    minutely_second=20,
)

MINMAX_SQL = CATALOG_SQL + """
, labels(prefix, infix, suffix, pat, unit, n) AS (VALUES
  ('prod_', 'onsite_', '_minutely', 'prod_onsite_.*_minutely', 'minutely', 2),
  ('prod_', 'onsite_', '_hourly', 'prod_onsite_.*_hourly', 'hourly', 36),
  ('prod_', 'onsite_', '_daily', 'prod_onsite_.*_daily', 'daily', 31),
  ('prod_', '', '_weekly', 'prod_[1-9][0-9]{3}.*_weekly', 'weekly', 4),
  ('prod_', '', '_monthly', 'prod_[1-9][0-9]{3}.*_monthly', 'monthly', 6)
), found AS (
  SELECT dataset, pat, arg_max(creation, createtxg) AS latest, arg_max(tag, createtxg) AS latest_tag,
    arg_min(creation, createtxg) FILTER (WHERE NOT held) AS oldest, arg_min(tag, createtxg) FILTER (WHERE NOT held) AS oldest_tag
  FROM dst JOIN labels ON regexp_full_match(tag, pat) WHERE kind = 'snapshot' GROUP BY dataset, pat
), sets AS (SELECT dataset FROM dst_ds UNION SELECT '{root}' || rel_dataset FROM src_ds
), minmax AS (
  SELECT sets.dataset, prefix, infix, suffix, unit, n, coalesce(latest, 0) AS latest_creation,
    coalesce(latest_tag, '') AS latest_tag, coalesce(oldest, 0) AS oldest_creation, coalesce(oldest_tag, '') AS oldest_tag
  FROM sets CROSS JOIN labels LEFT JOIN found ON found.dataset = sets.dataset AND found.pat = labels.pat
)""".replace("{root}", "tank2/dst")


def known_datasets(spark, sf_dir):
    """Datasets of the destination plus the places of those that only exist on the source."""
    src = dataset_list(spark, sf_dir, "src").select(F.concat(F.lit("tank2/dst"), "rel_dataset").alias("dataset"))
    return dataset_list(spark, sf_dir, "dst").select("dataset").unionByName(src).distinct()


def minmax_rows(spark, sf_dir):
    return minmax_by_label(catalog(spark, sf_dir, "dst"), known_datasets(spark, sf_dir), LABELS, skip_holds=True)


@query(
    MINMAX_SQL + "SELECT dataset, prefix, infix, suffix, latest_creation, latest_tag, oldest_creation, oldest_tag FROM minmax"
)
def minmax_series(spark, sf_dir):
    return minmax_rows(spark, sf_dir)


@query(
    CATALOG_SQL + """
SELECT dataset FROM src_ds WHERE dataset NOT IN
  (SELECT dataset FROM src WHERE held AND regexp_full_match(tag, '.*_weekly'))"""
)
def datasets_without_rows(spark, sf_dir):
    snaps = catalog(spark, sf_dir, "src").filter(F.col("held") & F.endswith("tag", F.lit("_weekly")))
    return without_snapshots(dataset_list(spark, sf_dir, "src").select("dataset"), snaps)


ALERT_SQL = MINMAX_SQL + f"""
, limits(suffix, which, warning, critical) AS (VALUES
  ('_minutely', 'latest', 30000000::BIGINT + 60000, 300000000 + 60000), ('_minutely', 'oldest', 30000000 + 120000, 300000000 + 120000),
  ('_hourly', 'latest', 86400000 + 3600000, NULL), ('_hourly', 'oldest', 86400000 + 7 * 3600000, NULL),
  ('_daily', 'latest', NULL, 172800000::BIGINT + 86400000), ('_daily', 'oldest', NULL, 172800000 + 31 * 86400000::BIGINT),
  ('_weekly', 'latest', 86400000 + 604800000, 864000000 + 604800000),
  ('_weekly', 'oldest', 86400000 + 4 * 604800000::BIGINT, 864000000 + 4 * 604800000::BIGINT)
), ages AS (
  SELECT m.*, which, warning, critical, ({NOW} - CASE which WHEN 'latest' THEN latest_creation ELSE oldest_creation END) * 1000 AS age_ms
  FROM minmax m JOIN limits USING (suffix)
), judged AS (
  SELECT *, CASE WHEN age_ms > critical THEN 2 WHEN age_ms > warning THEN 1 ELSE 0 END AS level FROM ages
)"""


def alert_rows(spark, sf_dir):
    plan = literal_frame(spark, policy.plan_rows(SCHEDULE), policy.PLAN_TYPES)
    types = {"org": "string", "target": "string", "period": "string", "warning": "string", "critical": "string",
             "src_snapshot_cycles": "int", "dst_snapshot_cycles": "int", "oldest_skip_holds": "boolean"}

    def row(target, period, warning, critical, cycles=None):
        return dict(org="prod", target=target, period=period, warning=warning, critical=critical,
                    src_snapshot_cycles=1, dst_snapshot_cycles=cycles, oldest_skip_holds=True)

    monitor_plan = literal_frame(spark, [
        row("onsite", "minutely", "30000 seconds", "300000 secs"),
        row("onsite", "hourly", "1 days", "0 days", 7),
        row("onsite", "daily", "0days", "2days"),
        row("", "weekly", "24hours", "10 days"),
        row("", "monthly", "0 millis", "0 millis"),
    ], types)
    return monitoring.build_alerts(monitor_plan, plan, side="dst")


@query(
    ALERT_SQL + """
SELECT dataset, prefix, infix, suffix, which, age_ms, level, CASE WHEN level = 1 THEN 0 ELSE level END AS code FROM judged"""
)
def monitor_alerts(spark, sf_dir):
    rows = monitoring.monitor(minmax_rows(spark, sf_dir), alert_rows(spark, sf_dir), NOW, dont_warn=True)
    return rows.select("dataset", "prefix", "infix", "suffix", "which", "age_ms", "level", "code")


@query(
    ALERT_SQL + """
SELECT max(level) AS code, CASE WHEN max(level) = 0 THEN '' WHEN count(*) FILTER (WHERE which = 'latest' AND level = 2) > 0
  OR (max(level) = 1 AND count(*) FILTER (WHERE which = 'latest' AND level = 1) > 0) THEN 'Latest' ELSE 'Oldest' END AS kind
FROM judged"""
)
def monitor_worst(spark, sf_dir):
    rows = monitoring.monitor(minmax_rows(spark, sf_dir), alert_rows(spark, sf_dir), NOW)
    return monitoring.worst_alert(rows).select("code", "kind")


# fixed-length units: anchor of the same day or week, one step back if it lies ahead, then the next multiple (microseconds)
ROUND_SQL = """
, base AS (SELECT {key}, {ts} AS us, ({ts}) // 86400000000 * 86400000000 AS day FROM {source}
), anchored AS (
  SELECT *, day + 20000000 AS mi, day + 900000000 AS ho, day + 16200000000 AS da,
    day - ((day // 86400000000 + 4 - 2) % 7) * 86400000000 + 10800000000 AS we FROM base
), stepped AS (
  SELECT *, CASE WHEN mi <= us THEN mi ELSE mi - 60000000 END AS mi1, CASE WHEN ho <= us THEN ho ELSE ho - 86400000000 END AS ho1,
    CASE WHEN da <= us THEN da ELSE da - 86400000000 END AS da1, CASE WHEN we <= us THEN we ELSE we - 604800000000 END AS we1
  FROM anchored
)"""


def up(anchor: str, period: int) -> str:
    return f"make_timestamp(CAST(us + ({period} - (us - {anchor}) % {period}) % {period} AS BIGINT))"


@query(
    "WITH z AS (SELECT 1)" + ROUND_SQL.replace("{source}", "events").replace("{key}", "event_id").replace("{ts}", "epoch_us(ts)")
    + f"""
SELECT event_id, {up('day', 250_000)} AS ms250, {up('day', 5_000_000)} AS s5, {up('mi1', 600_000_000)} AS min10,
  {up('ho1', 7_200_000_000)} AS h2, {up('da1', 86_400_000_000)} AS d1, {up('da1', 3 * 86_400_000_000)} AS d3,
  {up('we1', 604_800_000_000)} AS w1 FROM stepped"""
)
def round_up_fixed(spark, sf_dir):
    ts = F.col("ts").cast("timestamp_ntz")
    columns = {"ms250": (250, "millisecondly"), "s5": (5, "secondly"), "min10": (10, "minutely"), "h2": (2, "hourly"),
               "d1": (1, "daily"), "d3": (3, "daily"), "w1": (1, "weekly")}
    return table(spark, sf_dir, "events").select(
        "event_id", *[round_up(ts, n, unit, ANCHORS).alias(c) for c, (n, unit) in columns.items()]
    )


def month_end(expr: str) -> str:
    return f"day(last_day({expr}))"


# anchor day 31 in February clamps to the 28th or 29th, and every step goes on from the clamped day
CALENDAR_SQL = """
WITH o AS (SELECT o_orderkey, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS d FROM orders
), m0 AS (
  SELECT *, last_day(make_date(year(d), 2, 1)) AS a FROM o
), m1 AS (
  SELECT *, CASE WHEN a + INTERVAL 6 HOUR > ts THEN CAST(a - to_months({n}) AS DATE) ELSE a END AS b FROM m0
), m2 AS (
  SELECT *, (year(d) - year(b)) * 12 + month(d) - month(b) AS behind FROM m1
), m3 AS (
  SELECT *, CAST(b + to_months(CAST({n} * floor(behind / {n}) AS INTEGER)) AS DATE) AS c FROM m2
)
SELECT o_orderkey, CASE WHEN c + INTERVAL 6 HOUR < ts THEN CAST(c + to_months({n}) AS DATE) + INTERVAL 6 HOUR
  ELSE c + INTERVAL 6 HOUR END AS rounded FROM m3"""


@query(CALENDAR_SQL.replace("{n}", "1"))
def round_up_month(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", round_up(when, 1, "monthly", ANCHORS).alias("rounded"))


@query(CALENDAR_SQL.replace("{n}", "3"))
def round_up_quarter(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", round_up(when, 3, "monthly", ANCHORS).alias("rounded"))


@query(
    """
WITH o AS (SELECT o_orderkey, o_orderdate AS ts, year(o_orderdate) - ((year(o_orderdate) - 2022) % 2 + 2) % 2 AS y FROM orders
), a AS (SELECT *, last_day(make_date(y, 2, 1)) AS d FROM o)
SELECT o_orderkey, CASE WHEN d + INTERVAL 1 HOUR < ts THEN CAST(d + INTERVAL 2 YEAR AS DATE) + INTERVAL 1 HOUR
  ELSE d + INTERVAL 1 HOUR END AS rounded FROM a"""
)
def round_up_two_years(spark, sf_dir):
    when = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf_dir, "orders").select("o_orderkey", round_up(when, 2, "yearly", ANCHORS).alias("rounded"))


DUE_SQL = MINMAX_SQL + f"""
, timed AS (
  SELECT *, latest_creation * 1000000 + 1 AS us FROM minmax
), events_at AS (
  SELECT *, CASE unit
    WHEN 'minutely' THEN us + (60000000 - us % 60000000) % 60000000
    WHEN 'hourly' THEN us + (3600000000 - us % 3600000000) % 3600000000
    WHEN 'daily' THEN us + (86400000000 - us % 86400000000) % 86400000000
    WHEN 'weekly' THEN us + (604800000000 - (us + 4 * 86400000000) % 604800000000) % 604800000000
    ELSE epoch_us(date_trunc('month', make_timestamp(us - 1)) + INTERVAL 1 MONTH) END AS next_us FROM timed
), due AS (
  SELECT *, latest_creation = 0 OR {NOW}::BIGINT * 1000000 >= next_us AS due FROM events_at
)"""


def due_rows(spark, sf_dir):
    return schedule.due_series(known_datasets(spark, sf_dir), minmax_rows(spark, sf_dir), SCHEDULE, NOW)


@query(
    DUE_SQL + "SELECT dataset, prefix, infix, suffix, latest_creation, make_timestamp(CAST(next_us AS BIGINT)) AS next_event, due FROM due"
)
def due_series(spark, sf_dir):
    return due_rows(spark, sf_dir).drop("period_ms")


@query(
    DUE_SQL + """
SELECT make_timestamp(CAST(next_us AS BIGINT)) AS next_event, dataset, prefix, infix, suffix,
  CASE WHEN due THEN ' has passed' ELSE '' END AS remark FROM due"""
)
def schedule_report(spark, sf_dir):
    return schedule.schedule_report(due_rows(spark, sf_dir))


@query(
    DUE_SQL + """
, merged AS (SELECT dataset, prefix, infix, suffix FROM due WHERE due
  UNION SELECT dataset, 'prod_', '', '_weekly' FROM sets)
SELECT prefix, infix, suffix, count(*) AS datasets FROM merged GROUP BY prefix, infix, suffix"""
)
def due_work(spark, sf_dir):
    """Due series, united with one label that is taken regardless; datasets per label."""
    due = due_rows(spark, sf_dir).filter("due")
    weekly = Label("prod_", "", "_weekly")
    always = known_datasets(spark, sf_dir).select(
        "dataset", F.lit(weekly.prefix).alias("prefix"), F.lit(weekly.infix).alias("infix"), F.lit(weekly.suffix).alias("suffix")
    )
    return schedule.work_counts(schedule.merge_due(due, always).withColumn("due", F.lit(True)))


@query(
    DUE_SQL + "SELECT dataset, prefix, infix, suffix FROM due WHERE due"
)
def work_list(spark, sf_dir):
    return schedule.work_list(due_rows(spark, sf_dir)).select("dataset", "prefix", "infix", "suffix")


@query(
    """
WITH p AS (SELECT o_custkey, epoch_us(max(o_orderdate)) + 1 AS us FROM orders GROUP BY o_custkey)
SELECT o_custkey, make_timestamp(CAST(least(us + (21600000000 - us % 21600000000) % 21600000000,
  epoch_us(date_trunc('month', make_timestamp(us - 1)) + INTERVAL 1 MONTH)) AS BIGINT)) AS next_event FROM p"""
)
def next_event(spark, sf_dir):
    """The next of the 6-hourly and monthly boundaries after each customer's last order."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    seconds = F.unix_date(F.col("last").cast("date")).cast("bigint") * 86400
    plan = F.map_from_arrays(F.array(F.lit("6hourly"), F.lit("monthly")), F.array(F.lit(1), F.lit(1)))
    plans = last.select(
        "o_custkey", seconds.alias("at"),
        F.create_map(F.lit("prod"), F.create_map(F.lit("onsite"), plan)).alias("plan"),
    )
    return schedule.next_event(policy.explode_plan(plans), F.col("at"), by=["o_custkey"])


@query(
    """
SELECT n_nationkey, org, target, period, amount, period_ms, window_ms FROM (
  SELECT n_nationkey, 'prod' AS org, unnest(['onsite', 'onsite', '']) AS target, unnest(['10minutely', 'daily', 'weekly']) AS period,
    unnest([n_regionkey, 31, 4]) AS amount, unnest([600000, 86400000, 604800000]) AS period_ms,
    coalesce(nullif(unnest([n_regionkey * 600000::BIGINT, 31 * 86400000::BIGINT, 4 * 604800000::BIGINT]), 0), -1) AS window_ms FROM nation)"""
)
def plan_rows(spark, sf_dir):
    """One plan map per nation, exploded to its entries."""
    def periods(*pairs):
        return F.create_map(*[part for name, amount in pairs for part in (F.lit(name), amount)])

    region = F.col("n_regionkey")
    plan = F.create_map(
        F.lit("prod"),
        F.create_map(F.lit("onsite"), periods(("10minutely", region), ("daily", F.lit(31))), F.lit(""), periods(("weekly", F.lit(4)))),
    )
    rows = policy.explode_plan(table(spark, sf_dir, "nation").select("n_nationkey", plan.alias("plan")))
    return rows.select(
        "n_nationkey", "org", "target", "period", "amount", "period_ms",
        F.coalesce("window_ms", F.lit(-1).cast("bigint")).alias("window_ms"),
    )
