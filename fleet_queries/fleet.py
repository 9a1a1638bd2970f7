"""Refresh state, policies over many hosts, job and trial summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, NOW, events, query, table
from snapcat.operators import state as refresh
from snapcat.operators import summary
from snapcat.plans import policy

# live change time per dataset: its newest row; state remembers an older newest row for some
STATE_SQL = CATALOG_SQL + """
, live AS (SELECT rel_dataset AS dataset, max(creation) AS changed FROM ev GROUP BY rel_dataset
), old AS (
  SELECT 'site' AS namespace, rel_dataset AS dataset, 'dataset' AS family, '' AS label_key, max(creation) AS created, max(creation) AS changed
  FROM ev WHERE k >= 15 GROUP BY rel_dataset
  UNION ALL
  SELECT 'site', rel_dataset, 'label', event_type, coalesce(max(creation) FILTER (WHERE k >= 5), 0), any_value(changed)
  FROM ev JOIN live ON live.dataset = rel_dataset WHERE event_type IN ('click', 'view') GROUP BY rel_dataset, event_type
  UNION ALL
  SELECT 'site', rel_dataset, 'monitor', event_type, max(creation), max(creation) FROM ev WHERE event_type = 'error' GROUP BY rel_dataset, event_type
)"""


def live_and_state(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("dataset", F.col("rel_dataset"))
    live = ev.groupBy("dataset").agg(F.max("creation").alias("changed"))

    def rows(df, family, label):
        return df.select(
            F.lit("site").alias("namespace"), "dataset", F.lit(family).alias("family"), label.alias("label_key"),
            "created", "changed",
        )

    seen = ev.filter("k >= 15").groupBy("dataset").agg(F.max("creation").alias("created")).withColumn("changed", F.col("created"))
    labels = (
        ev.filter(F.col("event_type").isin("click", "view")).groupBy("dataset", "event_type")
        .agg(F.coalesce(F.max(F.when(F.col("k") >= 5, F.col("creation"))), F.lit(0).cast("bigint")).alias("created"))
        .join(live, "dataset")
    )
    checks = (
        ev.filter(F.col("event_type") == "error").groupBy("dataset", "event_type").agg(F.max("creation").alias("created"))
        .withColumn("changed", F.col("created"))
    )
    old = rows(seen, "dataset", F.lit("")).unionByName(rows(labels, "label", F.col("event_type"))).unionByName(
        rows(checks, "monitor", F.col("event_type"))
    )
    return live, old


def stored_live_and_state(spark, sf_dir):
    """The same as tables of equal buckets, as a run finds the state that the one before it left."""
    live, old = live_and_state(spark, sf_dir)
    return refresh.store_buckets(live, "live"), refresh.store_buckets(old, "state")


HITS_SQL = STATE_SQL + f"""
, fresh AS (SELECT live.* FROM live JOIN old USING (dataset, changed) WHERE family = 'dataset' AND changed <> 0 AND changed < {NOW} - 1.1
), hits AS (
  SELECT dataset, label_key, created FROM old JOIN fresh USING (dataset, changed)
  WHERE family = 'label' AND created <> 0 AND created <= changed
), complete AS (SELECT dataset FROM hits GROUP BY dataset HAVING count(*) = 2)"""


@query(HITS_SQL + "SELECT dataset, label_key, created FROM hits WHERE dataset IN (SELECT dataset FROM complete)")
def state_schedule_hits(spark, sf_dir):
    return refresh.schedule_hits(*stored_live_and_state(spark, sf_dir), ["click", "view"], NOW)


@query(HITS_SQL + "SELECT dataset, changed FROM live WHERE dataset NOT IN (SELECT dataset FROM complete)")
def state_stale(spark, sf_dir):
    live, old = stored_live_and_state(spark, sf_dir)
    return refresh.stale_datasets(live, refresh.schedule_hits(live, old, ["click", "view"], NOW))


@query(
    HITS_SQL + """
SELECT (SELECT count(*) FROM complete) AS hits, (SELECT count(*) FROM live) - (SELECT count(*) FROM complete) AS misses"""
)
def state_hit_ratio(spark, sf_dir):
    live, old = stored_live_and_state(spark, sf_dir)
    stale = refresh.stale_datasets(live, refresh.schedule_hits(live, old, ["click", "view"], NOW))
    return refresh.hit_ratio(live, stale).select("hits", "misses")


@query(
    STATE_SQL + f"""
SELECT dataset, label_key, created FROM old JOIN live USING (dataset, changed)
WHERE family = 'monitor' AND changed <> 0 AND changed < {NOW} - 1.1 AND changed >= created"""
)
def state_monitor_hits(spark, sf_dir):
    return refresh.monitor_hits(*stored_live_and_state(spark, sf_dir), NOW)


@query(
    CATALOG_SQL + f"""
, live AS (SELECT rel_dataset, max(creation) AS changed FROM ev GROUP BY rel_dataset
), seen AS (SELECT rel_dataset, max(creation) AS changed FROM ev WHERE k >= 10 GROUP BY rel_dataset
), dst_seen AS (SELECT rel_dataset, max(creation) AS changed FROM ev WHERE k < 90 GROUP BY rel_dataset
)
SELECT 'tank1/src' || rel_dataset AS dataset FROM live JOIN seen USING (rel_dataset, changed) JOIN dst_seen USING (rel_dataset, changed)
WHERE changed < {NOW} - 1.1"""
)
def state_replicate_hits(spark, sf_dir):
    """Unchanged on both sides since the last run."""
    ev = events(spark, sf_dir)

    def newest(df, root):
        return df.groupBy("rel_dataset").agg(F.max("creation").alias("changed")).select(
            F.concat(F.lit(root), "rel_dataset").alias("dataset"), F.concat(F.lit("tank2/dst"), "rel_dataset").alias("dst_dataset"), "changed"
        )

    def family(df, name):
        return df.select(F.lit("site").alias("namespace"), "dataset", F.lit(name).alias("family"), F.lit("").alias("label_key"),
                         F.col("changed").alias("created"), "changed")

    known = family(newest(ev.filter("k >= 10"), "tank1/src"), "replicate").unionByName(
        family(newest(ev.filter("k < 90"), "tank2/dst"), "dataset")
    )
    return refresh.replicate_hits(newest(ev, "tank1/src"), newest(ev, "tank2/dst"), known, NOW)


def new_state(spark, sf_dir):
    """An update: newest rows of the small k, and datasets whose change time got lost."""
    ev = events(spark, sf_dir).withColumn("dataset", F.col("rel_dataset"))
    newer = ev.filter("k < 60").groupBy("dataset").agg(F.max("creation").alias("changed"), F.min("creation").alias("created"))
    lost = ev.filter("k = 7").select("dataset", F.lit(0).cast("bigint").alias("changed"), F.lit(0).cast("bigint").alias("created")).distinct()
    kept = newer.join(lost.select("dataset"), "dataset", "left_anti")
    rows = kept.select("dataset", "created", "changed").unionByName(lost.select("dataset", "created", "changed"))
    return rows.select(F.lit("site").alias("namespace"), "dataset", F.lit("dataset").alias("family"), F.lit("").alias("label_key"), "created", "changed")


@query(
    STATE_SQL + """
, lost AS (SELECT DISTINCT rel_dataset AS dataset FROM ev WHERE k = 7
), new AS (
  SELECT rel_dataset AS dataset, min(creation) AS created, max(creation) AS changed FROM ev WHERE k < 60
  AND rel_dataset NOT IN (SELECT dataset FROM lost) GROUP BY rel_dataset
), joined AS (
  SELECT coalesce(o.dataset, n.dataset) AS dataset, coalesce(o.family, 'dataset') AS family, coalesce(o.label_key, '') AS label_key,
    o.created AS oc, o.changed AS og, n.created AS nc, n.changed AS ng
  FROM old o FULL OUTER JOIN new n ON o.dataset = n.dataset AND o.family = 'dataset'
)
SELECT 'site' AS namespace, dataset, family, label_key,
  CASE WHEN family = 'dataset' AND dataset IN (SELECT dataset FROM lost) THEN 0 WHEN og IS NULL OR ng >= og THEN nc ELSE oc END AS created,
  CASE WHEN family = 'dataset' AND dataset IN (SELECT dataset FROM lost) THEN 0 WHEN og IS NULL OR ng >= og THEN ng ELSE og END AS changed
FROM joined"""
)
def state_merge(spark, sf_dir):
    old = refresh.store_buckets(live_and_state(spark, sf_dir)[1], "state")
    return refresh.merge_state(old, refresh.store_buckets(new_state(spark, sf_dir), "reports"))


@query(
    STATE_SQL + """
, wrong AS (
  SELECT DISTINCT live.dataset AS wrong FROM live JOIN old ON old.dataset = live.dataset
  WHERE family = 'dataset' AND old.changed <> 0 AND old.changed <> live.changed
), marked AS (
  SELECT old.*, wrong IS NOT NULL AND family IN ('dataset', 'label') AS reset FROM old LEFT JOIN wrong ON wrong = dataset
)
SELECT namespace, dataset, family, label_key, CASE WHEN reset THEN 0 ELSE created END AS created,
  CASE WHEN reset THEN 0 ELSE changed END AS changed FROM marked"""
)
def state_invalidate(spark, sf_dir):
    live, old = stored_live_and_state(spark, sf_dir)
    return refresh.invalidate(old, refresh.mismatched(live, old))


@query(
    """
WITH bad AS (SELECT user_id, min(event_id) AS first_bad FROM events WHERE value < 1 GROUP BY user_id)
SELECT user_id, event_id FROM events LEFT JOIN bad USING (user_id) WHERE first_bad IS NULL OR event_id < first_bad"""
)
def trusted_rows(spark, sf_dir):
    """Rows of each user's listing before the first malformed one."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return refresh.trusted_prefix(ev, "user_id", "event_id", F.col("value") < 1).select("user_id", "event_id")


# one job per region; nations are root pairs, suppliers destination hosts, market segments targets
POLICY_SQL = """
WITH pairs AS (SELECT DISTINCT n_regionkey AS job, 'tank1/' || n_name AS src_root, 'tank2/' || n_name AS dst_root FROM nation
), hosts AS (
  SELECT DISTINCT n_regionkey AS job, s_name AS dst_host, CASE WHEN s_acctbal < 5000 THEN 'onsite' ELSE 'offsite' END AS target
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 9000
), retain AS (
  SELECT DISTINCT n_regionkey AS job, s_name AS dst_host, CASE WHEN s_acctbal < 5000 THEN 'onsite' ELSE 'offsite' END AS target
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000
), plan AS (
  SELECT r_regionkey AS job, 'prod' AS org, unnest(['onsite', 'onsite', 'offsite']) AS target, unnest(['hourly', 'daily', 'daily']) AS period,
    unnest([36, r_regionkey, 31]) AS amount FROM region
), ds AS (
  SELECT 'tank1/' || n_name AS src_root, 'tank1/' || n_name || '/' || c_mktsegment AS dataset FROM customer
  JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL
), hp AS (
  SELECT job, dst_host, target, org, period, amount, h.dst_host IS NOT NULL AS replicate, r.dst_host IS NOT NULL AS retain
  FROM hosts h FULL OUTER JOIN retain r USING (job, dst_host, target) JOIN plan USING (job, target) WHERE amount > 0
)"""


def policy_tables(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    region, customer = table(spark, sf_dir, "region"), table(spark, sf_dir, "customer")
    name = F.col("n_name")
    pairs = nation.select(F.col("n_regionkey").alias("job"), F.concat(F.lit("tank1/"), name).alias("src_root"),
                          F.concat(F.lit("tank2/"), name).alias("dst_root"))
    target = F.when(F.col("s_acctbal") < 5000, "onsite").otherwise("offsite")
    hosts = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("n_regionkey").alias("job"), F.col("s_name").alias("dst_host"), target.alias("target"), "s_acctbal"
    )
    entries = F.array(*[
        F.struct(F.lit("prod").alias("org"), F.lit(t).alias("target"), F.lit(p).alias("period"), n.alias("amount"))
        for t, p, n in (("onsite", "hourly", F.lit(36)), ("onsite", "daily", F.col("r_regionkey")), ("offsite", "daily", F.lit(31)))
    ])
    plan = region.select(F.col("r_regionkey").alias("job"), F.inline(entries))
    datasets = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.concat(F.lit("tank1/"), name).alias("root"),
        F.concat(F.lit("tank1/"), name, F.lit("/"), "c_mktsegment").alias("dataset"),
    ).distinct()
    return datasets, hosts.filter("s_acctbal < 9000"), hosts.filter("s_acctbal > 1000"), pairs, plan


@query(
    POLICY_SQL + """
SELECT job, dataset, dst_host, 'tank2' || substr(dataset, 6) AS dst_dataset, org, target, period, amount, replicate, retain
FROM ds JOIN pairs USING (src_root) JOIN hp USING (job)"""
)
def policy_expand(spark, sf_dir):
    datasets, hosts, retain, pairs, plan = policy_tables(spark, sf_dir)
    return policy.expand_policy(datasets, hosts, retain, pairs, plan)


@query(
    POLICY_SQL + """
SELECT job, org, target, period, amount FROM plan WHERE amount > 0 AND (job, target) IN (SELECT job, target FROM hosts)"""
)
def policy_of_hosts(spark, sf_dir):
    _, hosts, _, _, plan = policy_tables(spark, sf_dir)
    return policy.plan_for_host(plan, hosts, ["job", "target"])


@query(
    """
WITH pairs AS (SELECT 'tank1/' || n_name AS src_root,
  CASE WHEN n_regionkey < 3 THEN '-:' ELSE 'host:' END || n_name || '/dst' AS dst_root FROM nation)
SELECT src_root, dst_root FROM pairs WHERE NOT starts_with(dst_root, '-:')
  OR substr(split_part(dst_root, '/', 1), 3) IN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 7000)"""
)
def existing_targets(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    place = F.when(F.col("n_regionkey") < 3, "-:").otherwise("host:")
    pairs = nation.select(F.concat(F.lit("tank1/"), "n_name").alias("src_root"), F.concat(place, "n_name", F.lit("/dst")).alias("dst_root"))
    pools = nation.join(supplier.filter("s_acctbal > 7000"), nation.n_nationkey == supplier.s_nationkey).select(F.col("n_name").alias("pool"))
    return policy.filter_existing_targets(pairs, pools)


# orders as jobs: status F done, P running, O not started; the priority stands for the exit code
CODES_SQL = """
WITH jobs AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 4 WHEN '4-NOT SPECIFIED' THEN 0
  ELSE CASE WHEN o_totalprice > 480000 THEN 5 ELSE 0 END END AS code FROM orders)"""


def jobs(spark, sf_dir):
    priority = F.col("o_orderpriority")
    code = (
        F.when(priority == "1-URGENT", 2).when(priority == "2-HIGH", 1).when(priority == "3-MEDIUM", 4)
        .when(priority == "4-NOT SPECIFIED", 0).otherwise(F.when(F.col("o_totalprice") > 480000, 5).otherwise(0))
    )
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_custkey", status.alias("status"), F.year("o_orderdate").alias("year"), code.alias("code"),
        (status != "O").alias("started"), (status == "F").alias("completed"), (code != 0).alias("failed"),
        (F.floor(F.col("o_totalprice")).cast("bigint") * 1000).alias("elapsed_nanos"),
    )


@query(
    CODES_SQL + """
, ranked AS (SELECT o_custkey, code, CASE code WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS r FROM jobs)
SELECT o_custkey, arg_max(code, r * 10 + code) AS code FROM ranked GROUP BY o_custkey"""
)
def job_status(spark, sf_dir):
    return summary.worst_status(jobs(spark, sf_dir), by=["o_custkey"])


@query(
    CODES_SQL + """
SELECT year(o_orderdate) AS year, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus <> 'O') AS started,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'F' AND code <> 0) AS failed,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS running,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) * 1000 ELSE 0 END) AS BIGINT) AS elapsed_nanos
FROM jobs GROUP BY 1"""
)
def job_summary(spark, sf_dir):
    rows = summary.job_summary(jobs(spark, sf_dir), by=["year"])
    return rows.select("year", "jobs", "started", "completed", "failed", "running", "elapsed_nanos")


@query(
    """
WITH t AS (SELECT l_returnflag, l_linestatus, l_extendedprice / l_quantity AS rate, l_quantity AS s FROM lineitem)
SELECT l_returnflag AS mode, l_linestatus AS procs, count(*) AS measurements, round(min(rate), 2) AS min_rate, round(max(rate), 2) AS max_rate,
  round(median(rate), 2) AS median_rate, round(avg(rate), 2) AS avg_rate, round(stddev_samp(rate), 2) AS stddev_rate,
  min(s) AS min_seconds, max(s) AS max_seconds, median(s) AS median_seconds, round(avg(s), 4) AS avg_seconds, round(stddev_samp(s), 4) AS stddev_seconds
FROM t GROUP BY 1, 2"""
)
def trial_summary(spark, sf_dir):
    trials = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("procs"),
        F.col("l_extendedprice").alias("objects"), F.col("l_quantity").alias("seconds"),
    )
    stats = summary.trial_summary(trials, ["mode", "procs"])
    rates = [c for c in stats.columns if c.endswith("_rate")]
    return stats.withColumns(
        {c: F.round(c, 2) for c in rates} | {c: F.round(c, 4) for c in ("avg_seconds", "stddev_seconds")}
    )
