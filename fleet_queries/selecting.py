"""Filters, policies and deletion plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, NOW, catalog, query, table
from snapcat.operators import filters
from snapcat.operators.filters import Rank, RegexFilter, TimeOrRankFilter, times_and_ranks
from snapcat.operators.labels import match_labels
from snapcat.operators.ordered import difference, duplicates, intersection, latest_k, oldest_k, semi
from snapcat.plans import policy, retention

ROW = ["dataset", "kind", "name", "creation", "createtxg"]
PLAN = {"prod": {"onsite": {"minutely": 2, "hourly": 200, "daily": 5, "weekly": 0}, "": {"weekly": 1, "monthly": 3, "adhoc": 2}}}
BOOKMARK_PLAN = {"prod": {"onsite": {"daily": 1, "hourly": 2}, "": {"monthly": 1}}}

# the plan as rows, with the regex head, suffix, amount and window in seconds (null: no time part)
PLAN_SQL = """
, plan(pat, amount, win) AS (VALUES
  ('prod_onsite_.*_minutely', 2, 120), ('prod_onsite_.*_hourly', 200, 720000), ('prod_onsite_.*_daily', 5, 432000),
  ('prod_[1-9][0-9]{3}.*_weekly', 1, 604800), ('prod_[1-9][0-9]{3}.*_monthly', 3, 7905600),
  ('prod_[1-9][0-9]{3}.*_adhoc', 2, NULL)
)"""


def kept_sql(source: str, now: int = NOW) -> str:
    return f"""
, matched AS (
  SELECT s.*, p.amount, p.win, row_number() OVER (PARTITION BY s.dataset, p.pat
    ORDER BY createtxg DESC, creation DESC, tag DESC) AS rk
  FROM {source} s JOIN plan p ON regexp_full_match(s.tag, p.pat)
), kept AS (
  SELECT DISTINCT dataset, rel_dataset, guid, kind, name, creation, createtxg FROM matched
  WHERE rk <= amount OR creation >= {now} - win
)"""


@query(
    CATALOG_SQL
    + """
SELECT dataset, kind, name, creation, createtxg FROM src WHERE kind = 'snapshot'
  AND regexp_full_match(tag, '.*_(?:hourly|daily)') AND NOT regexp_full_match(tag, 'prod_onsite_.*')"""
)
def filter_regex(spark, sf_dir):
    rows = filters.filter_tags(catalog(spark, sf_dir, "src"), [".*_hourly", ".*_daily"], ["prod_onsite_.*"])
    return rows.select(*ROW)


@query(
    CATALOG_SQL
    + f"""
SELECT dataset, kind, name, creation, createtxg FROM src
WHERE creation >= {NOW - 14 * 86400} AND creation < {NOW - 2 * 86400}"""
)
def filter_times(spark, sf_dir):
    spec = times_and_ranks("14 days ago..2days ago")
    return filters.filter_time(catalog(spark, sf_dir, "src"), spec.lo, spec.hi, bookmarks=True, now=NOW).select(*ROW)


@query(
    CATALOG_SQL
    + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) - 1 AS rk,
    count(*) OVER (PARTITION BY dataset) AS n FROM src WHERE kind = 'snapshot'
)
SELECT dataset, kind, name, creation, createtxg FROM ranked
WHERE rk >= n - round_even(n * 51 / 100.0, 0)
UNION ALL SELECT dataset, kind, name, creation, createtxg FROM src WHERE kind <> 'snapshot'"""
)
def filter_ranks(spark, sf_dir):
    group = [times_and_ranks("notime", "latest 51%")]
    return filters.select_snapshots(catalog(spark, sf_dir, "src"), [group], now=NOW).select(*ROW)


@query(
    CATALOG_SQL
    + """
, s1 AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) - 1 AS rk,
    count(*) OVER (PARTITION BY dataset) AS n FROM src WHERE kind = 'snapshot'
), k1 AS (
  SELECT * EXCLUDE (rk, n) FROM s1 WHERE (rk < n - 1) OR (creation >= 1705000000 AND creation < 1705500000)
), s2 AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) - 1 AS rk,
    count(*) OVER (PARTITION BY dataset) AS n FROM k1
), k2 AS (
  SELECT * EXCLUDE (rk, n) FROM s2 WHERE (rk >= least(2, n) AND rk < round_even(n * 70 / 100.0, 0))
    OR (creation >= 1705000000 AND creation < 1705500000)
), s3 AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) - 1 AS rk,
    count(*) OVER (PARTITION BY dataset) AS n FROM k2
)
SELECT dataset, kind, name, creation, createtxg FROM s3
WHERE rk >= n - least(20, n) OR (creation >= 1705000000 AND creation < 1705500000)
UNION ALL SELECT dataset, kind, name, creation, createtxg FROM src
WHERE kind <> 'snapshot' AND creation >= 1705000000 AND creation < 1705500000"""
)
def filter_rank_chain(spark, sf_dir):
    """Three rank ranges in sequence, each ranking what the one before left; bookmarks by time only."""
    ranks = ((Rank("latest", 1), Rank("latest", 100, True)), (Rank("oldest", 2), Rank("oldest", 70, True)),
             (Rank("latest", 0), Rank("latest", 20)))
    group = [TimeOrRankFilter(1705000000, 1705500000, ranks)]
    return filters.select_snapshots(catalog(spark, sf_dir, "src"), [group], bookmarks=True, now=NOW).select(*ROW)


@query(
    CATALOG_SQL
    + f"""
, daily AS (SELECT * FROM src WHERE kind = 'snapshot' AND regexp_full_match(tag, '.*_daily')
), daily_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) - 1 AS rk,
    count(*) OVER (PARTITION BY dataset) AS n FROM daily
), chosen AS (
  SELECT name FROM daily_ranked WHERE rk >= n - least(3, n)
  UNION SELECT name FROM src WHERE kind = 'snapshot' AND creation >= {NOW - 20 * 86400}
    AND NOT regexp_full_match(tag, '.*onsite.*')
)
SELECT dataset, kind, name, creation, createtxg FROM src WHERE kind <> 'snapshot' OR name NOT IN (SELECT name FROM chosen)"""
)
def filter_groups(spark, sf_dir):
    """Two groups, inverted: everything but the newest dailies and the recent offsite rows."""
    groups = [
        [RegexFilter((".*_daily",)), times_and_ranks("notime", "latest 3")],
        [RegexFilter((), (".*onsite.*",)), times_and_ranks("20 days ago..*")],
    ]
    rows = filters.select_snapshots(catalog(spark, sf_dir, "src"), groups, all_except=True, now=NOW)
    return rows.select(*ROW)


@query(
    CATALOG_SQL
    + """
, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg DESC, creation DESC, tag DESC) AS hi,
    row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) AS lo FROM src WHERE kind = 'snapshot')
SELECT 'latest' AS which, dataset, name FROM r WHERE hi <= 3 UNION ALL SELECT 'oldest', dataset, name FROM r WHERE lo <= 2"""
)
def top_rows(spark, sf_dir):
    snaps = catalog(spark, sf_dir, "src").filter(F.col("kind") == "snapshot").select("dataset", "name", "createtxg", "creation", "tag")
    parts = [("latest", latest_k(snaps, 3)), ("oldest", oldest_k(snaps, 2))]
    frames = [part.select(F.lit(which).alias("which"), "dataset", "name") for which, part in parts]
    return frames[0].unionByName(frames[1])


@query(
    CATALOG_SQL + PLAN_SQL + """
SELECT s.dataset, s.name, p.pat AS series FROM src s JOIN plan p ON regexp_full_match(s.tag, p.pat) WHERE kind = 'snapshot'"""
)
def label_matches(spark, sf_dir):
    """Every snapshot with the plan series its tag belongs to."""
    rows = catalog(spark, sf_dir, "src").filter(F.col("kind") == "snapshot")
    series = F.concat("prefix", F.when(F.col("infix") == "", "[1-9][0-9]{3}").otherwise(F.col("infix")), F.lit(".*"), "suffix")
    entries = policy.plan_frame(rows, PLAN).filter(F.col("amount") > 0).select("prefix", "infix", "suffix")
    return match_labels(rows, entries).select("dataset", "name", series.alias("series"))


@query(
    CATALOG_SQL + PLAN_SQL + kept_sql("(SELECT * FROM src WHERE kind = 'snapshot')")
    + "SELECT dataset, kind, name, creation, createtxg FROM kept"
)
def plan_select(spark, sf_dir):
    return policy.select_by_plan(catalog(spark, sf_dir, "src"), PLAN, NOW).select(*ROW)


DELETE_SQL = """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) - 1 AS rk,
    count(*) OVER (PARTITION BY dataset) AS n FROM dst WHERE kind = 'snapshot' AND NOT regexp_full_match(tag, '.*_weekly')
), doomed AS (
  SELECT * FROM ranked r WHERE rk < round_even(n * 80 / 100.0, 0)
    AND NOT EXISTS (SELECT 1 FROM src s WHERE s.rel_dataset = r.rel_dataset AND s.guid = r.guid) AND NOT held
)"""


def delete_plan_rows(spark, sf_dir):
    group = [RegexFilter((), (".*_weekly",)), times_and_ranks("notime", "oldest 80%")]
    return retention.plan_deletes(catalog(spark, sf_dir, "dst"), catalog(spark, sf_dir, "src"), [group], now=NOW)


@query(CATALOG_SQL + DELETE_SQL + "SELECT dataset, kind, name, creation, createtxg FROM doomed")
def delete_plan(spark, sf_dir):
    return delete_plan_rows(spark, sf_dir).select(*ROW)


@query(
    CATALOG_SQL + DELETE_SQL.replace("s.guid = r.guid", "s.guid = r.guid AND s.kind = 'snapshot'")
    + "SELECT dataset, kind, name, creation, createtxg FROM doomed"
)
def delete_plan_no_crosscheck(spark, sf_dir):
    """Only source snapshots protect a row, not bookmarks."""
    group = [RegexFilter((), (".*_weekly",)), times_and_ranks("notime", "oldest 80%")]
    src, dst = catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst")
    return retention.plan_deletes(dst, src, [group], crosscheck=False, now=NOW).select(*ROW)


@query(
    CATALOG_SQL + DELETE_SQL + """
SELECT dataset, count(*) AS found, coalesce(max(deleted), 0) AS deleted FROM dst
LEFT JOIN (SELECT dataset, count(*) AS deleted FROM doomed GROUP BY dataset) USING (dataset)
WHERE kind = 'snapshot' GROUP BY dataset"""
)
def delete_counts(spark, sf_dir):
    basis = catalog(spark, sf_dir, "dst").filter(F.col("kind") == "snapshot")
    return retention.delete_summary(basis, delete_plan_rows(spark, sf_dir))


@query(
    CATALOG_SQL + PLAN_SQL + kept_sql("(SELECT * FROM dst WHERE kind = 'snapshot')") + """
SELECT dataset, kind, name, creation, createtxg FROM dst d WHERE kind = 'snapshot' AND NOT held
  AND NOT EXISTS (SELECT 1 FROM kept k JOIN src s USING (rel_dataset, guid) WHERE k.rel_dataset = d.rel_dataset AND k.guid = d.guid)"""
)
def delete_except(spark, sf_dir):
    """Everything goes but what the plan keeps and the source still has."""
    src, dst = catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst")
    return retention.plan_deletes_except(dst, src, PLAN, NOW).select(*ROW)


@query(
    CATALOG_SQL + """
, plan(pat, amount, win) AS (VALUES ('prod_onsite_.*_daily', 1, 86400), ('prod_onsite_.*_hourly', 2, 7200),
  ('prod_[1-9][0-9]{3}.*_monthly', 1, 2635200))""" + kept_sql("(SELECT * FROM dst WHERE kind = 'bookmark')") + """
SELECT dataset, kind, name, creation, createtxg FROM dst d WHERE kind = 'bookmark' AND name NOT IN (SELECT name FROM kept)"""
)
def bookmark_prune_except(spark, sf_dir):
    """Bookmarks outside their plan, without a source."""
    rows = retention.plan_deletes_except(catalog(spark, sf_dir, "dst"), None, BOOKMARK_PLAN, NOW, kind="bookmark")
    return rows.select(*ROW)


@query(
    CATALOG_SQL + """
, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY createtxg, creation, tag) - 1 AS rk,
    count(*) OVER (PARTITION BY dataset) AS n FROM dst WHERE kind = 'bookmark'
)
SELECT dataset, kind, name, creation, createtxg FROM ranked r WHERE rk < n - least(4, n)
  AND NOT EXISTS (SELECT 1 FROM src s WHERE s.rel_dataset = r.rel_dataset AND s.guid = r.guid)"""
)
def bookmark_prune(spark, sf_dir):
    """All but the newest 4 bookmarks whose guid the source no longer has."""
    group = [times_and_ranks("notime", "all except latest 4")]
    src, dst = catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst")
    return retention.plan_deletes(dst, src, [group], kind="bookmark", now=NOW).select(*ROW)


@query(
    CATALOG_SQL + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY creation, name) AS rk,
  count(*) OVER (PARTITION BY dataset) AS n FROM src WHERE kind = 'bookmark')
SELECT dataset, kind, name, creation, createtxg FROM r WHERE creation <= {NOW - 9 * 86400} AND rk <= n - 3"""
)
def age_prune(spark, sf_dir):
    rows = catalog(spark, sf_dir, "src").filter(F.col("kind") == "bookmark")
    return retention.prune_by_age(rows, days=9, keep=3, now=NOW).select(*ROW)


@query(
    CATALOG_SQL + """
SELECT 'common' AS part, rel_dataset, guid FROM (SELECT rel_dataset, guid FROM dst INTERSECT SELECT rel_dataset, guid FROM src)
UNION ALL SELECT 'gone', rel_dataset, guid FROM (SELECT rel_dataset, guid FROM dst EXCEPT SELECT rel_dataset, guid FROM src)"""
)
def guid_sets(spark, sf_dir):
    """Intersection and difference of the guids of both sides."""
    src, dst, key = catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst"), ["rel_dataset", "guid"]
    common = intersection(dst, src, key).select(F.lit("common").alias("part"), *key)
    return common.unionByName(difference(dst, src, key).select(F.lit("gone").alias("part"), *key))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def keep_by_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    keys = lines.select(F.col("l_orderkey").alias("o_orderkey"))
    return semi(table(spark, sf_dir, "orders"), keys, "o_orderkey").select("o_orderkey", "o_custkey")
