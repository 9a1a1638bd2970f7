"""Replication plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, NOW, catalog, query, table
from snapcat.operators.filters import RegexFilter, flag_snapshots, times_and_ranks
from snapcat.plans import bookmarks, properties, replication
from snapcat.plans.properties import PropertyGroup

GROUP = [RegexFilter((), (".*_minutely",))]

BASE_SQL = CATALOG_SQL + """
, listed AS (
  SELECT *, kind = 'snapshot' AND NOT regexp_full_match(tag, '.*_minutely') AS included,
    row_number() OVER (PARTITION BY rel_dataset ORDER BY createtxg, kind = 'snapshot', creation, tag) AS pos FROM src
), base AS (
  SELECT rel_dataset, max(pos) AS base_pos FROM listed l
  WHERE EXISTS (SELECT 1 FROM dst d WHERE d.kind = 'snapshot' AND d.rel_dataset = l.rel_dataset AND d.guid = l.guid)
  GROUP BY rel_dataset
), early AS (
  SELECT rel_dataset, min(pos) AS base_pos FROM listed WHERE included AND creation < 1705300000 GROUP BY rel_dataset
)"""

# gaps and islands over the rows from the base on; {base} names the table with the base of each dataset
STEPS_SQL = BASE_SQL + """
, cands AS (
  SELECT l.*, pos = base_pos AS is_base, row_number() OVER (PARTITION BY rel_dataset ORDER BY pos) AS rn
  FROM listed l JOIN {base} USING (rel_dataset) WHERE pos = base_pos OR (pos > base_pos AND kind = 'snapshot')
), flagged AS (
  SELECT *, included AND NOT (is_base AND kind <> 'snapshot') AS in_run,
    last_value(CASE WHEN included OR is_base THEN name END IGNORE NULLS) OVER (PARTITION BY rel_dataset ORDER BY rn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS from_name FROM cands
), islands AS (
  SELECT *, coalesce(lag(in_run) OVER w, false) AS joined,
    sum(CASE WHEN in_run THEN 0 ELSE 1 END) OVER w AS run
  FROM flagged WINDOW w AS (PARTITION BY rel_dataset ORDER BY rn)
), steps AS (
  SELECT rel_dataset, run, joined, arg_min(from_name, rn) AS from_name, arg_max(name, rn) AS to_name, count(*) AS snapshots,
    CAST(sum(coalesce(written, 0)) AS BIGINT) AS written, max(createtxg) AS to_createtxg
  FROM islands WHERE included AND NOT is_base GROUP BY rel_dataset, run, joined
)"""


def candidates(spark, sf_dir):
    """Source rows flagged by the policy, from the latest common row on."""
    src = flag_snapshots(catalog(spark, sf_dir, "src"), [GROUP], now=NOW, output="included")
    return replication.candidates_since(src, replication.latest_common(src, catalog(spark, sf_dir, "dst")))


def early_candidates(spark, sf_dir):
    """The same from an older base: the first included row before a moment, as after a first full copy."""
    src = flag_snapshots(catalog(spark, sf_dir, "src"), [GROUP], now=NOW, output="included")
    first = src.filter(F.col("included") & (F.col("kind") == "snapshot") & (F.col("creation") < 1705300000))
    position = F.struct(replication._position().alias("position"), "guid", "name", "kind")
    base = first.groupBy("rel_dataset").agg(F.min(position).alias("b")).select(
        "rel_dataset", F.col("b.position").alias("base_position"), F.col("b.guid").alias("base_guid"),
        F.col("b.name").alias("base_name"), F.col("b.kind").alias("base_kind"),
    )
    return replication.candidates_since(src, base)


@query(
    BASE_SQL + """
SELECT rel_dataset, name AS base_name, guid AS base_guid, kind AS base_kind FROM listed JOIN base USING (rel_dataset)
WHERE pos = base_pos"""
)
def latest_common(spark, sf_dir):
    common = replication.latest_common(catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst"))
    return common.select("rel_dataset", "base_name", "base_guid", "base_kind")


@query(
    BASE_SQL + """
SELECT rel_dataset, arg_min(name, pos) AS first_name, arg_max(name, pos) AS last_name FROM listed WHERE kind = 'snapshot'
GROUP BY rel_dataset"""
)
def first_last(spark, sf_dir):
    return replication.first_last(catalog(spark, sf_dir, "src")).select("rel_dataset", "first_name", "last_name")


ACTION_SQL = BASE_SQL.replace("NOT regexp_full_match(tag, '.*_minutely')", "regexp_full_match(tag, '.*_monthly') AND creation >= 1706400000") + """
, chosen AS (
  SELECT rel_dataset, count(*) FILTER (WHERE included) AS selected, count(*) FILTER (WHERE kind <> 'snapshot') AS bookmarks,
    arg_max(name, pos) FILTER (WHERE included) AS latest, arg_min(name, pos) FILTER (WHERE included) AS oldest
  FROM listed GROUP BY rel_dataset
), target AS (
  SELECT rel_dataset, arg_max(guid, createtxg) AS newest_guid, arg_max(name, createtxg) AS newest_name FROM dst
  WHERE kind = 'snapshot' GROUP BY rel_dataset
), common AS (
  SELECT rel_dataset, l.name AS base_name, l.guid AS base_guid, d.name AS common_on_dst
  FROM listed l JOIN base b USING (rel_dataset) JOIN dst d USING (rel_dataset, guid) WHERE pos = base_pos AND d.kind = 'snapshot'
)
SELECT rel_dataset, CASE
    WHEN selected + CASE WHEN newest_guid IS NULL THEN 0 ELSE bookmarks END = 0 THEN 'skip'
    WHEN selected = 0 THEN 'up-to-date'
    WHEN base_guid <> newest_guid AND NOT {force} THEN 'conflict'
    WHEN base_guid IS NOT NULL AND latest = base_name THEN 'up-to-date'
    WHEN base_guid IS NOT NULL THEN 'incremental'
    WHEN newest_guid IS NOT NULL AND NOT {force} THEN 'conflict' ELSE 'full' END AS action,
  selected, coalesce(oldest, '-') AS oldest_selected, coalesce(latest, '-') AS latest_selected,
  coalesce(base_name, '-') AS base_name, coalesce(CASE WHEN base_guid <> newest_guid THEN common_on_dst END, '-') AS rollback_to,
  coalesce(newest_name, '-') AS latest_dst
FROM chosen LEFT JOIN target USING (rel_dataset) LEFT JOIN common USING (rel_dataset)"""


def actions(spark, sf_dir, force):
    group = [RegexFilter((".*_monthly",)), times_and_ranks("1706400000..*")]
    plan = replication.replication_action(
        catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst"), [group], force=force, now=NOW
    )
    return plan.drop("base_guid").fillna("-")


@query(ACTION_SQL.replace("{force}", "false"))
def replication_actions(spark, sf_dir):
    return actions(spark, sf_dir, force=False)


@query(ACTION_SQL.replace("{force}", "true"))
def replication_actions_forced(spark, sf_dir):
    return actions(spark, sf_dir, force=True)


STEP_COLUMNS = "rel_dataset, CASE WHEN snapshots > 1 THEN '-I' ELSE '-i' END AS flag, from_name, to_name, snapshots, written, to_createtxg"


@query(STEPS_SQL.replace("{base}", "base") + f"SELECT {STEP_COLUMNS} FROM steps")
def incremental_steps(spark, sf_dir):
    return replication.incremental_steps(candidates(spark, sf_dir))


@query(STEPS_SQL.replace("{base}", "early") + f"SELECT {STEP_COLUMNS} FROM steps")
def incremental_steps_long(spark, sf_dir):
    return replication.incremental_steps(early_candidates(spark, sf_dir))


@query(
    STEPS_SQL.replace("{base}", "early") + """
SELECT rel_dataset, '-i' AS flag, from_name, name AS to_name, 1 AS snapshots, coalesce(written, 0) AS written,
  createtxg AS to_createtxg FROM islands WHERE included AND NOT is_base"""
)
def incremental_steps_single(spark, sf_dir):
    """Every row on its own."""
    steps = replication.incremental_steps(early_candidates(spark, sf_dir), force_i=True)
    return steps.withColumn("snapshots", F.col("snapshots").cast("int"))


@query(
    STEPS_SQL.replace("{base}", "early") + """
SELECT rel_dataset, max(CASE WHEN is_base THEN name END) AS from_name,
  arg_max(name, rn) FILTER (WHERE included AND NOT is_base) AS to_name FROM islands GROUP BY rel_dataset
HAVING count(*) FILTER (WHERE included AND NOT is_base) > 0"""
)
def no_stream_steps(spark, sf_dir):
    return replication.no_stream_steps(early_candidates(spark, sf_dir)).select("rel_dataset", "from_name", "to_name")


@query(
    STEPS_SQL.replace("{base}", "early") + """
SELECT rel_dataset, to_name, written, snapshots,
  CAST(sum(written) OVER (PARTITION BY rel_dataset) AS BIGINT) AS total_bytes,
  CAST(sum(written) OVER w - written AS BIGINT) AS done_bytes,
  CAST(sum(snapshots) OVER (PARTITION BY rel_dataset) AS BIGINT) AS total_snapshots,
  CAST(sum(snapshots) OVER w - snapshots AS BIGINT) AS done_snapshots,
  lead(to_name) OVER w IS NULL AS is_last
FROM steps WINDOW w AS (PARTITION BY rel_dataset ORDER BY to_createtxg, to_name)"""
)
def step_sizes(spark, sf_dir):
    sized = replication.step_sizes(replication.incremental_steps(early_candidates(spark, sf_dir)))
    return sized.select(
        "rel_dataset", "to_name", "written", "snapshots", "total_bytes", "done_bytes", "total_snapshots",
        "done_snapshots", "is_last",
    )


@query(
    STEPS_SQL.replace("{base}", "early") + """
, sent AS (SELECT *, lead(name) OVER (PARTITION BY rel_dataset ORDER BY rn) AS next FROM islands WHERE included AND NOT is_base)
SELECT rel_dataset, name FROM sent WHERE next IS NULL OR regexp_full_match(tag, '.*_(?:daily|weekly|monthly)')"""
)
def bookmark_targets(spark, sf_dir):
    """Sent rows of at least a day's period, and the last one."""
    return replication.rows_to_bookmark(early_candidates(spark, sf_dir), "daily").select("rel_dataset", "name")


@query(
    STEPS_SQL.replace("{base}", "early") + """
SELECT CAST(sum(snapshots) AS BIGINT) AS snapshots, CAST(sum(written) AS BIGINT) AS bytes,
  CAST(round_even(sum(written) * 1e9 / 90000000000, 0) AS BIGINT) AS bytes_per_second FROM steps"""
)
def replication_totals(spark, sf_dir):
    steps = replication.incremental_steps(early_candidates(spark, sf_dir))
    return replication.replication_summary(steps, 90_000_000_000).select("snapshots", "bytes", "bytes_per_second")


@query(
    CATALOG_SQL + r"""
, tmp AS (
  SELECT rel_dataset, guid, name, substr(tag, 6) AS rest FROM src WHERE kind = 'tmp_bookmark'
), named AS (
  SELECT rel_dataset, guid, name, 'tank1/src' || rel_dataset || '#'
    || regexp_extract(rest, '^(.*)_([^_.]*)\.([^.]*)\.([^.]*)\.([^.]*)$', 1) || '_' || guid || '_'
    || regexp_extract(rest, '^(.*)_([^_.]*)\.([^.]*)\.([^.]*)\.([^.]*)$', 2) AS final FROM tmp
)
SELECT 'promote' AS action, rel_dataset, name AS from_name, final AS to_name FROM named n
WHERE EXISTS (SELECT 1 FROM dst d WHERE d.kind = 'snapshot' AND d.rel_dataset = n.rel_dataset AND d.guid = n.guid)
UNION ALL SELECT 'delete', rel_dataset, name, '-' FROM named"""
)
def bookmark_plan(spark, sf_dir):
    src = catalog(spark, sf_dir, "src").filter(F.col("kind") != "snapshot")
    return bookmarks.bookmark_plan(src, catalog(spark, sf_dir, "dst")).fillna("-")


@query(
    """
WITH props AS (
  SELECT 'tank1/p' || p_partkey AS dataset, unnest([
    {'property': 'compression', 'value': p_type, 'source': CASE WHEN p_size < 25 THEN 'local' ELSE 'inherited' END},
    {'property': 'recordsize', 'value': CAST(p_size AS VARCHAR), 'source': 'local'},
    {'property': 'volsize', 'value': CAST(p_size AS VARCHAR), 'source': 'local'},
    {'property': 'org:brand', 'value': p_brand, 'source': 'local'},
    {'property': 'org:name', 'value': p_name, 'source': CASE WHEN p_size < 10 THEN 'received' ELSE 'local' END}]) AS p,
    p_type = 'ECONOMY' AS is_volume FROM part
), flat AS (SELECT dataset, p.property AS property, p.value AS value, p.source AS source, is_volume FROM props),
judged AS (
  SELECT *, source = 'local' AND property IN ('compression', 'recordsize', 'volsize', 'org:brand') AND property <> 'org:brand' AS o,
    source IN ('local', 'received') AND regexp_full_match(property, 'org:.*|compression') AS x,
    source = 'local' AND property = 'org:name' AS s FROM flat
)
SELECT dataset, '-o' AS option, property, value FROM judged WHERE o AND property <> 'volsize'
  AND NOT (is_volume AND property = 'recordsize')
UNION ALL SELECT dataset, '-x', property, '-' FROM judged WHERE x AND NOT o AND property <> 'org:brand'
UNION ALL SELECT dataset, 'set', property, value FROM judged WHERE s
UNION ALL SELECT DISTINCT dataset, '-x', 'org:brand', '-' FROM flat"""
)
def properties_to_copy(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = F.col("p_size").cast("string")

    def prop(name, value, source):
        return F.struct(F.lit(name).alias("property"), value.alias("value"), source.alias("source"))

    local = F.lit("local")
    rows = F.array(
        prop("compression", F.col("p_type"), F.when(F.col("p_size") < 25, "local").otherwise("inherited")),
        prop("recordsize", text, local),
        prop("volsize", text, local),
        prop("org:brand", F.col("p_brand"), local),
        prop("org:name", F.col("p_name"), F.when(F.col("p_size") < 10, "received").otherwise("local")),
    )
    props = part.select(
        F.concat(F.lit("tank1/p"), "p_partkey").alias("dataset"), (F.col("p_type") == "ECONOMY").alias("is_volume"),
        F.inline(rows),
    )
    groups = [
        PropertyGroup("-o", ("compression|recordsize|volsize|org:brand",)),
        PropertyGroup("-x", ("org:.*", "compression"), sources=("local", "received")),
        PropertyGroup("set", ("org:name",)),
        PropertyGroup("set", (".*",), targets=("incremental",)),
    ]
    return properties.property_plan(props, groups, full=True, explicit_excludes=["org:brand"]).fillna("-")
