"""Catalog comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, NOW, catalog, dataset_list, query
from snapcat.operators import compare
from snapcat.operators.filters import RegexFilter, times_and_ranks

# one row per (rel_dataset, guid), the snapshot before its bookmark, a temporary bookmark only on its own
COMPARE_SQL = CATALOG_SQL + """
, ranked AS (
  SELECT 'src' AS side, *, row_number() OVER (PARTITION BY rel_dataset, guid
    ORDER BY CASE kind WHEN 'snapshot' THEN 0 WHEN 'bookmark' THEN 1 ELSE 2 END, createtxg, tag) AS rn FROM src
  UNION ALL
  SELECT 'dst', *, row_number() OVER (PARTITION BY rel_dataset, guid
    ORDER BY CASE kind WHEN 'snapshot' THEN 0 WHEN 'bookmark' THEN 1 ELSE 2 END, createtxg, tag) FROM dst
), cmp AS (
  SELECT CASE WHEN d.guid IS NULL THEN 'src' WHEN s.guid IS NULL THEN 'dst' ELSE 'all' END AS location,
    coalesce(s.rel_dataset, d.rel_dataset) AS rel_dataset, coalesce(s.guid, d.guid) AS guid,
    coalesce(s.root, d.root) AS root_dataset, coalesce(s.name, d.name) AS name,
    coalesce(s.creation, d.creation) AS creation, coalesce(s.createtxg, d.createtxg) AS createtxg,
    CASE WHEN s.guid IS NULL THEN d.written ELSE s.written END AS written, coalesce(s.tag, d.tag) AS tag
  FROM (SELECT * FROM ranked WHERE side = 'src' AND rn = 1) s
  FULL OUTER JOIN (SELECT * FROM ranked WHERE side = 'dst' AND rn = 1) d
    ON s.rel_dataset = d.rel_dataset AND s.guid = d.guid
  WHERE NOT (d.guid IS NULL AND s.kind = 'tmp_bookmark')
)"""


def comparison(spark, sf_dir):
    return compare.compare_catalogs(catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst"))


@query(
    COMPARE_SQL
    + """
SELECT location, strftime(make_timestamp(creation * 1000000), '%Y-%m-%d_%H:%M:%S') || '+00:00' AS creation_iso, createtxg,
  substr(name, length(root_dataset) + 1) AS rel_name, guid, root_dataset, rel_dataset, name, creation,
  coalesce(written, -1) AS written
FROM cmp"""
)
def compare_snapshots(spark, sf_dir):
    cmp = compare.comparison_columns(comparison(spark, sf_dir))
    return cmp.withColumn("written", F.coalesce("written", F.lit(-1).cast("bigint")))


@query(
    COMPARE_SQL
    + f"""
, latest AS (
  SELECT rel_dataset, max(struct_pack(a := creation, b := createtxg, c := tag)) AS common FROM cmp
  WHERE location = 'all' GROUP BY rel_dataset
), marked AS (
  SELECT cmp.*, latest.common, struct_pack(a := creation, b := createtxg, c := tag) AS pos
  FROM cmp LEFT JOIN latest USING (rel_dataset)
), stats AS (
  SELECT rel_dataset, location, count(*) AS snapshots, sum(coalesce(written, 0)) AS sum_written,
    arg_max(name, pos) AS latest_name, arg_min(name, pos) AS oldest_name,
    count(*) FILTER (WHERE pos > common) AS since,
    coalesce(sum(coalesce(written, 0)) FILTER (WHERE pos > common), 0) AS written_since,
    arg_max(creation, pos) AS latest, arg_min(creation, pos) AS oldest
  FROM marked GROUP BY rel_dataset, location
), names AS (SELECT DISTINCT rel_dataset FROM cmp UNION SELECT rel_dataset FROM src_ds UNION SELECT rel_dataset FROM dst_ds
), grid AS (SELECT rel_dataset, unnest(['all', 'src', 'dst']) AS location FROM names)
SELECT grid.rel_dataset, grid.location, coalesce(snapshots, 0) AS snapshots,
  CAST(coalesce(sum_written, 0) AS BIGINT) AS sum_written, coalesce(latest_name, 'n/a') AS latest_name,
  coalesce(oldest_name, 'n/a') AS oldest_name,
  CAST(CASE WHEN grid.location = 'all' OR common IS NULL THEN -1 ELSE coalesce(since, 0) END AS BIGINT) AS snapshots_since,
  CAST(CASE WHEN grid.location = 'all' OR common IS NULL THEN -1 ELSE coalesce(written_since, 0) END AS BIGINT) AS written_since,
  coalesce(CASE WHEN grid.location <> 'all' THEN common.a - latest END, -1) AS common_minus_latest,
  coalesce(CASE WHEN grid.location <> 'all' THEN common.a - oldest END, -1) AS common_minus_oldest,
  coalesce({NOW} - latest, -1) AS latest_age, coalesce({NOW} - oldest, -1) AS oldest_age
FROM grid LEFT JOIN stats USING (rel_dataset, location) LEFT JOIN latest ON grid.rel_dataset = latest.rel_dataset"""
)
def compare_stats(spark, sf_dir):
    cmp = comparison(spark, sf_dir)
    listed = dataset_list(spark, sf_dir, "src").unionByName(dataset_list(spark, sf_dir, "dst"))
    stats = compare.comparison_stats(cmp, NOW, listed)
    gaps = ["snapshots_since", "written_since", "common_minus_latest", "common_minus_oldest", "latest_age", "oldest_age"]
    return stats.fillna(-1, gaps).fillna("n/a", ["latest_name", "oldest_name"])


@query(
    COMPARE_SQL
    + """
SELECT rel_dataset, count(*) FILTER (WHERE location = 'src') = 0 AND count(*) FILTER (WHERE location = 'dst') = 0
  AND count(*) FILTER (WHERE location = 'all') > 0 AS in_sync FROM cmp GROUP BY rel_dataset"""
)
def compare_sync_verdict(spark, sf_dir):
    return compare.sync_verdict(comparison(spark, sf_dir))


@query(
    CATALOG_SQL
    + """
SELECT CASE WHEN d.dataset IS NULL THEN 'src' WHEN s.dataset IS NULL THEN 'dst' ELSE 'all' END AS location, rel_dataset,
  coalesce(s.dataset, '') AS src_dataset, coalesce(d.dataset, '') AS dst_dataset
FROM src_ds s FULL OUTER JOIN dst_ds d USING (rel_dataset)"""
)
def compare_dataset_lists(spark, sf_dir):
    return compare.compare_datasets(dataset_list(spark, sf_dir, "src"), dataset_list(spark, sf_dir, "dst"))


@query(
    CATALOG_SQL
    + f"""
, judged AS (
  SELECT 'src' AS side, *, kind = 'snapshot' AS is_snap FROM src WHERE kind <> 'tmp_bookmark'
    AND regexp_full_match(tag, '.*_(?:daily|hourly)')
  UNION ALL SELECT 'dst', *, kind = 'snapshot' FROM dst WHERE kind <> 'tmp_bookmark'
    AND regexp_full_match(tag, '.*_(?:daily|hourly)')
), ranks AS (
  SELECT side, dataset, name, row_number() OVER w - 1 AS rk, count(*) OVER (PARTITION BY side, dataset) AS n
  FROM judged WHERE is_snap WINDOW w AS (PARTITION BY side, dataset ORDER BY createtxg, creation, tag)
), chosen AS (
  SELECT j.* FROM judged j LEFT JOIN ranks r USING (side, dataset, name)
  WHERE (is_snap AND rk >= n - round_even(n * 60 / 100.0, 0)) OR j.creation >= {NOW - 10 * 86400}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY side, rel_dataset, guid ORDER BY kind <> 'snapshot', createtxg, tag) AS rn
  FROM chosen
), tmp AS (
  SELECT rel_dataset, guid, name, kind FROM (SELECT *, count(*) FILTER (WHERE kind <> 'tmp_bookmark')
    OVER (PARTITION BY rel_dataset, guid) AS others FROM src) WHERE kind = 'tmp_bookmark' AND others = 0
), s AS (
  SELECT rel_dataset, guid, name, kind FROM ranked WHERE side = 'src' AND rn = 1
  UNION ALL SELECT rel_dataset, guid, name, kind FROM tmp
), d AS (SELECT rel_dataset, guid, name FROM ranked WHERE side = 'dst' AND rn = 1)
SELECT CASE WHEN d.guid IS NULL THEN 'src' WHEN s.guid IS NULL THEN 'dst' ELSE 'all' END AS location, rel_dataset, guid,
  coalesce(s.name, d.name) AS name
FROM s FULL OUTER JOIN d USING (rel_dataset, guid) WHERE NOT (d.guid IS NULL AND s.kind = 'tmp_bookmark')"""
)
def compare_filtered(spark, sf_dir):
    """Filtered twins: the filter drops rows on either side before they are compared."""
    group = [RegexFilter((".*_(?:daily|hourly)",)), times_and_ranks("10 days ago..*", "latest 60%")]
    cmp = compare.compare_catalogs(
        catalog(spark, sf_dir, "src"), catalog(spark, sf_dir, "dst"), groups=[group], now=NOW
    )
    return cmp.select("location", "rel_dataset", "guid", "name")
