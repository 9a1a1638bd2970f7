"""Registered queries: every operator over catalogs derived from the given tables, each with the SQL it must equal.

The virtual catalog: every event is a snapshot event of its user's dataset. The number ``k`` in ``props`` decides on
which side a row still exists and as what, so both sides overlap partly, bookmarks outlive snapshots and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.functions.hashing import compact_guid
from snapcat.schema import TMP_PREFIX

NOW = 1706659200  # 2024-01-31 00:00:00 UTC
SRC_ROOT, DST_ROOT = "tank1/src", "tank2/dst"
POOL_SUFFIX = ".AAAfaLnRWNQ.mjKQwJEMnjk"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(table(spark, sf_dir, "events"))


def event_columns(ev: DataFrame) -> DataFrame:
    """Events with the parts all catalogs share. ``ts`` is a wall clock without zone; its seconds are taken from the
    date and time parts, whatever the session zone is."""
    return ev.selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "CAST(ts AS TIMESTAMP_NTZ) AS ts",
        """CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k""",
    ).selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "k",
        "unix_date(CAST(ts AS DATE)) * 86400L + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS creation",
        "concat('/g', user_id div 16, '/u', user_id) AS rel_dataset",
        """concat('prod_', CASE WHEN k < 50 THEN 'onsite_' ELSE '' END, date_format(ts, "yyyy-MM-dd'_'HH:mm:ss.SSSSSS"),
           CASE event_type WHEN 'error' THEN '_minutely' WHEN 'click' THEN '_hourly' WHEN 'view' THEN '_daily'
           WHEN 'signup' THEN '_weekly' ELSE '_monthly' END) AS tag""",
        "CAST(event_id AS STRING) AS guid",
        "CAST(floor(value * 100) AS BIGINT) AS written",
        "k >= 30 AND k < 40 AS held",
    )


# which rows an event leaves on a side, as (condition on k, kind, separator)
SIDES = {
    "src": (
        ("k < 85", "snapshot", "@"),
        ("k >= 75 AND k < 91", "bookmark", "#"),
        ("k >= 88 AND k < 95 OR k >= 98", "tmp_bookmark", "#"),
    ),
    "dst": (
        ("k >= 20 AND k < 98", "snapshot", "@"),
        ("k >= 10 AND k < 30 OR k >= 95 AND k < 98", "bookmark", "#"),
    ),
}


def catalog(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """One side's rows. One scan: an event becomes up to three rows (snapshot, bookmark, temporary bookmark)."""
    root = SRC_ROOT if side == "src" else DST_ROOT
    ev = events(spark, sf_dir)
    tmp_tag = F.concat(F.lit(TMP_PREFIX), "tag", F.lit("."), compact_guid(F.col("guid")), F.lit(POOL_SUFFIX))
    tagged = ev.withColumn("tmp_tag", tmp_tag)
    rows = ", ".join(
        f"CASE WHEN {test} THEN struct('{kind}' AS kind, {'tmp_tag' if kind == 'tmp_bookmark' else 'tag'} AS tag,"
        f" {'written' if kind == 'snapshot' else 'CAST(NULL AS BIGINT)'} AS written, '{sep}' AS sep) END"
        for test, kind, sep in SIDES[side]
    )
    exploded = tagged.selectExpr(
        "event_id", "rel_dataset", "guid", "creation", "held", f"inline(array({rows}))"
    )
    return exploded.filter("kind IS NOT NULL").selectExpr(
        f"'{side}' AS side",
        f"'{root}' AS root",
        f"concat('{root}', rel_dataset) AS dataset",
        "rel_dataset",
        "kind",
        "tag",
        f"concat('{root}', rel_dataset, sep, tag) AS name",
        "guid",
        "creation",
        "event_id AS createtxg" if side == "src" else "event_id + 7 AS createtxg",
        "written",
        "held AND kind = 'snapshot' AS held",
    )


def dataset_list(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Datasets of a side: users with an event of small (src) or large (dst) k."""
    root = SRC_ROOT if side == "src" else DST_ROOT
    chosen = events(spark, sf_dir).filter("k < 2" if side == "src" else "k >= 98").select("rel_dataset").distinct()
    return chosen.selectExpr(f"concat('{root}', rel_dataset) AS dataset", "rel_dataset", f"'{root}' AS root")


CATALOG_SQL = f"""
WITH ev AS (
  SELECT event_id, user_id, event_type, value,
    CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k,
    CAST(floor(epoch(ts)) AS BIGINT) AS creation, ts,
    '/g' || CAST(user_id // 16 AS VARCHAR) || '/u' || CAST(user_id AS VARCHAR) AS rel_dataset,
    CAST(event_id AS VARCHAR) AS guid,
    CAST(floor(value * 100) AS BIGINT) AS written0,
    'prod_' || CASE WHEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) < 50 THEN 'onsite_' ELSE '' END
      || strftime(ts, '%Y-%m-%d_%H:%M:%S.%f')
      || CASE event_type WHEN 'error' THEN '_minutely' WHEN 'click' THEN '_hourly' WHEN 'view' THEN '_daily'
         WHEN 'signup' THEN '_weekly' ELSE '_monthly' END AS tag0
  FROM events
), ev2 AS (
  SELECT *, '{TMP_PREFIX}' || tag0 || '.'
    || replace(replace(replace(replace(to_base64(unhex(lpad(to_hex(event_id), 16, '0'))), '+', '-'), '/', ':'), '=', ''), '_', ':')
    || '{POOL_SUFFIX}' AS tmp_tag
  FROM ev
), src_rows AS (
  SELECT rel_dataset, 'snapshot' AS kind, tag0 AS tag, '@' AS sep, guid, creation, event_id AS createtxg,
    written0 AS written, k >= 30 AND k < 40 AS held FROM ev2 WHERE k < 85
  UNION ALL
  SELECT rel_dataset, 'bookmark', tag0, '#', guid, creation, event_id, NULL, false FROM ev2 WHERE k >= 75 AND k < 91
  UNION ALL
  SELECT rel_dataset, 'tmp_bookmark', tmp_tag, '#', guid, creation, event_id, NULL, false FROM ev2
  WHERE (k >= 88 AND k < 95) OR k >= 98
), dst_rows AS (
  SELECT rel_dataset, 'snapshot' AS kind, tag0 AS tag, '@' AS sep, guid, creation, event_id + 7 AS createtxg,
    written0 AS written, k >= 30 AND k < 40 AS held FROM ev2 WHERE k >= 20 AND k < 98
  UNION ALL
  SELECT rel_dataset, 'bookmark', tag0, '#', guid, creation, event_id + 7, NULL, false FROM ev2
  WHERE (k >= 10 AND k < 30) OR (k >= 95 AND k < 98)
), src AS (
  SELECT '{SRC_ROOT}' AS root, '{SRC_ROOT}' || rel_dataset AS dataset, '{SRC_ROOT}' || rel_dataset || sep || tag AS name, *
  FROM src_rows
), dst AS (
  SELECT '{DST_ROOT}' AS root, '{DST_ROOT}' || rel_dataset AS dataset, '{DST_ROOT}' || rel_dataset || sep || tag AS name, *
  FROM dst_rows
), src_ds AS (
  SELECT DISTINCT rel_dataset, '{SRC_ROOT}' || rel_dataset AS dataset FROM ev WHERE k < 2
), dst_ds AS (
  SELECT DISTINCT rel_dataset, '{DST_ROOT}' || rel_dataset AS dataset FROM ev WHERE k >= 98
)"""
