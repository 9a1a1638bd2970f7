"""Sources and sinks: rows derived from the tables are written in the text forms and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from fleet_queries.base import CATALOG_SQL, SRC_ROOT, catalog, dataset_list, query, table
from fleet_queries.comparing import COMPARE_SQL, comparison
from fleet_queries.logs import LINES_SQL, log_lines
from snapcat.operators import compare, logs
from snapcat.session import ensure_checkpoint_dir
from snapcat.sources import readers, writers


def folder(spark, name):
    """A new folder in the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(spark, name, lines):
    """Writes rows of one text column and returns the folder."""
    path = folder(spark, name)
    lines.write.text(path)
    return path


def tsv(*columns):
    return F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("value")


@query(CATALOG_SQL + "SELECT name, rel_dataset, kind, tag, guid, creation, createtxg, coalesce(written, -1) AS written, held FROM src")
def source_snapshots(spark, sf_dir):
    src = catalog(spark, sf_dir, "src").withColumn("userrefs", F.when(F.col("held"), 2).otherwise(0))
    path = written(spark, "snapshots", src.select(tsv("creation", "guid", "createtxg", "written", "name", "userrefs")))
    rows = readers.read_snapshots(spark, path, "src", SRC_ROOT)
    return rows.select(
        "name", "rel_dataset", "kind", "tag", "guid", "creation", "createtxg",
        F.coalesce("written", F.lit(-1).cast("bigint")).alias("written"), "held",
    )


@query(
    """
SELECT 'tank/p' || p_partkey AS dataset, '/p' || p_partkey AS rel_dataset, p_size < 10 AS is_volume,
  CASE WHEN p_size < 10 THEN -8192 ELSE p_size * 1024 END AS recordsize, CASE WHEN p_size > 40 THEN 0 ELSE p_partkey END AS snapshots_changed
FROM part"""
)
def source_datasets(spark, sf_dir):
    is_volume = F.col("p_size") < 10
    rows = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") <= 40, F.col("p_partkey")).alias("changed"),
        F.when(is_volume, 8192).alias("block"),
        F.when(~is_volume, F.col("p_size") * 1024).alias("record"),
        F.concat(F.lit("tank/p"), "p_partkey").alias("name"),
    )
    path = written(spark, "datasets", rows.select(tsv("changed", "block", "record", "name")))
    return readers.read_datasets(spark, path, "src", "tank").select(
        "dataset", "rel_dataset", "is_volume", "recordsize", "snapshots_changed"
    )


@query("SELECT 'tank1/' || c_name AS src_root, 'tank2/' || c_mktsegment || '/' || c_name AS dst_root FROM customer")
def source_root_pairs(spark, sf_dir):
    pair = F.concat(F.lit("tank1/"), "c_name", F.lit("\ttank2/"), "c_mktsegment", F.lit("/"), "c_name")
    lines = F.explode(F.array(F.lit("# one pair per line"), F.lit("  "), pair)).alias("value")
    path = written(spark, "pairs", table(spark, sf_dir, "customer").select(lines))
    return readers.read_root_pairs(spark, path)


@query("SELECT 'tank/s' || s_suppkey AS dataset, 'org:nation' AS property, CAST(s_nationkey AS VARCHAR) AS value, 'local' AS source FROM supplier WHERE s_acctbal > 0")
def source_properties(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("tank/s"), "s_suppkey").alias("dataset"), F.lit("org:nation").alias("property"),
        F.col("s_nationkey").alias("value"), F.when(F.col("s_acctbal") > 0, "local").otherwise("inherited").alias("source"),
    )
    path = written(spark, "properties", rows.select(tsv("dataset", "property", "value", "source")))
    return readers.read_properties(spark, path, ["local"])


@query(LINES_SQL + "SELECT CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bytes) AS BIGINT) AS delta FROM lines")
def source_transfer_logs(spark, sf_dir):
    """A log whose transfers have two updates each, separated by a carriage return: bytes of the last ones, and the sum
    of all byte deltas."""
    start = F.lit("pool 40 GiB: 12 B 0:00:01 [ 12 B/s] ETA 0:00:09 ETA 09:14:20\r")
    lines = log_lines(table(spark, sf_dir, "events")).select(F.concat(start, "line").alias("value"))
    transfers = readers.read_transfer_logs(spark, written(spark, "logs", lines))
    total = logs.transfer_bytes(transfers).select("bytes", F.lit(0).cast("bigint").alias("delta"))
    deltas = logs.transfer_deltas(transfers).select(F.lit(0).cast("bigint").alias("bytes"), "delta")
    return total.unionByName(deltas).agg(
        F.sum("bytes").cast("bigint").alias("bytes"), F.sum("delta").cast("bigint").alias("delta")
    )


@query(COMPARE_SQL + "SELECT location, name, guid, CAST(creation AS VARCHAR) AS creation, coalesce(CAST(written AS VARCHAR), '-') AS written FROM cmp")
def sink_comparison(spark, sf_dir):
    path = folder(spark, "comparison")
    writers.write_comparison(comparison(spark, sf_dir), path)
    return spark.read.csv(path, sep="\t", header=True, quote="").select("location", "name", "guid", "creation", "written")


@query(
    CATALOG_SQL + """
SELECT CASE WHEN d.dataset IS NULL THEN 'src' WHEN s.dataset IS NULL THEN 'dst' ELSE 'all' END AS location, rel_dataset,
  coalesce(s.dataset, '') AS src_dataset, coalesce(d.dataset, '') AS dst_dataset
FROM src_ds s FULL OUTER JOIN dst_ds d USING (rel_dataset)"""
)
def sink_dataset_map(spark, sf_dir):
    path = folder(spark, "map")
    pairs = compare.compare_datasets(dataset_list(spark, sf_dir, "src"), dataset_list(spark, sf_dir, "dst"))
    writers.write_dataset_map(pairs, path)
    return spark.read.csv(path, sep="\t", header=True, quote="").fillna("")


@query(CATALOG_SQL + "SELECT rel_dataset, s.dataset AS src_dataset, d.dataset AS dst_dataset FROM src_ds s JOIN dst_ds d USING (rel_dataset)")
def dataset_pairs(spark, sf_dir):
    return compare.pair_datasets(dataset_list(spark, sf_dir, "src"), dataset_list(spark, sf_dir, "dst"))
