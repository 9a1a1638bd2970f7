"""Stored stages, shared folders and ordered numbering for the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapcat.session import ensure_checkpoint_dir


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application, for clusters where it is not installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "snapcat.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder of the cluster, as a URI."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base if ':/' in base else 'file://' + base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and returns the written rows.

    This cuts the lineage, so a lost executor costs no more than the stage at hand. The plan of the finished job is garbage
    afterwards; collecting it lets Spark's cleaner delete that job's shuffle files. The first collection clears the plan, the
    second what it alone still held.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    return spark.read.schema(df.schema).parquet(path)


def blank_free(df: DataFrame, prefix: str) -> str:
    """A column prefix that no column of df starts with."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return prefix


def let(value, body):
    """body(value) with value computed once per row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, group: str, *order: str, into: str, name: str) -> DataFrame:
    """df with ``into``: the position from 0 within ``group`` in the order of ``order``.

    Rows are range-partitioned by (group, order), so that a group with most rows spreads over many partitions; a position is
    the row's place in its partition plus the rows of the group in earlier partitions. What is summed in one window is one
    row per partition and group.
    """
    ranged = (
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    rows = stored(ranged, name).withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (
        rows.join(parts.select("_part", group, "_first", "_before"), ["_part", group])
        .withColumn(into, F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_part", "_first", "_before")
    )


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (doc_id, component_id) per linked id, the smallest id it can reach.

    Links of an id with itself count for nothing.

    Alternates large-star and small-star steps until no link changes. Each step sends an id's neighbours no further than
    aggregates with map-side combine: the smallest neighbour is joined back to the links, no neighbour list is gathered.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        edges = stored(small, "links")
        now = edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
        if now == before:
            break
        before = now
    least = edges.groupBy(F.col("u").alias("doc_id")).agg(F.min("v").alias("component_id"))
    return least.unionByName(edges.select(F.col("v").alias("doc_id"), F.col("v").alias("component_id")).distinct())


def hot_limit(spark: SparkSession, total: int) -> tuple[int, int]:
    """(least, most): keys with ``least`` rows or more count as hot; there cannot be more than ``most`` of them."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    least = max(1000, total // (4 * parts))
    return least, total // least


def look_up(rows: DataFrame, found: DataFrame, key: str, spread, least: int, with_key: bool = True) -> DataFrame:
    """Left join of rows with ``found`` (one row per string or binary ``key``, the number of its rows in ``_count``).

    Hot keys are few by proof (see :func:`hot_limit`), so their entries are broadcast; their rows then take a key of their
    own (``spread`` tells them apart) and pass through the shuffle of the others evenly. ``found`` must be stored.
    """
    hot = F.broadcast(found.where(F.col("_count") >= least).select(F.col(key), F.struct(*found.columns).alias("_hot")))
    cold = found.where(F.col("_count") < least).select(F.col(key).alias("_key"), F.struct(*found.columns).alias("_cold"))
    own = F.concat(F.lit("#"), spread.cast("string"))
    if rows.schema[key].dataType.typeName() == "binary":
        own = F.encode(own, "UTF-8")
    marked = rows.join(hot, key, "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.col(key), own))
    )
    kept = [c for c in rows.columns if with_key or c != key]
    joined = marked.select(*kept, "_hot", "_key").join(cold, "_key", "left").withColumn("_found", F.coalesce("_hot", "_cold"))
    others = [c for c in found.columns if c != key]
    return joined.select(*kept, *[F.col("_found")[c].alias(c) for c in others])
