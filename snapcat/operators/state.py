"""Refresh state: which datasets changed since the last run, and how the state table moves forward.

Families of state rows: ``dataset`` (one per dataset), ``label`` (per dataset and schedule label), ``monitor`` (per
dataset and alert) and ``replicate`` (per dataset, destination and filter set).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcat.functions.human import percent
from snapcat.operators.ordered import salted_join
from snapcat.session import shared_folder

KEY = ["namespace", "dataset", "family", "label_key"]
MATURITY_SECONDS = 1.1  # fixed value: a change younger than this is not trusted, clocks have one second resolution


def _same(a: str, b: str) -> Column:
    """Equality that a join on the dataset checks afterwards, not a second join key, which would not be as bucketed."""
    return F.col(a).between(F.col(b), F.col(b))


def _mature(changed: Column, now: float) -> Column:
    return (changed != 0) & (changed < F.lit(now - MATURITY_SECONDS))


def store_buckets(df: DataFrame, name: str, buckets: int | None = None, keep: str | None = None) -> DataFrame:
    """Writes state or live rows as a table bucketed and sorted by dataset and returns its rows. The operators of this
    module join and aggregate tables of equal ``buckets`` (default: the shuffle partitions) without shuffling them again.

    The table lies in the shared folder under a name of its own, so a reader of the table before it is not disturbed;
    ``keep`` names it in the catalog for the next run. A dataset has a row per label, alert and destination, so no bucket
    grows with the rows of the catalogs."""
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = f"{name}_{uuid.uuid4().hex}"
    # dealt like the buckets first: one file per bucket, not one per bucket and task
    writer = df.repartition(buckets, "dataset").write.bucketBy(buckets, "dataset").sortBy("dataset")
    writer.option("path", f"{shared_folder(spark)}/{unique}").format("parquet").saveAsTable(keep or unique)
    return spark.table(keep or unique)


def schedule_hits(live: DataFrame, state: DataFrame, labels: DataFrame | Sequence[str], now: float) -> DataFrame:
    """(dataset, label_key, created) rows that may be answered from state: the dataset row equals the live change time
    and is mature, and every label has a plausible row of that same change time. ``live``: dataset, changed;
    ``labels``: label_key as rows or, for the labels of one schedule, as texts, which need no join."""
    if isinstance(labels, DataFrame):
        keys = labels.select("label_key").distinct()
        listed = state.join(keys, "label_key", "left_semi")
        wanted = labels.agg(F.count_distinct("label_key").alias("wanted"))
    else:
        listed = state.filter(F.col("label_key").isin(list(labels)))
        wanted = len(set(labels))
    cached = state.filter(F.col("family") == "dataset").select("dataset", F.col("changed").alias("cached"))
    fresh = live.join(cached, "dataset").filter(
        _same("cached", "changed") & _mature(F.col("cached"), now)
    )
    per_label = listed.filter(F.col("family") == "label").select("dataset", "label_key", "created", F.col("changed").alias("seen"))
    plausible = (F.col("created") != 0) & _same("seen", "cached") & (F.col("created") <= F.col("seen"))
    valid = fresh.select("dataset", "cached").join(per_label, "dataset").filter(plausible)
    # a dataset has a row per label at most, and the rows lie together from the join
    counted = valid.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("dataset")))
    if isinstance(wanted, int):
        complete = counted.filter(F.col("wanted") == wanted)
    else:
        complete = counted.join(wanted, "wanted", "left_semi")
    return complete.select("dataset", "label_key", "created")


def monitor_hits(live: DataFrame, state: DataFrame, now: float) -> DataFrame:
    """(dataset, label_key, created) rows of family ``monitor`` that are still valid."""
    rows = state.filter(F.col("family") == "monitor").select(
        "dataset", "label_key", "created", F.col("changed").alias("seen")
    )
    valid = _mature(F.col("changed"), now) & _same("changed", "seen") & (F.col("changed") >= F.col("created"))
    return live.join(rows, "dataset").filter(valid).select("dataset", "label_key", "created")


def replicate_hits(live_src: DataFrame, live_dst: DataFrame, state: DataFrame, now: float) -> DataFrame:
    """Datasets unchanged on both sides since the last replication. ``live_src``: dataset, dst_dataset, changed."""
    seen = state.filter(F.col("family") == "replicate").select("dataset", F.col("changed").alias("seen"))
    src_ok = live_src.join(seen, "dataset").filter(
        _mature(F.col("changed"), now) & (F.col("changed") == F.col("seen"))
    )
    dst_seen = state.filter(F.col("family") == "dataset").select(
        F.col("dataset").alias("dst_dataset"), F.col("changed").alias("dst_seen")
    )
    dst = live_dst.select(F.col("dataset").alias("dst_dataset"), F.col("changed").alias("dst_changed"))
    both = src_ok.join(dst, "dst_dataset").join(dst_seen, "dst_dataset")
    return both.filter(
        _mature(F.col("dst_changed"), now) & (F.col("dst_changed") == F.col("dst_seen"))
    ).select("dataset")


def stale_datasets(live: DataFrame, hits: DataFrame, expected: int | None = None) -> DataFrame:
    """Datasets that must be listed again: those without a hit, or with fewer than ``expected`` hits."""
    counted = hits.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    answered = counted if expected is None else counted.filter(F.col("n") >= expected)
    return live.join(answered, "dataset", "left_anti")


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State after an update. The newest ``changed`` wins; on equal ``changed`` the new row does, so its ``created`` may
    differ. A dataset row reported with ``changed`` 0 resets that row (and only that one) if it exists."""
    rows = old.select(*KEY, "created", "changed", F.lit(False).alias("is_new")).unionByName(
        new.select(*KEY, "created", "changed", F.lit(True).alias("is_new"))
    )
    reset = F.col("is_new") & (F.col("family") == "dataset") & (F.col("changed") == 0)
    best = rows.groupBy(*KEY).agg(
        F.max(F.struct(reset.alias("reset"), "changed", "is_new", "created")).alias("best"),
        F.min("is_new").alias("only_new"),
    )
    kept = best.filter(~(F.col("best.reset") & F.col("only_new")))
    value = F.when(F.col("best.reset"), F.lit(0).cast("bigint"))
    return kept.select(
        *KEY,
        F.coalesce(value, "best.created").alias("created"),
        F.coalesce(value, "best.changed").alias("changed"),
    )


def invalidate(state: DataFrame, datasets: DataFrame) -> DataFrame:
    """Resets the dataset and label rows of the given datasets to 0; monitor and replicate rows stay."""
    hit = datasets.select("dataset").distinct().withColumn("__hit", F.lit(True))
    reset = F.coalesce("__hit", F.lit(False)) & F.col("family").isin("dataset", "label")
    joined = state.join(hit, "dataset", "left")
    return joined.select(*KEY, *[F.when(reset, 0).otherwise(F.col(c)).cast("bigint").alias(c) for c in ("created", "changed")])


def mismatched(live: DataFrame, state: DataFrame) -> DataFrame:
    """Datasets whose dataset row is set but differs from the live change time."""
    cached = state.filter((F.col("family") == "dataset") & (F.col("changed") != 0))
    return live.join(cached.select("dataset", F.col("changed").alias("cached")), "dataset").filter(
        F.col("cached") != F.col("changed")
    ).select("dataset")


def trusted_prefix(df: DataFrame, batch: str, seq: str, is_bad: Column) -> DataFrame:
    """Rows of each batch before its first malformed row: the rest of a broken listing is not trusted."""
    first_bad = df.filter(is_bad).groupBy(batch).agg(F.min(seq).alias("__bad"))
    joined = salted_join(df, first_bad, [batch], "left", [seq])
    return joined.filter(F.col("__bad").isNull() | (F.col(seq) < F.col("__bad"))).drop("__bad")


def hit_ratio(live: DataFrame, stale: DataFrame) -> DataFrame:
    """Datasets answered from state and not, as counts and text; one row."""
    missed = stale.groupBy("dataset").agg(F.lit(1).alias("__stale"))
    marked = live.groupBy("dataset").agg(F.lit(1).alias("__live")).join(missed, "dataset", "left")
    counted = marked.agg(
        F.count_if(F.col("__stale").isNull()).alias("hits"), F.count_if(F.col("__stale").isNotNull()).alias("misses")
    )
    total = F.col("hits") + F.col("misses")
    return counted.select(
        "hits",
        "misses",
        percent(F.col("hits"), total, print_total=True).alias("hit_text"),
        percent(F.col("misses"), total, print_total=True).alias("miss_text"),
    )
