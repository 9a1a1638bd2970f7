"""Comparison of two catalogs by content identity (guid)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.human import human_bytes, human_duration
from snapcat.functions.periods import iso_from_unix
from snapcat.operators.filters import Filter, flag_snapshots
from snapcat.operators.ordered import CHUNK_BITS, ordered_scan
from snapcat.schema import COMPARISON_COLUMNS, COMPARISON_ORDER, SNAPSHOT, TMP_BOOKMARK

LOCATIONS = ("all", "src", "dst")


def dedupe_bookmarks(df: DataFrame, selected: Column | None = None) -> DataFrame:
    """One row per (rel_dataset, guid): the snapshot before its bookmark. A temporary bookmark only counts where no
    other row has its guid; that is decided before ``selected`` filters the other rows. One aggregation, over the
    columns a name is made of instead of the name."""
    is_tmp = F.col("kind") == TMP_BOOKMARK
    chosen = F.lit(True) if selected is None else selected
    rest = ["root", "kind", "creation", "written"]
    row = F.struct((F.col("kind") != SNAPSHOT).alias("second"), "createtxg", "tag", *rest)
    best = df.groupBy("rel_dataset", "guid").agg(
        F.min(F.when(~is_tmp & chosen, row)).alias("best"),
        F.min(F.when(is_tmp, row)).alias("tmp"),
        F.max(~is_tmp).alias("has_other"),
    )
    winner = F.coalesce("best", F.when(~F.col("has_other"), F.col("tmp")))
    return (
        best.select("rel_dataset", "guid", winner.alias("row"))
        .filter(F.col("row").isNotNull())
        .select("rel_dataset", "guid", "row.createtxg", "row.tag", *[f"row.{c}" for c in rest])
        .withColumn("name", F.concat("root", "rel_dataset", F.when(F.col("kind") == SNAPSHOT, "@").otherwise("#"), "tag"))
    )


def compare_catalogs(
    src: DataFrame,
    dst: DataFrame,
    locations: Sequence[str] = LOCATIONS,
    groups: Sequence[Sequence[Filter]] | None = None,
    now: float | None = None,
) -> DataFrame:
    """Full outer join on (rel_dataset, guid): ``all``, ``src`` or ``dst`` per row, source columns where both have it.
    Temporary source bookmarks show only if the destination has their guid. ``groups`` filters both sides first.

    Both sides are aggregated by the join keys, so the join needs no further shuffle."""

    def side(df: DataFrame) -> DataFrame:
        if groups is None:
            return dedupe_bookmarks(df)
        others = flag_snapshots(df.filter(F.col("kind") != TMP_BOOKMARK), groups, bookmarks=True, now=now)
        tmp = df.filter(F.col("kind") == TMP_BOOKMARK).withColumn("selected", F.lit(True))
        return dedupe_bookmarks(others.unionByName(tmp), F.col("selected"))

    keys = ["rel_dataset", "guid"]
    columns = ["root", "kind", "creation", "createtxg", "written", "tag"]
    s = side(src).select(*keys, F.struct(*columns).alias("s"))
    d = side(dst).select(*keys, F.struct(*columns).alias("d"))
    location = F.when(F.col("d").isNull(), "src").when(F.col("s").isNull(), "dst").otherwise("all")
    joined = s.join(d, keys, "full_outer").select(*keys, location.alias("location"), F.coalesce("s", "d").alias("row"))
    rows = joined.filter(
        F.col("location").isin(*locations) & ~((F.col("location") == "src") & (F.col("row.kind") == TMP_BOOKMARK))
    )
    separator = F.when(F.col("row.kind") == SNAPSHOT, "@").otherwise("#")
    return rows.select(
        "location",
        iso_from_unix(F.col("row.creation")).alias("creation_iso"),
        "row.createtxg",
        F.concat("rel_dataset", separator, "row.tag").alias("rel_name"),
        "guid",
        F.col("row.root").alias("root_dataset"),
        "rel_dataset",
        F.concat("row.root", "rel_dataset", separator, "row.tag").alias("name"),
        "row.creation",
        "row.written",
        "row.tag",
    )


def order_comparison(cmp: DataFrame) -> DataFrame:
    return cmp.orderBy("rel_dataset", *COMPARISON_ORDER)


def comparison_columns(cmp: DataFrame) -> DataFrame:
    """The ten columns of the comparison file."""
    return cmp.select(*COMPARISON_COLUMNS)


def compare_datasets(src: DataFrame, dst: DataFrame) -> DataFrame:
    """``location, rel_dataset, src_dataset, dst_dataset``; the absent side is empty."""
    s = src.select("rel_dataset", F.col("dataset").alias("s"))
    d = dst.select("rel_dataset", F.col("dataset").alias("d"))
    return s.join(d, "rel_dataset", "full_outer").select(
        F.when(F.col("d").isNull(), "src").when(F.col("s").isNull(), "dst").otherwise("all").alias("location"),
        "rel_dataset",
        F.coalesce("s", F.lit("")).alias("src_dataset"),
        F.coalesce("d", F.lit("")).alias("dst_dataset"),
    )


def pair_datasets(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Datasets of both sides that belong together: ``rel_dataset, src_dataset, dst_dataset``."""
    return src.select("rel_dataset", F.col("dataset").alias("src_dataset")).join(
        dst.select("rel_dataset", F.col("dataset").alias("dst_dataset")), "rel_dataset"
    )


def since_common(cmp: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds ``latest_common`` (null if there is none) and whether a row comes after it in comparison order.

    The greatest common key of a dataset is taken over its rows where they are, in one shuffle by dataset."""
    key = F.struct(*COMPARISON_ORDER)
    common = F.when(F.col("location") == "all", key)
    marked = ordered_scan(cmp, ["rel_dataset"], [*COMPARISON_ORDER], bests={"latest_common": common}, bits=bits)
    return marked.withColumn("since_common", F.col("latest_common").isNull() | (key > F.col("latest_common")))


def comparison_stats(
    cmp: DataFrame,
    now: int,
    datasets: DataFrame | None = None,
    locations: Sequence[str] = LOCATIONS,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """One row per (rel_dataset, location), also for further datasets without any snapshot that ``datasets`` lists: counts,
    bytes, latest and oldest row, the same since the latest common snapshot (null without one), and time differences.

    One pass over the comparison: all statistics of a dataset are one aggregate, which finds its rows together already.
    """
    since = F.col("since_common")
    written = F.coalesce("written", F.lit(0))
    key = F.struct(*COMPARISON_ORDER, "name")

    def of(location: str) -> Column:
        own = F.col("location") == location
        return F.struct(
            F.lit(location).alias("location"),
            F.count_if(own).alias("snapshots"),
            F.coalesce(F.sum(F.when(own, written)), F.lit(0).cast("bigint")).alias("sum_written"),
            F.count_if(own & since).alias("since"),
            F.coalesce(F.sum(F.when(own & since, written)), F.lit(0).cast("bigint")).alias("written_since"),
            F.max(F.when(own, key)).alias("latest"),
            F.min(F.when(own, key)).alias("oldest"),
        )

    per_dataset = since_common(cmp, bits).groupBy("rel_dataset").agg(
        F.array(*[of(x) for x in locations]).alias("of"), F.max("latest_common")["creation"].alias("common_creation")
    )
    if datasets is not None:
        per_dataset = per_dataset.join(datasets.select("rel_dataset").distinct(), "rel_dataset", "full_outer")
    places = F.explode(F.array(*[F.lit(x) for x in locations])).alias("location")
    own = F.filter("of", lambda x: x["location"] == F.col("location"))[0]
    each = per_dataset.select("rel_dataset", "common_creation", "of", places).withColumn("x", own)
    parts = ("snapshots", "sum_written", "since", "written_since", "latest", "oldest")
    joined = each.select("rel_dataset", "common_creation", "location", *[f"x.{c}" for c in parts])
    has_common = F.col("common_creation").isNotNull() & (F.col("location") != "all")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "rel_dataset",
        "location",
        F.coalesce("snapshots", zero).alias("snapshots"),
        F.coalesce("sum_written", zero).alias("sum_written"),
        F.col("latest.name").alias("latest_name"),
        F.col("oldest.name").alias("oldest_name"),
        F.when(has_common, F.coalesce("since", zero)).alias("snapshots_since"),
        F.when(has_common, F.coalesce("written_since", zero)).alias("written_since"),
        F.when(has_common, F.col("common_creation") - F.col("latest.creation")).alias("common_minus_latest"),
        F.when(has_common, F.col("common_creation") - F.col("oldest.creation")).alias("common_minus_oldest"),
        (F.lit(now) - F.col("latest.creation")).alias("latest_age"),
        (F.lit(now) - F.col("oldest.creation")).alias("oldest_age"),
    )


def sync_verdict(cmp: DataFrame, locations: Sequence[str] = LOCATIONS) -> DataFrame:
    """Per dataset: nothing missing on either side and something in common; null unless all three were compared."""
    counted = cmp.groupBy("rel_dataset").agg(*[F.count_if(F.col("location") == x).alias(x) for x in LOCATIONS])
    verdict = (F.col("src") == 0) & (F.col("dst") == 0) & (F.col("all") > 0)
    if set(locations) != set(LOCATIONS):
        verdict = F.lit(None).cast("boolean")
    return counted.select("rel_dataset", verdict.alias("in_sync"))


def comparison_report(stats: DataFrame) -> DataFrame:
    """The statistics as text, ``n/a`` where there is nothing to say."""

    def shown(value: Column) -> Column:
        return F.coalesce(value, F.lit("n/a"))

    return stats.select(
        "rel_dataset",
        "location",
        shown(F.col("latest_name")).alias("latest_snapshot"),
        shown(F.col("oldest_name")).alias("oldest_snapshot"),
        F.col("snapshots").cast("string").alias("snapshots"),
        human_bytes(F.col("sum_written")).alias("data_written"),
        shown(F.col("snapshots_since").cast("string")).alias("snapshots_since"),
        shown(human_bytes(F.col("written_since"))).alias("data_written_since"),
        *[
            shown(human_duration(F.col(c), "s")).alias(c)
            for c in ("common_minus_latest", "common_minus_oldest", "latest_age", "oldest_age")
        ],
    )
