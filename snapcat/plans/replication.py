"""Replication plans: common base, action per dataset, and the fewest incremental steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.human import human_bytes, human_duration
from snapcat.functions.periods import label_millis
from snapcat.operators.filters import Filter, flag_snapshots
from snapcat.operators.ordered import CHUNK_BITS, ordered_scan, salted_join
from snapcat.schema import SNAPSHOT

KEY = ["rel_dataset", "guid"]


def _is_snapshot() -> Column:
    return F.col("kind") == SNAPSHOT


def _position() -> Column:
    """Listing order of one side: transaction, then a bookmark before the snapshot it belongs to."""
    return F.struct("createtxg", _is_snapshot().alias("is_snapshot"), "creation", "tag")


def _row(*columns: str) -> Column:
    return F.struct(_position().alias("position"), *columns)


def first_last(df: DataFrame) -> DataFrame:
    """First and last true snapshot per dataset."""
    row = F.when(_is_snapshot(), _row("guid", "name"))
    best = df.groupBy("rel_dataset").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    return best.filter(F.col("first").isNotNull()).select(
        "rel_dataset",
        F.col("first.name").alias("first_name"),
        F.col("first.guid").alias("first_guid"),
        F.col("last.name").alias("last_name"),
        F.col("last.guid").alias("last_guid"),
    )


def latest_common(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The newest source row, snapshot or bookmark, whose guid a destination snapshot has. Look it up in the
    *unfiltered* source. The join runs on (rel_dataset, guid), so a long series is spread over all tasks."""
    common = src.join(dst.filter(_is_snapshot()).select(*KEY), KEY, "left_semi")
    best = common.groupBy("rel_dataset").agg(F.max(_row("guid", "name", "kind")).alias("base"))
    return best.select(
        "rel_dataset",
        F.col("base.position").alias("base_position"),
        F.col("base.guid").alias("base_guid"),
        F.col("base.name").alias("base_name"),
        F.col("base.kind").alias("base_kind"),
    )


def _common_base(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The base of :func:`latest_common`, with the name of the destination row that has its guid."""
    there = dst.filter(_is_snapshot()).groupBy(*KEY).agg(F.max(_row("name"))["name"].alias("there"))
    base = F.max(_row("guid", "name", "there"))
    return src.join(there, KEY).groupBy("rel_dataset").agg(base.alias("base")).select(
        "rel_dataset",
        F.col("base.guid").alias("base_guid"),
        F.col("base.name").alias("base_name"),
        F.col("base.there").alias("common_on_dst"),
    )


def replication_action(
    src: DataFrame,
    dst: DataFrame,
    groups: Sequence[Sequence[Filter]] = ((),),
    force: bool = False,
    missing: str = "dataset",
    use_bookmarks: bool = True,
    datasets: DataFrame | None = None,
    now: float | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Per dataset: ``skip`` / ``error`` (nothing selected, by ``missing`` = dataset / fail), ``up-to-date``, ``full``,
    ``incremental`` or ``conflict`` (the destination is ahead of the common base, or has rows but none in common),
    with the base and the destination row to roll back to. ``force`` turns conflicts into a rollback or a full copy.
    """
    src = src if use_bookmarks else src.filter(_is_snapshot())
    selected = F.col("__selected")
    row = F.when(selected & _is_snapshot(), _row("name"))
    # every dataset of the source, also those without a selected row
    chosen = flag_snapshots(src, groups, now=now, output="__selected", bits=bits).groupBy("rel_dataset").agg(
        F.count_if(selected & _is_snapshot()).alias("selected"),
        F.count_if(selected & ~_is_snapshot()).alias("bookmarks"),
        F.max(row)["name"].alias("latest_selected"),
        F.min(row)["name"].alias("oldest_selected"),
    )
    target = dst.filter(_is_snapshot()).groupBy("rel_dataset").agg(F.max(_row("guid", "name")).alias("newest"))
    joined = chosen
    if datasets is not None:
        joined = datasets.select("rel_dataset").distinct().join(chosen, "rel_dataset", "left")
    for part in (target, _common_base(src, dst)):
        joined = joined.join(part, "rel_dataset", "left")
    dst_guid = F.col("newest.guid")
    has_dst, has_base = dst_guid.isNotNull(), F.col("base_guid").isNotNull()
    n_selected = F.coalesce("selected", F.lit(0).cast("bigint"))
    # bookmarks count as rows only if the destination has something to be based on
    listed = n_selected + F.when(has_dst, F.coalesce("bookmarks", F.lit(0))).otherwise(0)
    is_ahead = has_base & (F.col("base_guid") != dst_guid)
    nothing = {"fail": "error", "dataset": "skip", "continue": "up-to-date"}[missing]
    action = (
        F.when(listed == 0, nothing)
        .when(n_selected == 0, "up-to-date")
        .when(is_ahead & F.lit(not force), "conflict")
        .when(has_base & (F.col("latest_selected") == F.col("base_name")), "up-to-date")
        .when(has_base, "incremental")
        .when(has_dst & F.lit(not force), "conflict")
        .otherwise("full")
    )
    return joined.select(
        "rel_dataset",
        action.alias("action"),
        n_selected.alias("selected"),
        "oldest_selected",
        "latest_selected",
        "base_name",
        "base_guid",
        F.when(is_ahead, F.col("common_on_dst")).alias("rollback_to"),
        F.col("newest.name").alias("latest_dst"),
    )


def candidates_since(src: DataFrame, common: DataFrame) -> DataFrame:
    """The base row of each dataset and all true snapshots listed after it; adds ``is_base``."""
    joined = salted_join(src, common, ["rel_dataset"], "inner", ["guid", "name"])
    is_base = F.col("name") == F.col("base_name")
    later = _is_snapshot() & (_position() > F.col("base_position"))
    return joined.withColumn("is_base", is_base).filter(is_base | later).select(*src.columns, "is_base")


def _step_rows(cands: DataFrame, resume: bool, force_i: bool, bits: int) -> DataFrame:
    """Included rows after the base, each with the row it is sent from, the step it belongs to and whether it is the last.

    One ordered scan gives the position of a row among all rows and among the included ones; the difference is
    constant within an unbroken run. The first row of a run is a hop over excluded rows and its own step; the rest of
    the run is one step."""
    base_opens_run = _is_snapshot() & F.lit(not resume)
    rows = cands.withColumns(
        {
            "included": F.col("included") & _is_snapshot(),
            "__after": (~F.col("is_base")).cast("int"),
        }
    ).withColumns(
        {
            "__in_run": F.col("included") & (~F.col("is_base") | base_opens_run),
            "__sent": (F.col("included") & ~F.col("is_base")).cast("int"),
        }
    )
    scanned = ordered_scan(
        rows,
        ["rel_dataset"],
        ["createtxg", "__after", "creation", "tag"],
        sums={"__all": F.lit(1), "__inc": F.col("__in_run").cast("int"), "__at": F.col("__sent")},
        totals={"__n": F.col("__sent")},
        lasts={
            "from_name": F.when(F.col("included") | F.col("is_base"), F.col("name")),
            "__joined": F.col("__in_run"),
        },
        bits=bits,
    )
    run = F.col("__all") if force_i else F.col("__all") - F.col("__inc")
    part = F.when(F.coalesce("__joined", F.lit(False)), 1).otherwise(0)
    is_last = F.col("__at") + 1 == F.col("__n")
    steps = scanned.filter("__sent = 1").withColumns({"run": run, "part": part, "is_last": is_last})
    return steps.drop("__all", "__inc", "__at", "__n", "__joined", "__in_run", "__sent", "__after")


def incremental_steps(
    cands: DataFrame, resume: bool = False, force_i: bool = False, bits: int = CHUNK_BITS
) -> DataFrame:
    """The fewest sends that transfer exactly the ``included`` rows of :func:`candidates_since`: ``-I`` for an unbroken
    run of two or more, else ``-i``. A hop from a bookmark, or the first one when resuming, is its own ``-i``;
    ``force_i`` sends every row on its own. Step members are counted and their bytes summed, never collected."""
    rows = _step_rows(cands, resume, force_i, bits)
    position = F.struct("createtxg", "creation", "tag")
    steps = rows.groupBy("rel_dataset", "run", "part").agg(
        F.min(F.struct(position, "from_name"))["from_name"].alias("from_name"),
        F.max(F.struct(position.alias("p"), "name")).alias("to"),
        F.count(F.lit(1)).alias("snapshots"),
        F.sum(F.coalesce("written", F.lit(0))).alias("written"),
    )
    return steps.select(
        "rel_dataset",
        F.when(F.col("snapshots") > 1, "-I").otherwise("-i").alias("flag"),
        "from_name",
        F.col("to.name").alias("to_name"),
        "snapshots",
        "written",
        F.col("to.p.createtxg").alias("to_createtxg"),
    )


def no_stream_steps(cands: DataFrame) -> DataFrame:
    """One hop per dataset from the base to the newest selected row, if any row after the base is selected."""
    later = F.col("included") & ~F.col("is_base") & _is_snapshot()
    best = cands.groupBy("rel_dataset").agg(
        F.max(F.when(F.col("is_base"), F.col("name"))).alias("from_name"),
        F.max(F.when(later, F.struct("createtxg", "creation", "tag", "name", "written"))).alias("to"),
    )
    return best.filter(F.col("to").isNotNull()).select(
        "rel_dataset",
        F.lit("-i").alias("flag"),
        "from_name",
        F.col("to.name").alias("to_name"),
        F.lit(1).cast("bigint").alias("snapshots"),
        F.coalesce("to.written", F.lit(0).cast("bigint")).alias("written"),
        F.col("to.createtxg").alias("to_createtxg"),
    )


def full_sends(actions: DataFrame, no_stream: bool = False) -> DataFrame:
    """What a full copy starts with: the oldest selected snapshot, or the newest without streaming."""
    first = "latest_selected" if no_stream else "oldest_selected"
    return actions.filter(F.col("action") == "full").select("rel_dataset", F.col(first).alias("to_name"))


def step_sizes(steps: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds per dataset the total bytes and snapshots, what earlier steps have already sent, and ``is_last``, all from one
    ordered scan."""
    one = F.lit(1)
    scanned = ordered_scan(
        steps,
        ["rel_dataset"],
        ["to_createtxg", "to_name"],
        sums={"done_bytes": F.col("written"), "done_snapshots": F.col("snapshots"), "__at": one},
        totals={"total_bytes": F.col("written"), "total_snapshots": F.col("snapshots"), "__n": one},
        bits=bits,
    )
    return scanned.withColumn("is_last", F.col("__at") + 1 == F.col("__n")).drop("__at", "__n")


def mark_last_step(steps: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Adds ``is_last`` to steps that do not have it yet."""
    if "is_last" in steps.columns:
        return steps
    one = F.lit(1)
    scanned = ordered_scan(
        steps, ["rel_dataset"], ["to_createtxg", "to_name"], sums={"__at": one}, totals={"__n": one}, bits=bits
    )
    return scanned.withColumn("is_last", F.col("__at") + 1 == F.col("__n")).drop("__at", "__n")


def rows_to_bookmark(
    cands: DataFrame, policy: str, resume: bool = False, force_i: bool = False, bits: int = CHUNK_BITS
) -> DataFrame:
    """Sent rows that get a bookmark: ``all``, ``none``, or those with at least the period ``policy`` (``hourly``) plus
    the last row sent to a dataset."""
    rows = _step_rows(cands, resume, force_i, bits)
    if policy == "none":
        return rows.filter(F.lit(False)).select("rel_dataset", "name", "guid")
    if policy != "all":
        rows = rows.filter((label_millis(F.col("tag")) >= label_millis(F.lit("_" + policy))) | F.col("is_last"))
    return rows.select("rel_dataset", "name", "guid")


def replication_summary(steps: DataFrame, elapsed_nanos: int) -> DataFrame:
    """Snapshots, bytes and rate of everything sent; one row."""
    total = steps.agg(
        F.coalesce(F.sum("snapshots"), F.lit(0).cast("bigint")).alias("snapshots"),
        F.coalesce(F.sum("written"), F.lit(0).cast("bigint")).alias("bytes"),
    )
    elapsed = F.lit(elapsed_nanos).cast("bigint")
    rate = F.bround(F.col("bytes").cast("double") * 1e9 / F.greatest(elapsed, F.lit(1)), 0).cast("bigint")
    return total.select(
        "snapshots",
        "bytes",
        elapsed.alias("elapsed_nanos"),
        rate.alias("bytes_per_second"),
        F.concat(
            F.lit("sent "), F.col("snapshots").cast("string"), F.lit(" snapshots in "), human_duration(elapsed),
            F.lit(", "), human_bytes(F.col("bytes")), F.lit(" ["), human_bytes(rate), F.lit("/s]"),
        ).alias("text"),
    )
