"""Deletion plans. Nothing is deleted: a plan is the table of rows that would be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.operators.filters import Filter, select_snapshots
from snapcat.operators.ordered import CHUNK_BITS, anti, semi, top_k
from snapcat.plans.policy import Plan, select_by_plan
from snapcat.schema import BOOKMARK, SNAPSHOT, TMP_BOOKMARK

KEY = ["rel_dataset", "guid"]


def _candidates(dst: DataFrame, kind: str, tmp: bool) -> DataFrame:
    if kind == BOOKMARK:
        return dst.filter(F.col("kind") == (TMP_BOOKMARK if tmp else BOOKMARK))
    return dst.filter(F.col("kind") == SNAPSHOT)


def crosscheck_rows(src: DataFrame, kind: str = SNAPSHOT, crosscheck: bool = True) -> DataFrame:
    """Source rows that protect a destination row with the same guid: snapshots and bookmarks, or only the kind that
    is deleted if the cross-check is off."""
    if crosscheck:
        return src
    return src.filter((F.col("kind") == SNAPSHOT) if kind == SNAPSHOT else (F.col("kind") != SNAPSHOT))


def plan_deletes(
    dst: DataFrame,
    src: DataFrame | None,
    groups: Sequence[Sequence[Filter]],
    crosscheck: bool = True,
    kind: str = SNAPSHOT,
    tmp: bool = False,
    all_except: bool = False,
    now: float | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Destination rows the filters choose whose guid is not on the source and that are not held.

    ``kind='bookmark'`` plans bookmarks instead (temporary ones only with ``tmp``): they rank and age like snapshots
    and cannot be held. ``all_except`` chooses what the filters do not. ``src`` None: nothing is protected."""
    basis = _candidates(dst, kind, tmp)
    # the pipeline treats rows of kind snapshot as the ones to judge
    judged = basis.withColumn("__kind", F.col("kind")).withColumn("kind", F.lit(SNAPSHOT))
    chosen = select_snapshots(judged, groups, all_except=all_except, now=now, bits=bits)
    chosen = chosen.withColumn("kind", F.col("__kind")).drop("__kind")
    if src is not None:
        chosen = anti(chosen, crosscheck_rows(src, kind, crosscheck), KEY)
    return chosen.filter(~F.col("held")) if kind == SNAPSHOT else chosen


def plan_deletes_except(
    dst: DataFrame,
    src: DataFrame | None,
    plan: Plan,
    now: int,
    crosscheck: bool = True,
    kind: str = SNAPSHOT,
    tmp: bool = False,
) -> DataFrame:
    """Deletes everything but what the plan keeps; with a source, kept rows must also exist there. An empty plan would
    delete everything and is refused."""
    if not any(periods for targets in plan.values() for periods in targets.values()):
        raise ValueError("refusing to plan the deletion of everything: the plan keeps nothing")
    basis = _candidates(dst, kind, tmp)
    keep = select_by_plan(basis.withColumn("kind", F.lit(SNAPSHOT)), plan, now).select("rel_dataset", "guid", "name")
    if src is None:
        doomed = anti(basis, keep, ["rel_dataset", "name"])
    else:
        doomed = anti(basis, semi(keep, crosscheck_rows(src, kind, crosscheck), KEY), KEY)
    return doomed.filter(~F.col("held")) if kind == SNAPSHOT else doomed


def prune_by_age(df: DataFrame, days: int, keep: int, now: int) -> DataFrame:
    """Rows at least ``days`` old except that the newest ``keep`` of each dataset always stay.

    Old rows come first in creation order, so "at most n - keep of the oldest" is the same as "not among the newest
    ``keep``": a bounded top-k instead of ranking whole series."""
    if keep <= 0:
        raise ValueError("the minimum to retain must be positive")
    newest = top_k(df.select("dataset", "name", "creation"), ["dataset"], [F.desc("creation"), F.desc("name")], keep)
    return anti(df.filter(F.col("creation") <= now - days * 86400), newest, ["dataset", "name"])


def beyond_minimum(df: DataFrame, keep: int) -> DataFrame:
    """Rows other than the newest ``keep`` of each dataset."""
    newest = top_k(df.select("dataset", "name", "creation"), ["dataset"], [F.desc("creation"), F.desc("name")], keep)
    return anti(df, newest, ["dataset", "name"])


def delete_summary(basis: DataFrame, doomed: DataFrame) -> DataFrame:
    """Found and deleted rows per dataset."""
    found = basis.groupBy("dataset").agg(F.count(F.lit(1)).alias("found"))
    deleted = doomed.groupBy("dataset").agg(F.count(F.lit(1)).alias("deleted"))
    return found.join(deleted, "dataset", "left").select(
        "dataset", "found", F.coalesce("deleted", F.lit(0).cast("bigint")).alias("deleted")
    )


