"""Promotion and clean-up of temporary bookmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.hashing import compact_guid, sha_key
from snapcat.functions.names import final_bookmark_name
from snapcat.schema import BOOKMARK, SNAPSHOT, TMP_BOOKMARK, TMP_PREFIX


def destination_suffix(pool_guid: str, dst_dataset: str) -> Column:
    """What the name of a temporary bookmark ends in if it belongs to this destination."""
    digest = F.translate(F.substring(sha_key(F.lit(dst_dataset)), 1, 11), "_", ":")
    return F.concat(F.lit("."), compact_guid(F.lit(pool_guid)), F.lit("."), digest)


def tmp_bookmark_name(
    dataset: Column, tag: Column, guid: Column, suffix: Column, tmp_prefix: str = TMP_PREFIX
) -> Column:
    return F.concat(dataset, F.lit("#" + tmp_prefix), tag, F.lit("."), compact_guid(guid), suffix)


def bookmark_plan(
    bookmarks: DataFrame, dst: DataFrame, suffix: Column | None = None, tmp_prefix: str = TMP_PREFIX
) -> DataFrame:
    """``action, rel_dataset, from_name, to_name``: a temporary bookmark is promoted if its guid arrived on the
    destination and no final bookmark of that name and guid exists; every temporary one is deleted afterwards.
    ``suffix`` restricts it to the bookmarks of one destination."""
    tmp = bookmarks.filter(F.col("kind") == TMP_BOOKMARK)
    if suffix is not None:
        tmp = tmp.filter(F.endswith("name", suffix))
    tmp = tmp.select("rel_dataset", "guid", "name", final_bookmark_name(F.col("name"), tmp_prefix).alias("final"))
    arrived = dst.filter(F.col("kind") == SNAPSHOT).select("rel_dataset", "guid").distinct()
    final = bookmarks.filter(F.col("kind") == BOOKMARK).select("rel_dataset", "guid", F.col("name").alias("final"))
    promote = tmp.join(arrived, ["rel_dataset", "guid"], "left_semi").join(
        final, ["rel_dataset", "guid", "final"], "left_anti"
    )
    return promote.select(
        F.lit("promote").alias("action"), "rel_dataset", F.col("name").alias("from_name"), F.col("final").alias("to_name")
    ).unionByName(
        tmp.select(
            F.lit("delete").alias("action"),
            "rel_dataset",
            F.col("name").alias("from_name"),
            F.lit(None).cast("string").alias("to_name"),
        )
    )
