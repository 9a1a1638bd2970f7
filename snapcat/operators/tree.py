"""Operators over the dataset hierarchy.

With ``/`` sorted before everything else a subtree is an interval of paths: it opens at its top and closes behind the last
path below it. Subtrees nest, so a path lies below one of some tops exactly if the farthest close among the tops before it is
still ahead. That is one ordered scan over the paths of a pool, without looking ancestors up; a pool with most paths is cut
into parts like any hot group. What asks about whole subtrees from below explodes paths to their ancestors once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.names import ancestors, relativize, replace_prefix
from snapcat.operators.ordered import CHUNK_BITS, ordered_scan
from snapcat.schema import SNAPSHOT

_POOL, _OPEN, _CLOSE, _MARK, _AHEAD = "__pool", "__open", "__close", "__mark", "__ahead"


def _intervals(df: DataFrame) -> DataFrame:
    """Adds the pool of a dataset and where its subtree opens and closes."""
    path = F.col("dataset")
    opens = F.translate(path, "/", "\x01")
    return df.withColumns(
        {_POOL: F.substring_index(path, "/", 1), _OPEN: opens, _CLOSE: F.concat(opens, F.lit("\x02"))}
    )


def _scanned(rows: DataFrame, tops: Column, order: list[str], bits: int) -> DataFrame:
    """Adds the farthest close among the rows before that ``tops`` picks."""
    return ordered_scan(rows, [_POOL], order, peaks={_AHEAD: F.when(tops, F.col(_CLOSE))}, bits=bits)


def _with_ancestors(datasets: DataFrame) -> DataFrame:
    """Distinct datasets together with everything above them."""
    return datasets.select(F.explode(ancestors(F.col("dataset"))).alias("dataset")).distinct()


def prune_subtrees(df: DataFrame, flagged: DataFrame, keep: bool = False, bits: int = CHUNK_BITS) -> DataFrame:
    """Drops the subtrees of flagged datasets, or keeps only those. Rows without a dataset are in no subtree."""
    marks = flagged.select("dataset").distinct().withColumn(_MARK, F.lit(0))
    both = df.withColumn(_MARK, F.lit(1)).unionByName(marks, allowMissingColumns=True)
    scanned = _scanned(_intervals(both), F.col(_MARK) == 0, [_OPEN, _MARK], bits)
    below = F.coalesce(F.col(_AHEAD) > F.col(_OPEN), F.lit(False))
    return scanned.filter((F.col(_MARK) == 1) & (below if keep else ~below)).select(*df.columns)


def tree_roots(df: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Rows with no proper ancestor among the rows."""
    scanned = _scanned(_intervals(df), F.lit(True), [_OPEN], bits)
    # rows of the same dataset close at the same place, an ancestor behind it
    below = F.coalesce(F.col(_AHEAD) > F.col(_CLOSE), F.lit(False))
    return scanned.filter(~below).select(*df.columns)


def minimal_roots(df: DataFrame) -> DataFrame:
    """The shortest list of datasets whose recursive deletion covers all rows."""
    return tree_roots(df.select("dataset").distinct())


def recursive_roots(selected: DataFrame, basis: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """The roots of ``selected`` if each root's whole basis subtree is selected, otherwise no row."""
    both = selected.select("dataset", F.lit(1).alias(_MARK)).unionByName(basis.select("dataset", F.lit(0).alias(_MARK)))
    names = _intervals(both.groupBy("dataset").agg(F.max(_MARK).alias(_MARK)))
    scanned = _scanned(names, F.col(_MARK) == 1, [_OPEN], bits)
    ahead = F.coalesce(F.col(_AHEAD) > F.col(_OPEN), F.lit(False))
    roots = scanned.filter((F.col(_MARK) == 1) & ~ahead).select("dataset")
    missing = scanned.filter((F.col(_MARK) == 0) & ahead)
    blocked = missing.agg((F.count(F.lit(1)) > 0).alias("blocked"))  # one row
    key = F.lit(0)
    return (
        roots.withColumn("__k", key)
        .join(blocked.filter(~F.col("blocked")).select(key.alias("__k")), "__k", "left_semi")
        .drop("__k")
    )


def _whole_subtrees(basis: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates all of whose basis descendants are candidates."""
    names = candidates.select("dataset").distinct()
    obstacles = basis.select("dataset").join(names, "dataset", "left_anti")
    return names.join(_with_ancestors(obstacles), "dataset", "left_anti")


def deletable_datasets(
    basis: DataFrame, selected: DataFrame, src: DataFrame, src_root: str | None = None, dst_root: str | None = None
) -> DataFrame:
    """Selected destination datasets whose whole subtree is selected and that do not exist on the source."""
    present = src.select("dataset")
    if src_root is not None and dst_root is not None:
        present = present.select(replace_prefix(F.col("dataset"), src_root, dst_root).alias("dataset"))
    return _whole_subtrees(basis, selected).join(present, "dataset", "left_anti")


def orphan_datasets(
    basis: DataFrame, selected: DataFrame, snaps: DataFrame, with_bookmarks: bool = False
) -> DataFrame:
    """Selected datasets without snapshots (or bookmarks) whose whole subtree is selected and empty as well."""
    blocking = snaps.filter(F.lit(True) if with_bookmarks else F.col("kind") == SNAPSHOT).select("dataset").distinct()
    return _whole_subtrees(basis, selected.select("dataset").join(blocking, "dataset", "left_anti"))


def missing_ancestors(df: DataFrame, dst: DataFrame) -> DataFrame:
    """Proper ancestors of the datasets that do not exist yet on the destination."""
    above = df.select(F.explode(ancestors(F.col("dataset"), proper=True)).alias("dataset")).distinct()
    return above.join(dst.select("dataset"), "dataset", "left_anti")


def complete_tree(df: DataFrame) -> DataFrame:
    """The datasets plus every missing parent."""
    return _with_ancestors(df)


def relative(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn("rel_dataset", relativize(F.col("dataset"), root))

