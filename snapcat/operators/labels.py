"""Series labels: which tag belongs to which (prefix, infix, suffix), and the newest and oldest row per series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.functions.names import YEAR_PATTERN, label_matches
from snapcat.operators.ordered import CHUNK_BITS, salted_join
from snapcat.schema import SNAPSHOT

LABEL = ("prefix", "infix", "suffix")


@dataclass(frozen=True, order=True)
class Label:
    prefix: str
    infix: str = ""
    suffix: str = ""

    @classmethod
    def of(cls, org: str, target: str, period: str) -> Label:
        label = cls(org + "_", target + "_" if target else "", "_" + period if period else "")
        for part in (org, target, period):
            if "_" in part or "/" in part:
                raise ValueError(f"no underscore or slash within a label part: {part!r}")
        return label

    def __str__(self) -> str:
        return f"{self.prefix}{self.infix}<timestamp>{self.suffix}"


def literal_rows(rows: Sequence[Mapping[str, object]], types: Mapping[str, str]) -> Column:
    """Configuration rows as an array-of-struct literal; exploding it adds no join and no scan."""
    structs = [F.struct(*[F.lit(row[c]).cast(t).alias(c) for c, t in types.items()]) for row in rows]
    fields = ", ".join(f"{c}: {t}" for c, t in types.items())
    return F.array(*structs).cast(f"array<struct<{fields}>>")


def literal_frame(
    spark: SparkSession, rows: Sequence[Mapping[str, object]], types: Mapping[str, str]
) -> DataFrame:
    """Configuration rows as a DataFrame whose size Spark can estimate, so it may choose a broadcast by itself."""
    return spark.range(1, numPartitions=1).select(F.inline(literal_rows(rows, types)))


LABEL_TYPES = {"prefix": "string", "infix": "string", "suffix": "string"}


def label_frame(spark: SparkSession, labels: Sequence[Label]) -> DataFrame:
    return literal_frame(spark, [asdict(label) for label in dict.fromkeys(labels)], LABEL_TYPES)


def match_labels(df: DataFrame, labels: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """Rows joined with every label their tag belongs to; all columns of both sides.

    A prefix and an infix end in their only underscore, so a tag can start with at most two label heads: up to its
    first underscore (label without infix, and a year follows) or up to its second. That makes it an equi-join on
    the head instead of a nested loop over all labels. There are few heads, so some are hot: their rows are dealt in parts."""
    tag = F.col("tag")
    one = F.concat(F.substring_index(tag, "_", 1), F.lit("_"))
    two = F.concat(F.substring_index(tag, "_", 2), F.lit("_"))
    year_follows = tag.substr(F.length(one) + 1, F.lit(4)).rlike(rf"\A{YEAR_PATTERN}\z")
    heads = F.array_compact(F.array(F.when(year_follows, one), two))
    rows = df.withColumn("__head", F.explode(heads))
    keyed = labels.withColumn("__head", F.concat("prefix", "infix"))
    matches = label_matches(tag, F.col("prefix"), F.col("infix"), F.col("suffix"))
    spread = [c for c in ("dataset", "tag", "guid") if c in df.columns]
    return salted_join(rows, keyed, ["__head"], "inner", spread, bits=bits).filter(matches).drop("__head")


def minmax_by_label(
    snaps: DataFrame,
    datasets: DataFrame,
    labels: Sequence[Label],
    skip_holds: bool | Sequence[bool] = False,
    free: bool = False,
) -> DataFrame:
    """Newest and oldest snapshot per (dataset, label), ordered by (createtxg, creation, tag): creation and tag, 0 and
    '' where there is none, also for datasets without any snapshot. ``skip_holds`` (per label) ignores held rows when
    looking for the oldest. ``free`` adds the oldest row that is not held as ``oldest_free_creation`` and
    ``oldest_free_tag``, so that each alert can apply its own rule."""
    labels = list(dict.fromkeys(labels))
    flags = [skip_holds] * len(labels) if isinstance(skip_holds, bool) else list(skip_holds)
    types = {**LABEL_TYPES, "skip_holds": "boolean"}
    rows = [{**asdict(label), "skip_holds": flag} for label, flag in zip(labels, flags, strict=True)]
    matched = match_labels(
        snaps.filter(F.col("kind") == SNAPSHOT).select("dataset", "tag", "createtxg", "creation", "held"),
        literal_frame(snaps.sparkSession, rows, types),
    )
    position = F.struct("createtxg", "creation", "tag")
    found = matched.groupBy("dataset", *LABEL).agg(
        F.max(position).alias("latest"),
        F.min(F.when(~(F.col("skip_holds") & F.col("held")), position)).alias("oldest"),
        F.min(F.when(~F.coalesce("held", F.lit(False)), position)).alias("oldest_free"),
    )
    # every dataset is checked against every configured label: an exploded literal, not a join
    grid = datasets.select("dataset").distinct().select("dataset", F.inline(literal_rows(rows, types)))
    joined = grid.drop("skip_holds").join(found, ["dataset", *LABEL], "left")
    kinds = ("latest", "oldest", "oldest_free") if free else ("latest", "oldest")
    return joined.select("dataset", *LABEL, *minmax_columns(kinds))


def minmax_columns(kinds: Sequence[str]) -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [
        column
        for kind in kinds
        for column in (
            F.coalesce(F.col(f"{kind}.creation"), zero).alias(f"{kind}_creation"),
            F.coalesce(F.col(f"{kind}.tag"), F.lit("")).alias(f"{kind}_tag"),
        )
    ]


def without_snapshots(datasets: DataFrame, snaps: DataFrame) -> DataFrame:
    """Datasets that have no snapshot at all."""
    present = snaps.filter(F.col("kind") == SNAPSHOT).select("dataset").distinct()
    return datasets.join(present, "dataset", "left_anti")
