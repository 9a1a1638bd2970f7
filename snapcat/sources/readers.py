"""Readers of listings and logs. Parquet with the layouts of :mod:`snapcat.schema` is the native format; these load the
text forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.functions.names import is_held, kind, relativize, split_name
from snapcat.schema import PROPERTIES, TMP_PREFIX


BROKEN = "__broken"


def _tsv(spark: SparkSession, path: str | list[str], schema: str, required: str, optional: int = 0) -> DataFrame:
    """Rows with the whole line in ``BROKEN`` where it does not fit the schema or has no ``required`` column.

    The last ``optional`` columns may be missing."""
    rows = spark.read.csv(
        path, schema=f"{schema}, {BROKEN} STRING", sep="\t", quote="", escape="", nullValue="-", enforceSchema=True,
        mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN,
    )
    if not optional:
        lacking = F.col(BROKEN).isNotNull()
    else:  # a line that only lacks the optional columns counts as broken for the reader as well
        columns = len(rows.columns) - 1
        fields = F.size(F.split(BROKEN, "\t"))
        numbers = [f.name for f in rows.schema.fields[:-1] if f.dataType.typeName() == "long"]
        parts = {f.name: F.get(F.split(BROKEN, "\t"), F.lit(i)) for i, f in enumerate(rows.schema.fields[:-1])}
        unread = F.lit(False)
        for name in numbers:
            unread = unread | (F.col(name).isNull() & (parts[name] != "-"))
        lacking = F.col(BROKEN).isNotNull() & (unread | ~fields.between(columns - optional, columns))
    line = F.coalesce(BROKEN, F.to_csv(F.struct(*rows.columns[:-1]), {"sep": "\t", "nullValue": "-"}))
    return rows.withColumn(BROKEN, F.when(lacking | F.col(required).isNull(), line))


def _sound(rows: DataFrame, rejects: bool) -> DataFrame:
    """Without ``rejects`` a broken line is an error; with it the result is the broken lines, column ``line``."""
    if rejects:
        return rows.filter(F.col(BROKEN).isNotNull()).select(F.col(BROKEN).alias("line"))
    problem = F.raise_error(F.concat(F.lit("malformed line: "), F.col(BROKEN))).cast("boolean")
    return rows.filter(F.when(F.col(BROKEN).isNotNull(), problem).otherwise(F.lit(True))).drop(BROKEN)


def with_name_columns(df: DataFrame, side: str, root: str, tmp_prefix: str = TMP_PREFIX) -> DataFrame:
    """Adds everything that follows from ``name``, and the held flag from ``userrefs``."""
    parts = split_name(F.col("name"))
    return df.select(
        F.lit(side).alias("side"),
        F.lit(root).alias("root"),
        parts["dataset"].alias("dataset"),
        relativize(parts["dataset"], root).alias("rel_dataset"),
        kind(F.col("name"), tmp_prefix).alias("kind"),
        parts["tag"].alias("tag"),
        "name",
        "guid",
        "creation",
        "createtxg",
        "written",
        is_held(F.col("userrefs")).alias("held"),
    )


def read_snapshots(
    spark: SparkSession,
    path: str | list[str],
    side: str,
    root: str,
    tmp_prefix: str = TMP_PREFIX,
    rejects: bool = False,
) -> DataFrame:
    """Tab-separated ``creation guid createtxg written name [userrefs]``; ``-`` is null. A line of another form is an
    error; ``rejects`` reads those lines instead."""
    schema = "creation BIGINT, guid STRING, createtxg BIGINT, written BIGINT, name STRING, userrefs STRING"
    rows = _sound(_tsv(spark, path, schema, "name", optional=1), rejects)
    return rows if rejects else with_name_columns(rows, side, root, tmp_prefix)


def read_datasets(spark: SparkSession, path: str | list[str], side: str, root: str) -> DataFrame:
    """Tab-separated ``snapshots_changed volblocksize recordsize name``. A volume has no record size and shows its
    block size as a negative one."""
    schema = "snapshots_changed BIGINT, volblocksize BIGINT, recordsize BIGINT, dataset STRING"
    size = F.coalesce("recordsize", -F.col("volblocksize"))
    return _sound(_tsv(spark, path, schema, "dataset"), False).select(
        F.lit(side).alias("side"),
        F.lit(root).alias("root"),
        "dataset",
        relativize(F.col("dataset"), root).alias("rel_dataset"),
        (size < 0).alias("is_volume"),
        size.alias("recordsize"),
        F.coalesce("snapshots_changed", F.lit(0).cast("bigint")).alias("snapshots_changed"),
    )


def read_root_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``src_root<TAB>dst_root`` per line; comment and blank lines are skipped, a blank side is an error."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    parts = F.split("value", "\t", 2)
    src, dst = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    broken = dst.isNull() | (F.trim(src) == "") | (F.trim(dst) == "")
    problem = F.raise_error(F.concat(F.lit("expected two tab-separated datasets: "), F.col("value"))).cast("boolean")
    # in a filter, which no choice of columns takes away
    return lines.filter(F.when(broken, problem).otherwise(F.lit(True))).select(src.alias("src_root"), dst.alias("dst_root"))


def read_properties(spark: SparkSession, path: str | list[str], sources: Sequence[str] = ()) -> DataFrame:
    """Tab-separated ``dataset property value source``, restricted to the given sources (all without any)."""
    rows = spark.read.csv(path, schema=PROPERTIES, sep="\t", quote="", escape="")
    return rows.filter(F.col("source").isin(*sources)) if sources else rows


def read_transfer_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, updates array<string>, line``: one row per transfer of a log and its sibling files ``path_<digits>...``.

    A final status line ends in a newline, intermediate ones in a carriage return. Lines are split at newlines, which
    keeps large files splittable; the last update of a row is the final line, or the newest intermediate one if the
    transfer is still running."""
    rows = spark.read.option("lineSep", "\n").text(path + "{,_[0-9]*}")
    updates = F.filter(F.split("value", "\r"), lambda u: u != "")
    return (
        rows.select(F.col("_metadata.file_path").alias("file"), updates.alias("updates"))
        .filter(F.size("updates") > 0)
        .withColumn("line", F.element_at("updates", -1))
    )


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, seq, line, terminator``: one row per update of a log and its sibling files ``path_<digits>...``.

    Lines are split at carriage returns, which end all updates but the last of a transfer, so even a file with a single
    transfer is read by many tasks and no row is longer than an update and the final lines before it. ``seq`` orders the
    lines of a file; an update is set against the one before it by :func:`snapcat.operators.logs.bytes_delta`, also across
    the borders of tasks."""
    rows = spark.read.option("lineSep", "\r").text(path + "{,_[0-9]*}")
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.split("value", "\n", -1).alias("parts"),
    ).drop("value")
    others = [c for c in placed.columns if c not in ("file", "block", "at", "parts")]
    lines = placed.select(*others, "file", "block", "at", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "line"))
    ended = F.when(F.col("pos") + 1 < F.col("n"), "\n").otherwise("\r")
    return lines.filter(F.col("line") != "").select(
        *others, "file", F.struct("block", "at", "pos").alias("seq"), "line", ended.alias("terminator")
    )
