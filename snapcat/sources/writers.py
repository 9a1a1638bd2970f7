"""Sinks. The output committer publishes files when the job succeeds, so readers never see half a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.operators.compare import comparison_columns
from snapcat.schema import COMPARISON_ORDER


def _write_tsv(df: DataFrame, path: str, mode: str) -> None:
    df.write.mode(mode).csv(path, sep="\t", header=True, nullValue="-", emptyValue="", quote="", escape="")


def write_comparison(cmp: DataFrame, path: str, mode: str = "error") -> None:
    """Header and ten columns, sorted by rel_dataset, creation, createtxg and tag across the part files. The range
    covers the whole order, so a large dataset is spread over several files."""
    order = ["rel_dataset", *COMPARISON_ORDER]
    ranged = cmp.repartitionByRange(*order).sortWithinPartitions(*order)
    _write_tsv(comparison_columns(ranged), path, mode)


def write_dataset_map(df: DataFrame, path: str, mode: str = "error") -> None:
    """``location rel_dataset src_dataset dst_dataset`` sorted by rel_dataset."""
    ranged = df.repartitionByRange(F.col("rel_dataset")).sortWithinPartitions("rel_dataset")
    _write_tsv(ranged.select("location", "rel_dataset", "src_dataset", "dst_dataset"), path, mode)
