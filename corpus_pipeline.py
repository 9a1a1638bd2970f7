"""A corpus pipeline of the operators in ``snapcat.llm``: documents in, packed sequences out.

Each stage takes the documents that the one before it kept, written to the shared folder, and returns documents again; the
last returns the pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snapcat.llm import ngram_join, packing, quality, substring
from snapcat.llm.shared import ship, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold the quality rules, whole."""
    return quality.reject(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8: the smallest doc_id."""
    ship(spark)
    return ngram_join.representatives(docs, k=5, percent=80)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows of 35 words that occur elsewhere too."""
    ship(spark)
    return substring.cut_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), plain=False)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("passages", passages_stage),
    ("packing", packing_stage),
]

#: Tokens and packing cannot be expressed in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
