"""The registered queries of this subpackage and the SQL they must equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapcat.llm import (
    alignment,
    ann,
    bpe,
    centroids,
    ngram_join,
    packing,
    quality,
    sharding,
    substring,
    suffix_dedup,
    token_files,
    toxicity,
    warc,
)
from snapcat.llm.shared import ship, table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return function

    return register


@query("op6_quality_rules", quality.oracle_sql())
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.with_quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op9_packing")
def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, tokenizer, with_ids=False, plain=False).drop("ids")


@query("op7_token_shards")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), plain=False)
    return token_files.read_shards(manifest, with_ids=False).drop("ids")


@query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=False).drop("ids")


@query("op2_warc", warc.oracle_sql())
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    read = warc.read_archives(manifest, with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


@query("op8_posting_lists")
def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op1_label_shards")
def label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


@query("op10_suffix_dedup")
def suffix_dedup_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op5_substring_dedup", substring.oracle_sql())
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).drop("cut")


@query("op3_ngram_join", ngram_join.oracle_sql())
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op12_bisector_tournament", centroids.oracle_sql())
def bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op11_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_documents(documents, table(spark, sf_dir, "labels"))


@query("op13_pair_bitmaps")
def pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    json_path, model_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_documents(documents, json_path, model_path)[0]
