"""Token-id shards in ascending doc_id order, compressed by Re-Pair grammars.

Documents are range-partitioned and sorted by (doc_id, hash of the text); a task encodes its documents in order and cuts
them into shards of about ``shard_ids`` ids, each with a grammar of its own (see :mod:`snapcat.llm.repair`). Files get names
of their own per attempt, and only those in the committed manifest count, so retried or doubled tasks leave no trace in the
result. Starts are sums of the manifest: per partition, then over the partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapcat.llm import files, repair
from snapcat.llm.shared import shared_folder, stored
from snapcat.llm.tokens import encoder, slices

SHARD_IDS = 1 << 20
#: Fewest occurrences of a pair that pay for its rule: a rule takes two symbols and its expansion length, about as many bits.
LEAST = 3

MANIFEST = "part INT, shard INT, path STRING, doc_ids ARRAY<BIGINT>, n_ids BIGINT"


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    folder: str | None = None,
    shard_ids: int = SHARD_IDS,
    least: int = LEAST,
    plain: bool = True,
) -> DataFrame:
    """Writes the shards; returns the manifest: part, shard, path, doc_ids in file order, n_ids, start (ids before it).

    A document's ids are those of its text (null: none) and id 0. Null doc_ids come first; repeated rows are all written, in
    the order of a hash of their text. An empty table gives an empty manifest. ``plain``: special tokens in a text are
    encoded as text (see :class:`snapcat.llm.tokens.Encoder`); the query leaves them tokens.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-shards")
    files.ensure_folder(folder)

    def write(batches):
        import pyarrow as pa

        codec, part, shard = encoder(tokenizer, plain), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[bytes] = []
        size = 0

        def flush():
            nonlocal shard, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.array([len(p) // 4 for p in parts])
            path = files.fresh_name(folder, f"part-{part:06d}-{shard:06d}", ".ids")
            files.write_bytes(path, repair.to_bytes(ids, lengths, codec.vocab_size, least))
            row = [[part], [shard], [path], [list(doc_ids)], [len(ids)]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.int64()]
            shard, size = shard + 1, 0
            doc_ids.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "shard", "path", "doc_ids", "n_ids"]
            )

        for batch in batches:
            for keys, texts in slices(batch, ("doc_id", "text"), 1024):
                for key, ids in zip(keys, codec.encode(texts), strict=True):
                    doc_ids.append(key)
                    parts.append(ids + b"\0\0\0\0")
                    size += len(ids) // 4 + 1
                    if size >= shard_ids:
                        yield flush()
        if parts:
            yield flush()

    order = ["doc_id", "_h"]
    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .withColumn("_h", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    manifest = stored(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-manifest")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return shards.join(parts, "part").withColumn("start", F.col("_before") + F.col("_inside")).drop("_before", "_inside")


READ = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT, ids BINARY"


def read_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Decodes the shards of a manifest: doc_id, start, n_tokens, ids_crc32, ids (null without ``with_ids``) per document."""

    def read(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        for batch in batches:
            for paths, all_ids, starts in slices(batch, ("path", "doc_ids", "start"), 1):
                shard, start, rows = repair.Shard(files.read_bytes(paths[0])), starts[0], []
                for doc_id, ids in zip(all_ids[0], shard.documents(), strict=True):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw if with_ids else None))
                    start += len(ids)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    spark = manifest.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return manifest.select("path", "doc_ids", "start").repartition(spread).mapInArrow(read, READ)


def read_ids(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Random access: for rows (path, skip, length) of ``wanted`` their ids as bytes, decoding only the symbols they touch."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for paths, skips, lengths in slices(batch, ("path", "skip", "length"), 64):
                out = []
                for path, skip, length in zip(paths, skips, lengths, strict=True):
                    out.append(repair.Shard(files.read_bytes(path)).read(skip, length).astype("<u4").tobytes())
                arrays = [pa.array(paths), pa.array(skips, pa.int64()), pa.array(lengths, pa.int64()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "skip", "length", "ids"])

    return wanted.join(manifest.select("path"), "path", "left_semi").select("path", "skip", "length").mapInArrow(
        read, "path STRING, skip BIGINT, length BIGINT, ids BINARY"
    )
