"""Removal of byte strings that occur earlier in the corpus, by sorting suffixes.

Suffixes are sorted where they can have an equal: places are sampled by content (the smallest n-gram hash of a window), and
a place whose n-gram occurs nowhere else has no equal window. Sampled splitters range-partition the places by the hash of that
n-gram, which may lie anywhere in the window and is not in text order; equal cuts are merged, and a bucket sorts the suffixes of its cuts by multikey quicksort on eight bytes at a time:
only suffixes that tie go on to the next eight. Neighbours in that order that tie to the end of the window are equal; all
but the earliest are marked. Equal windows have the same key and a key never crosses a bucket boundary, so nothing is compared
across boundaries; the windows of a key with more cuts than a bucket may hold are compared as rows, by an aggregate.

null and empty texts have no bytes; documents are ordered by doc_id (null first, repeated doc_ids by a hash of the text);
equal rows are documents one behind the other; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm import repeats
from snapcat.llm.shared import stored

WINDOW = 100
GRAM = 32
#: Cuts of one key that a bucket holds.
MOST = 100_000


def equal_windows(cuts: list[bytes], windows: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(cut, offset, group) of windows that have an equal one under the same key; equal windows share the group."""
    lengths = np.array([len(c) for c in cuts])
    data = np.frombuffer(b"".join(cuts) + b"\0" * 8, np.uint8)
    at = np.repeat(np.cumsum(lengths) - lengths, windows)
    cut = np.repeat(np.arange(len(cuts)), windows)
    offset = np.arange(len(cut)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = at + offset
    eight = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    alive = np.arange(len(place))
    group = np.unique(keys, return_inverse=True)[1][cut]
    columns = [*range(0, width - 7, 8)] + ([width - 8] if width % 8 else [])
    for column in columns:
        token = np.ascontiguousarray(eight[place[alive] + column]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((token, group[alive]))
        alive, token = alive[order], token[order]
        fresh = np.r_[True, (group[alive[1:]] != group[alive[:-1]]) | (token[1:] != token[:-1])]
        number = np.cumsum(fresh)
        group[alive] = number
        tied = np.r_[~fresh[1:], False] | ~fresh
        alive = alive[tied]
        if not len(alive):
            break
    return cut[alive], offset[alive], group[alive]


def marked(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): stored texts that share cuts, and (rid, start, stop) of bytes that occur earlier."""
    unit = repeats.Bytes(width, gram)
    texts = repeats.texts_with_runs(docs, unit, "suffix-texts")
    pieces = repeats.cuts(texts, unit)
    different = repeats.distinct_cuts(pieces, "suffix-cuts")
    later = repeats.with_copies(pieces, different).where(
        ~((F.col("rid") == F.col("place.rid")) & (F.col("start") == F.col("place.start")))
    )
    spans = later.select("rid", "start", (F.col("start") + F.col("count") + F.lit(width - 1)).alias("stop"))

    def search(frame):
        import pyarrow as pa

        windows, keys = frame["windows"].to_numpy(), frame["key"].to_numpy()
        rid, start = frame["rid"].to_numpy(), frame["start"].to_numpy()
        cut, offset, group = equal_windows(frame["cut"].tolist(), windows, keys, width)
        rid, at = rid[cut], start[cut] + offset
        order = np.lexsort((at, rid, group))
        group, rid, at = group[order], rid[order], at[order]
        again = np.zeros(len(group), dtype=bool)
        again[1:] = group[1:] == group[:-1]
        rid, at = rid[again], at[again]
        order = np.lexsort((at, rid))
        rid, at = rid[order], at[order]
        head = np.r_[True, (rid[1:] != rid[:-1]) | (at[1:] > at[:-1] + 1)] if len(at) else np.empty(0, dtype=bool)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(at)) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid[first], pa.int64()), pa.array(at[first], pa.int32()), pa.array(at[last] + width, pa.int32())]
            if len(at)
            else [pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())],
            names=["rid", "start", "stop"],
        )

    found, wide = repeats.by_key(different, search, "rid BIGINT, start INT, stop INT", most)
    spans = spans.unionByName(found)
    if not wide.isEmpty():
        rows = wide.select("cut", "place", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i")).select(
            F.substring("cut", F.col("i") + 1, F.lit(width)).alias("w"),
            F.col("place.rid").alias("rid"),
            (F.col("place.start") + F.col("i")).alias("start"),
        )
        firsts = rows.groupBy("w").agg(F.min(F.struct("rid", "start")).alias("f"), F.count(F.lit(1)).alias("n"))
        again = rows.join(firsts.where("n > 1"), "w").where(~(F.struct("rid", "start") == F.col("f")))
        spans = spans.unionByName(again.select("rid", "start", (F.col("start") + width).alias("stop")))
    return texts, spans


def dedup(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most: int = MOST, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; null without ``with_text``) per document."""
    docs = repeats.identified(docs)
    texts, spans = marked(docs, width, gram, most)
    per_doc = stored(spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans")

    def remove(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for rid, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                gone = repeats.covered(
                    np.array([s["start"] for s in found]), np.array([s["stop"] for s in found]), len(data)
                )
                kept = data[~gone].tobytes()
                edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((rid, int(gone.sum()), edges, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["rid", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = "rid BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, kept BINARY"
    changed = stored(texts.select("rid", "text").join(per_doc, "rid").mapInArrow(remove, schema), "suffix-changed")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    plain = docs.select(
        "rid", "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("_sha"),
        *([raw.alias("_raw")] if with_text else []),
    )
    whole = F.col("_raw") if with_text else F.lit(None).cast("binary")
    return plain.join(changed, "rid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        F.when(F.col("n_removed").isNull(), whole).otherwise(F.col("kept")).alias("kept"),
    )
