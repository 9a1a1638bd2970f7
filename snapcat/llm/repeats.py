"""Places where texts may repeat each other: shared ground of the two operators that look for repeated windows.

A window's key is the smallest hash of its n-grams, so equal windows have equal keys wherever they are, and windows that
follow each other mostly share one. Runs of windows are the rows that move: a key that occurs once in the whole corpus cannot
belong to a repeated window, and its run goes no further. What is left is cut from the texts, and equal cuts are counted
before they meet (a group of copies is one row per task), so no group of copies gathers anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm import rolling
from snapcat.llm.shared import look_up, numbered, stored


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """An Arrow array of slices of data."""
    import pyarrow as pa

    lengths = ends - starts
    bounds = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=bounds[1:])
    if bounds[-1] < 1 << 31:  # slices overlap, so they are more than the data
        raw = memoryview(np.ascontiguousarray(data))
        joined = b"".join([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined)])
    raise ValueError("cuts of one text above 2 GB")


class Bytes:
    """Windows of bytes."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        return rolling.runs(data, offsets, self.gram, self.window)

    def cuts(self, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        """An Arrow array of the cuts of texts that lie one behind the other; each names its text and first window."""
        first = offsets[text] + starts
        return slices(data, first, first + counts + self.window - 1)


class Words:
    """Windows of words; a cut is its words with one space between."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        first, last, doc = rolling.words(data, offsets)
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        return rolling.runs(rolling.Sums(data).of(first, last), bounds, self.gram, self.window)

    def cuts(self, data: np.ndarray, offsets: np.ndarray, text: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        """As of bytes, after a copy of the texts whose words have one space behind each."""
        first, last, doc = rolling.words(data, offsets)
        at, end = np.zeros(len(first), dtype=np.int64), np.cumsum(last - first + 1)
        at[1:] = end[:-1]
        spaced = np.full(int(end[-1]) if len(end) else 0, 32, dtype=np.uint8)
        inside = np.ones(len(spaced), dtype=bool)
        inside[end - 1] = False
        here = np.zeros(len(data) + 1, dtype=np.int8)
        here[first] += 1
        here[last] -= 1  # a word may end where the next text's first begins
        spaced[inside] = data[np.cumsum(here[:-1]) > 0]
        word = np.searchsorted(doc, text) + starts
        return slices(spaced, at[word], end[word + counts + self.window - 2] - 1)


Unit = Bytes | Words


def identified(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text, row): rid is unique and grows with doc_id; row is the whole input row.

    It is doc_id itself where that is unique; only rows with null or repeated doc_ids are numbered, nulls first, then by a
    hash of the text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), row)
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if twice.isEmpty():
        return docs.withColumn("rid", F.col("doc_id"))
    docs = docs.withColumn("_g", F.lit(0)).withColumn("_h", F.xxhash64("text"))
    return numbered(docs, "_g", "doc_id", "_h", into="rid", name="numbered-docs").drop("_g", "_h")


def shared_runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """Runs whose key another run has too: (rid, start, count, key).

    Runs are range-partitioned by (key, rid), so a frequent key spreads over partitions; a task compares neighbours. The
    first and last key of a partition may go on next door, and are kept unseen: a run too many does no harm.
    """

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            rids = batch.column(0)
            for at, data, offsets in rolling.text_blocks(batch, 1):
                doc, start, count, key = unit.runs(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        rids.take(pa.array(at + doc)),
                        pa.array(start, pa.int32()),
                        pa.array(count, pa.int32()),
                        pa.array(key, pa.int64()),
                    ],
                    names=["rid", "start", "count", "key"],
                )

    def repeated(batches):
        import pyarrow as pa

        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                table = pa.Table.from_batches([held, batch]).combine_chunks()
                batch = table.to_batches()[0]
            keys = batch.column(3).to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.r_[before is None or keys[0] == before, same]
            keep[:-1] |= same
            held, before = batch.slice(batch.num_rows - 1), keys[-2] if len(keys) > 1 else before
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        if held is not None:
            yield held

    schema = "rid BIGINT, start INT, count INT, key BIGINT"
    runs = docs.select("rid", "text").mapInArrow(find, schema)
    ranged = runs.repartitionByRange("key", "rid", "start").sortWithinPartitions("key", "rid", "start")
    return ranged.mapInArrow(repeated, schema)


def texts_with_runs(docs: DataFrame, unit: Unit, name: str) -> DataFrame:
    """Stored (rid, text, runs) of the documents that have shared runs."""
    runs = shared_runs(docs, unit).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "count", "key"))).alias("runs"))
    return stored(docs.select("rid", "text").join(runs, "rid"), name)


def cuts(texts: DataFrame, unit: Unit) -> DataFrame:
    """(name, key, rid, start, count, cut) of every shared run; ``name`` is the same for equal cuts only."""

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            rids = batch.column(0)
            for at, data, offsets in rolling.text_blocks(batch, 1):
                runs = batch.column(2).slice(at, len(offsets) - 1)
                found, number = runs.flatten(), pc.list_value_length(runs).to_numpy()
                start, count = found.field(0), found.field(1)
                begins, counts = start.to_numpy(), count.to_numpy()
                text = np.repeat(np.arange(len(offsets) - 1), number)
                yield pa.RecordBatch.from_arrays(
                    [found.field(2), rids.take(pa.array(at + text)), start, count, unit.cuts(data, offsets, text, begins, counts)],
                    names=["key", "rid", "start", "count", "cut"],
                )

    rows = texts.select("rid", "text", "runs").mapInArrow(cut, "key BIGINT, rid BIGINT, start INT, count INT, cut BINARY")
    whole = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return rows.withColumn("name", F.concat(whole(F.col("key")), whole(F.xxhash64("cut")))).select(
        "name", "key", "rid", "start", "count", "cut"
    )


def distinct_cuts(pieces: DataFrame, name: str) -> DataFrame:
    """Stored, a row per different cut: name, key, cut, windows, _count and the first place (rid, start) where it occurs."""
    grouped = pieces.groupBy("name").agg(
        F.first("key").alias("key"),
        F.first("cut").alias("cut"),
        F.first("count").alias("windows"),
        F.count(F.lit(1)).alias("_count"),
        F.min(F.struct("rid", "start")).alias("place"),
    )
    return stored(grouped, name)


def with_copies(pieces: DataFrame, different: DataFrame) -> DataFrame:
    """The places of cuts that occur more than once: rid, start, count, _count, place (the first)."""
    copied = different.where("_count > 1").select("name", "_count", "place")
    total = int(copied.agg(F.sum("_count")).first()[0] or 0)
    found = look_up(pieces.drop("cut", "key"), copied, "name", F.xxhash64("rid", "start"), max(1000, total // 1000), False)
    return found.where(F.col("_count").isNotNull())


def by_key(different: DataFrame, search: Callable, schema: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Runs ``search`` on blocks of cuts in which every key is whole: (found rows, cuts of keys with more than ``most`` cuts).

    ``search`` takes a pandas frame with key, cut, windows, _count, rid, start and yields Arrow batches. Keys too frequent
    for a block (at most cuts / ``most`` of them) are left to the caller's other exact way.
    """
    frequent = different.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key")
    frequent = stored(frequent, "frequent-keys")
    rest = different.join(F.broadcast(frequent), "key", "left_anti")
    wide = different.join(F.broadcast(frequent), "key", "left_semi")
    rows = rest.select("key", "cut", "windows", "_count", "place.rid", "place.start")

    def blocks(batches):
        import pandas as pd

        waiting, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.to_pandas()
            waiting.append(frame)
            size += int(frame["windows"].sum())
            if size >= 1 << 18:
                frame = pd.concat(waiting) if len(waiting) > 1 else frame
                last = frame["key"].iloc[-1]
                whole = frame[frame["key"] != last]
                if len(whole):
                    yield from search(whole)
                waiting = [frame[frame["key"] == last]]
                size = int(waiting[0]["windows"].sum())
        if waiting:
            yield from search(pd.concat(waiting))

    ranged = rows.repartitionByRange("key").sortWithinPartitions("key")
    return ranged.mapInArrow(blocks, schema), wide


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Mask of what intervals cover."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
