"""Removal of word windows that occur more than once, by FM-indexes of shards and matching statistics.

Texts are cut where a window can have an equal one (see :mod:`snapcat.llm.repeats`); shards are ranges of the cuts' keys, so
equal windows are in one shard. A shard's different cuts go into a compressed FM-index over word numbers, a wavelet matrix
of bit vectors with counts, and each of them is streamed against it: backward search gives how far the words before a place
occur a second time, and what reaches the window's length is reported. Cuts with copies need no search. Keys with more cuts
than a shard may hold are compared as rows of windows, by an aggregate.

null and empty texts have no words; rows that repeat a doc_id are documents of their own; an empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm import fm_index, repeats
from snapcat.llm.shared import stored

WINDOW = 35
GRAM = 12
BLANK = r"[\x09-\x0D\x20]"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Cuts of one key that a shard holds.
MOST = 100_000


def search_shard(cuts: list[bytes], counts: np.ndarray, width: int) -> np.ndarray:
    """(cut, first word, last word + 1) of runs of windows that occur twice or more in the shard, as rows."""
    numbers: dict[bytes, int] = {}
    parts = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in c.split(b" ")], dtype=np.int64) for c in cuts]
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths)
    words = np.concatenate(parts)
    index = fm_index.Index(words, ends)
    once = counts == 1
    found = fm_index.repeated_windows(index, words, (ends - lengths)[once], ends[once], width)
    at = np.flatnonzero(found)
    cut = np.searchsorted(ends, at, side="right")
    place = at - (ends - lengths)[cut]
    head = np.r_[True, (cut[1:] != cut[:-1]) | (place[1:] != place[:-1] + 1)] if len(at) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(at)) - 1
    return np.c_[cut[first], place[first], place[last] + width] if len(at) else np.empty((0, 3), dtype=np.int64)


def marked(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): stored texts that share cuts, and (rid, start, stop) of words in windows that occur elsewhere."""
    unit = repeats.Words(width, gram)
    texts = repeats.texts_with_runs(docs, unit, "window-texts")
    pieces = repeats.cuts(texts, unit)
    different = repeats.distinct_cuts(pieces, "window-cuts")
    copies = repeats.with_copies(pieces, different)
    spans = copies.select("rid", "start", (F.col("start") + F.col("count") + F.lit(width - 1)).alias("stop"))

    def search(frame):
        import pyarrow as pa

        rows = search_shard(frame["cut"].tolist(), frame["_count"].to_numpy(), width)
        rid, start = frame["rid"].to_numpy()[rows[:, 0]], frame["start"].to_numpy()[rows[:, 0]]
        arrays = [pa.array(rid, pa.int64()), pa.array(start + rows[:, 1], pa.int32()), pa.array(start + rows[:, 2], pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["rid", "start", "stop"])

    found, wide = repeats.by_key(different, search, "rid BIGINT, start INT, stop INT", most)
    spans = spans.unionByName(found)
    if not wide.isEmpty():
        rows = wide.where("_count = 1").unionByName(wide.where("_count > 1")).select(
            "place", "_count", F.split(F.decode("cut", "UTF-8"), " ").alias("words"), "windows"
        )
        rows = rows.select("place", "_count", "words", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("i")).select(
            F.array_join(F.slice("words", F.col("i") + 1, width), " ").alias("w"),
            F.col("place.rid").alias("rid"),
            (F.col("place.start") + F.col("i")).alias("start"),
        )
        twice = rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        spans = spans.unionByName(
            rows.join(twice, "w").select("rid", "start", (F.col("start") + F.lit(width)).alias("stop"))
        )
    return texts, spans


def removed(docs: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """Stored (rid, n_removed, kept_sha256, cut) of the identified documents that lose words.

    ``cut`` is the text without them: what stands between the words that stay is as it was, and where words are taken out a
    line break stays if one bordered on them, else a space.
    """
    texts, spans = marked(docs, width, gram, most)
    per_doc = stored(spans.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "window-spans")

    def remove(batches):
        import pyarrow as pa

        names = ["rid", "n_removed", "kept_sha256", "cut"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for rid, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                words = list(WORD.finditer(raw))
                starts = np.array([s["start"] for s in found])
                gone = repeats.covered(starts, np.array([s["stop"] for s in found]), len(words)).tolist()
                left = [w.group() for w, g in zip(words, gone, strict=True) if not g]
                cut = without(raw, words, gone)
                rows.append((rid, len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest(), cut.decode()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = texts.select("rid", "text").join(per_doc, "rid")
    schema = "rid BIGINT, n_removed BIGINT, kept_sha256 STRING, cut STRING"
    return stored(rows.mapInArrow(remove, schema), "window-removed")


def without(raw: bytes, words: list, gone: list[bool]) -> bytes:
    """raw without the words that are gone."""
    out, at, k = [], 0, 0
    while k < len(words):
        if not gone[k]:
            k += 1
            continue
        end = k
        while end < len(words) and gone[end]:
            end += 1
        before = raw[at : words[k].start()]
        kept = before.rstrip(b" \t\n\r\v\f")
        out.append(kept)
        at = words[end].start() if end < len(words) else len(raw)
        borders = before[len(kept) :] + raw[words[end - 1].end() : at]
        if (kept or len(out) > 1) and end < len(words):
            out.append(b"\n" if b"\n" in borders else b" ")
        k = end
    return b"".join([*out, raw[at:]])


def dedup(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, one space between) and cut, the text without the others."""
    docs = repeats.identified(docs).drop("row")
    gone = removed(docs, width, gram, most)
    plain = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(plain, BLANK + "+"), "")
    base = docs.select("rid", "doc_id", F.size(words).cast("long").alias("n_words"), "text")
    base = base.withColumn("_sha", F.sha2(F.array_join(words, " "), 256))
    return base.join(gone, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "_sha").alias("kept_sha256"),
        F.coalesce("cut", "text").alias("cut"),
    )


def cut_documents(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """docs with the words of repeated windows taken out of ``text``; n_chars, where there is one, follows."""
    found = repeats.identified(docs)
    gone = removed(found.drop("row"), width, gram, most).select("rid", "cut")
    columns = []
    for c in docs.columns:
        whole = F.col("row").getField(c)
        if c == "text":
            whole = F.coalesce("cut", whole)
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            whole = F.when(F.col("cut").isNotNull(), F.length("cut").cast(kind)).otherwise(whole)
        columns.append(whole.alias(c))
    return found.select("rid", "row").join(gone, "rid", "left").select(*columns)


def oracle_sql(width: int = WINDOW) -> str:
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS ws FROM documents),
    p AS (SELECT r, ws, unnest(range(1, len(ws) - {width} + 2)) AS p FROM d),
    h AS (SELECT r, p, sha256(array_to_string(ws[p : p + {width - 1}], ' ')) AS h FROM p),
    t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
    c AS (SELECT r, list(DISTINCT q) AS gone FROM (SELECT r, unnest(range(p, p + {width})) AS q FROM h JOIN t USING (h))
        GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(
        CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN c USING (r)"""
