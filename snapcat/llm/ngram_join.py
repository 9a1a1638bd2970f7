"""Similarity join of documents by the Jaccard similarity of their word shingles, with token-combination prefixes.

1. Equal sets are one class; only its smallest document goes on.
2. Shingles that many documents have are frequent (a bounded list; which ones does not matter for the result). A set is
   ordered rare shingles first. Two sets that link must meet within prefixes: ``n - needed + 1`` shingles long if those are
   rare. Frequent ones are dealt into groups, and only pairs of the same group are indexed; a group's first member earns
   nothing, so the prefix is extended until as many places are earned. Groups depend on the size class of both sets.
3. Sets that share an index key are buckets. Each bucket is first compared with one pivot (the set with the fewest rare
   shingles, the centre of a group of near copies); links are joined to components. Then only pairs of a bucket that are
   still in different components are compared (buckets of the same sets once), where sizes, shares of frequent shingles and parities allow a link at all: a
   set's 256 parities tell of how many of its shingles, dealt by hash, each class holds an odd number; sets differ in as many
   shingles as in parities at least. A large group of near copies thus costs as many comparisons as it has members, and
   members just below the similarity are told apart without their texts.
4. Every candidate is verified on the whole texts.

Rows that repeat a doc_id are documents of their own (component_id is then the smallest doc_id all the same). null and
empty texts have no shingles and stay alone. An empty table gives no rows. Other columns are not read. Very long texts are held
whole by one worker, about forty bytes per byte. Words are hashed by their bytes, eight at a time with their place, shingles by
their words; they are compared by 64 bits, equal sets by 128.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm import repeats, rolling
from snapcat.llm.shared import components, look_up, stored

#: Frequent shingles: at most so many, each in so many documents at least.
MOST_FREQUENT = 1 << 18
LEAST_FREQUENT = 8
#: Shingles a task counts before it gives those that it saw twice.
COUNT_BLOCK = 4 << 20
#: Sizes of one class differ by less than this factor; it must be more than 1 / 0.8.
SIZE_STEP = 1.26

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of texts that lie one behind the other, in that order."""
    data = LOWER[data]
    first, last, doc = rolling.words(data, offsets)
    if not len(first):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    sums = rolling.Sums(rolling.word_hashes(data, first, last))
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    sizes = np.diff(bounds)
    grams = sums.grams(k)
    whole = np.flatnonzero(doc[: len(grams)] == doc[k - 1 : k - 1 + len(grams)]) if len(grams) else np.empty(0, dtype=np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    of_short = rolling.mixed(sums.of(bounds[short], bounds[short + 1]) + sizes[short].astype(np.uint64))
    docs = np.concatenate([doc[whole], short])
    hashes = np.concatenate([grams[whole], of_short])
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[fresh], hashes[fresh]


def parities(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """256 bits per set, as four 64-bit numbers: whether the set holds an odd number of shingles of a class."""
    found = []
    for part in range(len(PARITIES)):
        own = hashes >> np.uint64(62) == np.uint64(part)
        bits = np.zeros(len(hashes) + 1, dtype=np.uint64)
        bits[1:] = np.where(own, np.uint64(1) << (hashes >> np.uint64(56) & np.uint64(63)), np.uint64(0))
        bits = np.bitwise_xor.accumulate(bits)
        found.append((bits[bounds[1:]] ^ bits[bounds[:-1]]).view(np.int64))
    return found


def needed(n, percent: int):
    """The least overlap of a set of n with any set it links to."""
    return -(-percent * n // 100)


def groups_of(size_class: int, percent: int) -> int:
    """Groups of frequent shingles for sets of a size class and the one below; 0: each is indexed alone."""
    n = max(1, int(SIZE_STEP ** (size_class - 1)))
    prefix = n - int(needed(n, percent)) + 1
    return prefix // 4 if prefix >= 4 else 0


def combinations(frequent: np.ndarray, places: int, n: int, percent: int) -> list[int]:
    """Index keys that make up ``places`` places of the prefix of a set of n from its frequent shingles in their order."""
    keys: list[int] = []
    own = int(math.log(n) / math.log(SIZE_STEP))
    for size_class in (own, own + 1):
        groups = groups_of(size_class, percent)
        seed = np.uint64(size_class + 1)
        if not groups:
            keys += rolling.mixed(frequent[:places] + seed).view(np.int64).tolist()
            continue
        members: dict[int, list[int]] = {}
        earned = 0
        for k, g in enumerate((frequent % np.uint64(groups)).tolist()):
            if g in members:
                earned += 1
                members[g].append(k)
            else:
                members[g] = [k]
            if earned == places:
                break
        left, right = [], []
        for m in members.values():
            for i in range(1, len(m)):
                left += m[:i]
                right += [m[i]] * i
        if left:
            pairs = rolling.mixed(frequent[left] + seed) * np.uint64(3) + frequent[right]
            keys += rolling.mixed(pairs).view(np.int64).tolist()
    return keys


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles found in many documents: the most frequent ones, at most MOST_FREQUENT.

    Each task counts blocks of its documents' shingles and gives those it saw twice, so the counts summed here are lower
    bounds; a shingle that is wrongly taken for rare costs time, not results.
    """

    def count(batches):
        import pyarrow as pa

        waiting, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            twice = n > 1
            arrays = [pa.array(found[twice].view(np.int64)), pa.array(n[twice])]
            return pa.RecordBatch.from_arrays(arrays, names=["shingle", "n"])

        for batch in batches:
            for _, data, offsets in rolling.text_blocks(batch, 0):
                hashes = shingles(data, offsets, k)[1]
                waiting.append(hashes)
                size += len(hashes)
                if size >= COUNT_BLOCK:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    rows = docs.select("text").mapInArrow(count, "shingle BIGINT, n BIGINT").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = stored(rows.where(F.col("n") >= LEAST_FREQUENT), "frequent-shingles")
    levels = F.least(F.col("n"), F.lit(1 << 20))  # a row per count, a bounded number
    least, total = LEAST_FREQUENT, 0
    for level, n in sorted(rows.groupBy(levels.alias("level")).count().collect(), reverse=True):
        total += n
        if total > MOST_FREQUENT:
            least = level + 1
            break
    chosen = rows.where(F.col("n") >= least).select("shingle").toArrow().column("shingle")
    return np.sort(chosen.to_numpy().view(np.uint64)) if len(chosen) else np.empty(0, dtype=np.uint64)


PARITIES = ["p0", "p1", "p2", "p3"]
SETS = "rid BIGINT, n BIGINT, r BIGINT, s1 BIGINT, s2 BIGINT, rare ARRAY<BIGINT>, combined ARRAY<BIGINT>, " + ", ".join(
    f"{p} BIGINT" for p in PARITIES
)


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Per document its set's size n, number of rare shingles r, hashes s1, s2 of the set, its index keys and parities."""
    often = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, k))

    def index(batches):
        import pyarrow as pa

        frequent = often.value
        for batch in batches:
            for at, data, offsets in rolling.text_blocks(batch, 1):
                doc, hashes = shingles(data, offsets, k)
                near = np.searchsorted(frequent, hashes)
                known = frequent[np.minimum(near, len(frequent) - 1)] == hashes if len(frequent) else np.zeros(len(doc), bool)
                order = np.lexsort((hashes, known, doc))
                doc, hashes, known = doc[order], hashes[order], known[order]
                count = len(offsets) - 1
                bounds = np.searchsorted(doc, np.arange(count + 1))
                n = np.diff(bounds)
                sums = np.zeros((3, len(hashes) + 1), dtype=np.uint64)
                np.cumsum(rolling.mixed(hashes + np.uint64(1)), out=sums[0, 1:])
                np.cumsum(rolling.mixed(hashes ^ rolling.MIX[0]), out=sums[1, 1:])
                np.cumsum(~known, out=sums[2, 1:])
                s1, s2, r = ((x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums)
                length = np.where(n > 0, n - needed(n, percent) + 1, 0)
                rare = np.minimum(r, length)
                starts = bounds[:-1]
                picked = np.repeat(starts, rare) + np.arange(int(rare.sum())) - np.repeat(np.cumsum(rare) - rare, rare)
                pairs: list[list[int]] = [[] for _ in range(count)]
                for d in np.flatnonzero(r < length).tolist():
                    own = hashes[starts[d] + r[d] : bounds[d + 1]]
                    pairs[d] = combinations(own, int(length[d] - r[d]), int(n[d]), percent)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, count),
                        pa.array(n),
                        pa.array(r),
                        pa.array(s1),
                        pa.array(s2),
                        pa.ListArray.from_arrays(
                            pa.array(np.r_[0, np.cumsum(rare)], pa.int32()), pa.array(hashes[picked].view(np.int64))
                        ),
                        pa.array(pairs, pa.list_(pa.int64())),
                        *map(pa.array, parities(hashes, bounds)),
                    ],
                    names=["rid", "n", "r", "s1", "s2", "rare", "combined", *PARITIES],
                )

    return docs.select("rid", "text").mapInArrow(index, SETS)


def bucketed(sets: DataFrame) -> DataFrame:
    """Rows (key, pairs, rid, n, r, pivot, pn, pr) of buckets with more than one set.

    Rows are range-partitioned by (key, r, rid), so a large bucket spreads over partitions, each with a pivot of its own. The
    first and last bucket of a partition are kept unseen, as they may go on next door.
    """
    entry = lambda c, pairs: F.transform(c, lambda x: F.struct(x.alias("key"), F.lit(pairs).alias("pairs")))
    rows = sets.select("rid", "n", "r", F.explode(F.concat(entry("rare", False), entry("combined", True))).alias("e"))
    rows = rows.select("e.key", "e.pairs", "rid", "n", "r").distinct()

    def pivots(batches):
        import pyarrow as pa

        held, before, pivot = None, None, None
        names = ["key", "pairs", "rid", "n", "r", "pivot", "pn", "pr"]

        def out(batch, head, keep):
            nonlocal pivot
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
            place = np.maximum.accumulate(np.where(head, np.arange(len(head)), -1))
            found = []
            for j, column in enumerate(columns):
                old = pivot[j] if pivot is not None else 0
                found.append(np.where(place >= 0, column[place], old))
            if len(place):
                pivot = [x[-1] for x in found]
            arrays = [*(batch.column(i) for i in range(5)), *(pa.array(x, pa.int64()) for x in found)]
            return pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.r_[before is None or keys[0] == before, same]
            keep[:-1] |= same
            head = np.r_[before is None or keys[0] != before, ~same]
            end = batch.num_rows - 1
            held, before = batch.slice(end), keys[-2] if len(keys) > 1 else before
            if end:
                yield out(batch.slice(0, end), head[:-1], keep[:-1])
        if held is not None:
            fresh = before is None or held.column(0).to_numpy()[0] != before
            yield out(held, np.array([fresh]), np.array([True]))

    schema = "key BIGINT, pairs BOOLEAN, rid BIGINT, n BIGINT, r BIGINT, pivot BIGINT, pn BIGINT, pr BIGINT"
    ranged = rows.repartitionByRange("key", "r", "rid").sortWithinPartitions("key", "r", "rid")
    return ranged.mapInArrow(pivots, schema)


def possible(n, r, m, q, pairs, percent: int):
    """Whether sets of n and m, r and q of them rare, can link. If they met on pairs only, no rare shingle is common."""
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (~pairs | ((100 + percent) * F.least(n - r, m - q) >= percent * (n + m)))


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole texts (rid, text). Texts that many pairs need are repeated for parts."""
    # a's text meets its pairs in parts of about 256
    often = stored(
        pairs.groupBy("a")
        .agg(F.count(F.lit(1)).alias("_count"))
        .where("_count > 256")
        .withColumn("name", F.col("a").cast("string")),
        "pair-pivots",
    )
    parts = F.coalesce(F.ceil(F.col("_count") / 256), F.lit(1)).cast("int")
    least = max(1000, int(often.agg(F.sum("_count")).first()[0] or 0) // 1000)
    keyed = pairs.withColumn("name", F.col("a").cast("string"))
    left = look_up(keyed, often.select("name", "_count"), "name", F.col("b"), least)
    left = left.select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    fronts = texts.join(often.select(F.col("a").alias("rid"), "_count"), "rid", "left")
    fronts = fronts.select(
        F.col("rid").alias("a"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
    )
    backs = texts.select(F.col("rid").alias("b"), F.col("text").alias("tb"))
    rows = left.join(backs, "b").join(fronts, ["a", "part"]).select("a", "b", "ta", "tb")

    def check(batches):
        import pyarrow as pa

        def sets(batch, column):
            for _, data, offsets in rolling.text_blocks(batch, column):
                doc, hashes = shingles(data, offsets, k)
                yield from np.split(hashes, np.searchsorted(doc, np.arange(1, len(offsets) - 1)))

        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for x, y in zip(sets(batch, 2), sets(batch, 3), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return rows.mapInArrow(check, "a BIGINT, b BIGINT")


def near(n, m, percent: int):
    """Whether sets of n and m, parities ``p0`` to ``p3`` and ``q0`` to ``q3``, can link: they differ in few enough places."""
    differing = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(p.replace("p", "q")))) for p in PARITIES), F.lit(0))
    return (100 + percent) * differing <= (100 - percent) * (n + m)


def open_buckets(rows: DataFrame) -> DataFrame:
    """(key, pairs) of buckets whose sets are in different components c. Of buckets with the same sets, told by 128 bits, one:
    sets that have most of their shingles in common meet in most of their buckets, and would be paired in each."""
    members = rows.groupBy("key", "pairs").agg(
        F.min("c").alias("low"),
        F.max("c").alias("high"),
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("rid")).alias("m1"),
        F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("m2"),
    )
    return members.where("low <> high").groupBy("pairs", "size", "m1", "m2").agg(F.min("key").alias("key")).select("key", "pairs")


def links(sets: DataFrame, marks: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different sets, enough of them to connect all that are connected by any.

    ``marks``: the parities of sets (rid, p0 to p3), stored.
    """
    spark = sets.sparkSession
    buckets = stored(bucketed(sets), "join-buckets")
    texts = stored(docs.select("rid", "text").join(buckets.select("rid").distinct(), "rid", "left_semi"), "join-texts", "zstd")
    col = F.col
    star = buckets.where(col("rid") != col("pivot")).where(
        possible(col("n"), col("r"), col("pn"), col("pr"), col("pairs"), percent)
    )
    star = stored(star.select(col("pivot").alias("a"), col("rid").alias("b")).distinct(), "join-star")
    first = stored(verified(star, texts, k, percent), "join-links")
    found = components(spark, first)
    rows = buckets.drop("pivot", "pn", "pr").join(found.withColumnRenamed("doc_id", "rid"), "rid", "left")
    rows = rows.withColumn("c", F.coalesce("component_id", "rid")).drop("component_id")
    rows = stored(rows.join(open_buckets(rows), ["key", "pairs"], "left_semi").join(marks, "rid"), "join-open")
    # x meets sets that are no larger than its own, by size within a few percent
    step = math.log(1.04)
    size = lambda n: F.floor(F.log(n.cast("double")) / step).cast("int")
    cap = F.when(col("pairs"), F.floor((100 + percent) * (col("n") - col("r")) / percent) - col("n")).otherwise(col("n"))
    x = rows.withColumn("most", F.least(cap, col("n"))).withColumn("fewest", F.ceil(col("n") * percent / 100))
    x = x.where(col("most") >= col("fewest")).select(
        "key",
        "pairs",
        F.explode(F.sequence(size(col("fewest")), size(col("most")))).alias("size"),
        col("rid").alias("a"),
        col("n").alias("na"),
        col("r").alias("ra"),
        col("c").alias("ca"),
        *[col(p).alias(p.replace("p", "q")) for p in PARITIES],
    )
    y = rows.select("key", size(col("n")).alias("size"), col("rid").alias("b"), "n", "r", "c", *PARITIES)
    second = x.join(y, ["key", "size"]).where(
        (col("ca") != col("c"))
        & ((col("na") > col("n")) | ((col("na") == col("n")) & (col("a") > col("b"))))
        & possible(col("na"), col("ra"), col("n"), col("r"), col("pairs"), percent)
        & near(col("na"), col("n"), percent)
    )
    tried = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    second = second.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    second = stored(second.join(tried, ["a", "b"], "left_anti"), "join-rest")
    return first.unionByName(stored(verified(second, texts, k, percent), "join-links"))


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """rid, doc_id, n_shingles, component (the smallest rid reachable by links) and component_id (its doc_id).

    ``percent``: the least Jaccard similarity of two documents that link, 80 or more.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be 80 to 100")
    return joined(repeats.identified(docs), k, percent)


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs``, one of each component of links: that with the smallest doc_id. All columns stay."""
    docs = repeats.identified(docs)
    first = joined(docs, k, percent).where("rid = component").select("rid")
    return docs.join(first, "rid", "left_semi").select("row.*")


def joined(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """:func:`join` of identified documents."""
    sets = stored(prefixes(docs, k, percent), "join-sets")
    classes = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("_count"))
    classes = stored(classes, "join-classes")
    alone = sets.join(classes.select(F.col("first").alias("rid")), "rid", "left_semi")
    linked = components(docs.sparkSession, links(alone, sets.select("rid", *PARITIES), docs, k, percent))
    owners = classes.join(linked.withColumnRenamed("doc_id", "first"), "first", "left").select(
        F.concat_ws("-", "s1", "s2", "n").alias("name"), "_count", F.coalesce("component_id", "first").alias("component")
    )
    owners = stored(owners, "join-owners")
    named = sets.select("rid", "n", F.concat_ws("-", "s1", "s2", "n").alias("name"))
    found = look_up(named, owners, "name", F.col("rid"), max(1000, sets.count() // 1000))
    result = stored(
        found.select("rid", F.col("n").alias("n_shingles"), F.coalesce("component", "rid").alias("component")), "join-result"
    )
    ids = docs.select("rid", "doc_id")
    out = result.join(ids, "rid")
    if ids.where(~F.col("rid").eqNullSafe(F.col("doc_id"))).isEmpty():
        return out.withColumn("component_id", F.col("component"))
    return out.join(ids.select(F.col("rid").alias("component"), F.col("doc_id").alias("component_id")), "component")


def oracle_sql(k: int = 4, percent: int = 85) -> str:
    blank = r"[\x09-\x0D\x20]"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({low}, '{blank}+'), lambda x: x <> '') AS ws
        FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + {k - 1}], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id),
    l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= {percent} * (x.n + y.n - o)),
    r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(c) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n"""
