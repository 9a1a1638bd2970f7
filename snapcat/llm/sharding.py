"""Shards by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

A link is a (row, key) pair; rows that share a key are neighbours. Rows begin in the order of their smallest keys. A round
counts the rows of each key per shard (one aggregate), sums those counts for each row, and lets a row ask for the shard that
holds most of its neighbours. Requests are ranked per pair of shards, largest gain first, and granted as far as shards can
exchange equal numbers or have room, which is what the law allows minus the linked rows they hold; rounds go on until no
move gains. Rows without a neighbour belong nowhere; at the end they fill every shard up to its exact size, so the law
``rows`` holds: shard sizes differ by one at most.

The driver sees one number per pair of shards and round. A key with most of the rows is an aggregate like any other, and its counts
reach its rows through :func:`snapcat.llm.shared.look_up`; once a shard is full, the rest of such a group gathers in others.

null and empty texts have no neighbours but equal ones (null texts are neighbours of each other); repeated rows are separate
rows with equal keys; an empty table gives no rows; null doc_ids are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapcat.llm.shared import look_up, numbered, stored


def propagate(links: DataFrame, shards: int, quota: int, labels: DataFrame | None = None) -> DataFrame:
    """(rid, shard) of the linked rows of ``links`` (rid, key); no shard gets more than ``quota`` of them, if they fit.

    ``labels`` (rid, shard) is where they begin, by default :func:`start`. A round whose grants do not raise the number of
    neighbours side by side is tried again with half of them; the end is where no number of grants raises it, neither for
    requests to all shards nor for those to shards with room.
    """
    spark, every = links.sparkSession, range(shards)
    labels = stored(start(links, shards, quota) if labels is None else labels, "shard-labels")
    counts, total, together = met_in_shards(links, labels, shards)
    only_room, failed = False, 0
    while failed < 2:
        sizes = dict(labels.groupBy("shard").count().collect())  # a row per shard
        rooms = [max(0, quota - sizes.get(t, 0)) for t in every]
        met = look_up(links.join(labels, "rid"), counts, "key", F.col("rid"), max(1000, total // 1000))
        sums = met.groupBy("rid").agg(F.first("shard").alias("shard"), F.min("key").alias("key"), *[F.sum(f"n{t}").alias(f"n{t}") for t in every])
        ns = F.array(*[F.when(F.lit(not only_room or rooms[t] > 0) | (F.col("shard") == t), F.col(f"n{t}")).otherwise(-1) for t in every])
        sums = sums.select("rid", "key", "shard", ns.alias("ns"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("turn"))
        # of equal shards, the first from one that differs by key
        ranks = F.transform("ns", lambda n, t: F.struct((-n).alias("n"), F.pmod(t - F.col("turn"), F.lit(shards)), t.alias("t")))
        loss = F.element_at("ns", F.col("shard") + 1) - F.array_max("ns")
        wants = sums.select("rid", "key", "shard", F.array_min(ranks)["t"].alias("wanted"), loss.alias("loss")).where("wanted <> shard")
        wants = stored(wants.withColumn("pair", F.col("shard") * shards + F.col("wanted")), "shard-wants")
        asked = dict(wants.groupBy("pair").count().collect())  # a row per pair of shards
        # rows of one key side by side, so that a quota's edge parts one group and not many
        ranked = stored(numbered(wants, "pair", "loss", "key", "rid", into="place", name="shard-requests"), "shard-ranked") if asked else None
        moved, half = None, 0
        while moved is None:
            granted = grants({divmod(p, shards): n >> half for p, n in asked.items()}, rooms)
            if not granted:
                break
            limits = spark.createDataFrame([(s * shards + t, n) for (s, t), n in granted.items()], "pair INT, most BIGINT")
            moves = ranked.join(F.broadcast(limits), "pair").where("place < most").select("rid", "wanted")
            trial = labels.join(moves, "rid", "left").select("rid", F.coalesce("wanted", "shard").alias("shard"))
            trial = stored(trial, "shard-labels")
            seen = met_in_shards(links, trial, shards)
            if seen[2] > together:
                moved, (counts, total, together) = trial, seen
            half += 1
        if moved is None:
            only_room, failed = not only_room, failed + 1
        else:
            labels, failed = moved, 0
    return labels


def met_in_shards(links: DataFrame, labels: DataFrame, shards: int) -> tuple[DataFrame, int, int]:
    """Rows of each key per shard, the number of links, and that of pairs of neighbours in one shard (each row with itself too)."""
    ns = [F.count(F.when(F.col("shard") == t, 1)).alias(f"n{t}") for t in range(shards)]
    counts = stored(links.join(labels, "rid").groupBy("key").agg(F.count(F.lit(1)).alias("_count"), *ns), "shard-counts")
    squares = F.aggregate(F.array(*[f"n{t}" for t in range(shards)]), F.lit(0).cast("long"), lambda a, n: a + n * n)
    total, together = counts.agg(F.sum("_count"), F.sum(squares.cast("decimal(38,0)"))).first()
    return counts, int(total or 0), int(together or 0)


def grants(asked: dict[tuple[int, int], int], rooms: list[int]) -> dict[tuple[int, int], int]:
    """How many of the ``asked`` moves {(from, to): number} go without more than ``rooms`` in any shard.

    Shards exchange equal numbers, in both directions or around a circle, or in a chain that ends in free room.
    """
    outside, left = len(rooms), {e: n for e, n in asked.items() if n > 0}
    most = sum(left.values())
    left |= {(t, outside): n for t, n in enumerate(rooms) if n > 0} | {(outside, s): most for s in range(outside) if most}
    given: dict[tuple[int, int], int] = {}
    for node in range(outside + 1):
        while way := circle(left, node):
            n = min(left[e] for e in way)
            for e in way:
                left[e] -= n
                if outside not in e:
                    given[e] = given.get(e, 0) + n
    return given


def circle(left: dict[tuple[int, int], int], node: int) -> list[tuple[int, int]]:
    """The edges of a shortest circle through ``node`` over edges with something left, or none."""
    came: dict[int, tuple[int, int]] = {}
    reached = [node]
    for a in reached:
        for e in sorted(e for e, n in left.items() if e[0] == a and n > 0 and e[1] not in came):
            came[e[1]] = e
            if e[1] == node:
                way = [e]
                while way[-1][0] != node:
                    way.append(came[way[-1][0]])
                return way
            reached.append(e[1])
    return []


def start(links: DataFrame, shards: int, quota: int) -> DataFrame:
    """Rows in the order of their smallest keys, cut into full shards, so that few keys begin in several."""
    keys = links.groupBy("rid").agg(F.min("key").alias("key")).withColumn("all", F.lit(0))
    place = F.col("place")
    rest = F.pmod(place - quota * shards, F.lit(shards))  # a row each beyond the quota
    shard = F.when(place < quota * shards, F.floor(place / max(1, quota))).otherwise(rest)
    return numbered(keys, "all", "key", "rid", into="place", name="shard-start").select("rid", shard.cast("int").alias("shard"))


def balanced_shards(rows: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """(rid, shard, slot) for every rid of ``rows``: sizes at most one apart, slots gapless from 0.

    ``links`` (rid, key string) names the keys of rows; keys of one row only count for nothing.
    """
    total = rows.count()
    shared = links.groupBy("key").agg(F.count(F.lit(1)).alias("_count")).where("_count > 1")
    shared = stored(shared, "shard-keys")
    met = look_up(links, shared, "key", F.col("rid"), max(1000, total // 1000)).where(F.col("_count").isNotNull())
    labels = propagate(stored(met.select("rid", "key"), "shard-links"), shards, total // shards)
    held = labels.withColumn("over", F.lit(0))
    sizes = dict(labels.groupBy("shard").count().collect())
    targets = [total // shards + (t < total % shards) for t in range(shards)]
    if any(sizes.get(t, 0) > targets[t] for t in range(shards)):  # more linked rows than fit: the last of a shard go on
        ranked = numbered(labels, "shard", "rid", into="place", name="shard-overflow")
        target = F.element_at(F.array(*[F.lit(t) for t in targets]), F.col("shard") + 1)
        held = stored(ranked.withColumn("over", (F.col("place") >= target).cast("int")).drop("place"), "shard-held")
    held = held.where("over = 0").select("rid", "shard")
    sizes = [min(sizes.get(t, 0), targets[t]) for t in range(shards)]
    free = rows.select("rid").join(held, "rid", "left_anti").withColumn("all", F.lit(0)).withColumn("h", F.xxhash64("rid"))
    free = numbered(free, "all", "h", "rid", into="place", name="shard-fillers")
    chosen, edge = F.lit(None).cast("int"), 0
    for t in range(shards):
        low, edge = edge, edge + targets[t] - sizes[t]
        chosen = F.when((F.col("place") >= low) & (F.col("place") < edge), t).otherwise(chosen)
    everything = held.unionByName(free.select("rid", chosen.alias("shard")))
    return numbered(everything, "shard", "rid", into="slot", name="shard-slots")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; neighbours are equal texts.

    size is the bytes of the text (null: none) plus 1; text_crc32 of a null text is that of no bytes, 0.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(raw) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.coalesce(F.concat(F.md5("text"), F.octet_length("text").cast("string")), F.lit("null")).alias("key"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "shard-rows",
    )
    placed = balanced_shards(rows.select("rid"), rows.select("rid", "key"), shards)
    return rows.join(placed, "rid").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
