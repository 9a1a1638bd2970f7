"""Approximate nearest neighbours by inner product over balanced posting lists.

* Centroids come from a bounded sample (``SAMPLE`` vectors with the smallest hashes) by k-means whose clusters are kept
  within ``BALANCE`` times the mean size. They and their neighbour graph are the only thing sent to every task; their
  number grows with the cube root of the vectors and never beyond ``MOST_LISTS``.
* Every vector enters the list of its nearest centroid and those of others hardly farther (``replicate``: distance ratio),
  found by best-first search in the graph. A query searches the lists within ``probe`` times the nearest distance.
* Inner product is turned into distance by one more component, sqrt(longest^2 - |x|^2); a query has 0 there.
* Equal vectors are one entry that keeps as many of the smallest ids as any answer can hold. Lists and the queries of a list
  are cut into blocks, so a task sees a bounded part of either; a block answers each query with its best entries, of equal
  scores those with the smallest ids.

null, zero, non-finite vectors and those of another length than most take no part; a null vec_id takes no part; rows
that repeat id and vector count once. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapcat.llm.shared import look_up, stored

SAMPLE = 20_000
MOST_LISTS = 1 << 14
BALANCE = 2.0
REPLICAS = 8
NEIGHBOURS = 24
LIST_BLOCK = 8192
QUERY_BLOCK = 2048


def list_count(n: int) -> int:
    return int(min(MOST_LISTS, max(1, n // 32), max(1, round(4 * n ** (1 / 3)))))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means in which a cluster holds at most BALANCE times the mean: the nearest claim it, the others go on."""
    rng = np.random.default_rng(7)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    room = max(1, int(np.ceil(BALANCE * len(x) / k)))
    for _ in range(rounds):
        near = ((centroids**2).sum(1) - 2 * x @ centroids.T).astype(np.float32)
        label = np.full(len(x), -1)
        free = np.full(k, room)
        open_rows = np.arange(len(x))
        while len(open_rows):
            best = near[open_rows].argmin(1)
            order = np.lexsort((near[open_rows, best], best))
            rows, lists = open_rows[order], best[order]
            starts = np.searchsorted(lists, lists)
            taken = np.arange(len(lists)) - starts < free[lists]
            label[rows[taken]] = lists[taken]
            free -= np.bincount(lists[taken], minlength=k)
            open_rows = rows[~taken]
            near[:, free <= 0] = np.inf
        for c in range(k):
            members = x[label == c]
            if len(members):
                centroids[c] = members.mean(0)
    return centroids


class Graph:
    """Centroids and for each its nearest others; searched best-first for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        self.norm = (self.c**2).sum(1)
        far = self.norm[:, None] + self.norm - 2 * self.c @ self.c.T
        np.fill_diagonal(far, -1)
        self.near = np.argsort(far, axis=1, kind="stable")[:, : NEIGHBOURS + 1]
        self.entries = np.unique(np.linspace(0, len(centroids) - 1, 8).astype(int))

    def search(self, x: np.ndarray, ratio: float, least: int = 4) -> np.ndarray:
        """Distances to the centroids that were visited, infinite elsewhere. Expands what lies within ``ratio`` of the best."""
        n, k = len(x), len(self.c)
        squares = (x**2).sum(1)
        found = np.full((n, k), np.inf, dtype=np.float32)
        todo = np.full((n, k), np.inf, dtype=np.float32)

        def visit(rows: np.ndarray, nodes: np.ndarray) -> None:
            fresh = np.isinf(found[rows[:, None], nodes])
            d = squares[rows, None] + self.norm[nodes] - 2 * np.einsum("ij,ikj->ik", x[rows], self.c[nodes])
            d = np.sqrt(np.maximum(d, 0))
            r, j = np.nonzero(fresh)
            found[rows[r], nodes[r, j]] = todo[rows[r], nodes[r, j]] = d[r, j]

        rows = np.arange(n)
        visit(rows, np.broadcast_to(self.entries, (n, len(self.entries))))
        steps = 0
        while len(rows):
            node = todo[rows].argmin(1)
            d = todo[rows, node]
            go = np.isfinite(d) & ((d <= ratio * found[rows].min(1)) | (steps < least))
            rows, node = rows[go], node[go]
            todo[rows, node] = np.inf
            for at in range(0, len(rows), 1024):
                visit(rows[at : at + 1024], self.near[node[at : at + 1024]])
            steps += 1
        return found


def matrix(column, dims: int) -> np.ndarray:
    """The vectors of an Arrow list column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def inner_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise products in double precision, summed in the order of the components."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    e = F.col("embedding")
    plain = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding")).where(
        e.isNotNull()
        & F.col("vec_id").isNotNull()
        & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
        & F.exists(e, lambda x: x != 0)
    )
    ids = plain.groupBy(F.size("embedding").alias("length")).agg(F.countDistinct("vec_id").alias("ids"))
    most = ids.orderBy(F.desc("ids"), F.desc("length")).first()
    return plain.where(F.size("embedding") == (most["length"] if most else 0)).distinct()


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, replicate: float = 1.05, probe: float = 1.5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by ``every``.

    Recall on the given tables is in the README; ``probe`` trades it for work.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors).withColumn("key", F.md5(F.col("embedding").cast("string"))), "ann-rows")
    by_id = Window.partitionBy("key").orderBy("vec_id")
    kept = rows.withColumn("_rank", F.row_number().over(by_id)).where(F.col("_rank") <= k + 1)
    counts = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("_count"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asks")
    )
    entries = kept.groupBy("key").agg(F.first("embedding").alias("embedding"), F.collect_list("vec_id").alias("ids"))
    entries = stored(
        entries.join(counts, "key").withColumns({"vid": F.monotonically_increasing_id(), "low": F.array_min("ids")}), "ann-entries"
    )
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    n, longest = entries.agg(F.count(F.lit(1)), F.max(square)).first()
    empty = "query_id BIGINT, rank INT, vec_id BIGINT, score DOUBLE"
    if not n:
        return spark.createDataFrame([], empty)
    sample = entries.select("embedding").orderBy(F.xxhash64("vid")).limit(SAMPLE).toArrow().column("embedding")
    dims = len(sample[0])
    base = np.concatenate([matrix(c, dims) for c in sample.chunks])

    def lifted(x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(longest - (x**2).sum(1), 0))
        return np.c_[x, rest].astype(np.float32)

    graph = spark.sparkContext.broadcast(Graph(balanced_centroids(lifted(base), min(list_count(n), len(base)))))

    def assign(batches):
        import pyarrow as pa

        g = graph.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = lifted(matrix(part.column(2), dims))
                far = g.search(x, replicate)
                order = np.argsort(far, axis=1, kind="stable")[:, :REPLICAS]
                d = np.take_along_axis(far, order, 1)
                row, j = np.nonzero(d <= replicate * d[:, :1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[row, j], pa.int32()), *[part.column(c).take(pa.array(row)) for c in range(3)]],
                    names=["list", "vid", "low", "embedding"],
                )

    def ask(batches):
        import pyarrow as pa

        g = graph.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(1), dims)
                x = x * (np.sqrt(longest) / np.sqrt((x**2).sum(1)))[:, None]
                far = g.search(np.c_[x, np.zeros(len(x))].astype(np.float32), probe)
                row, lists = np.nonzero(far <= probe * far.min(1)[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.int32()), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))],
                    names=["list", "vid", "embedding"],
                )

    schema = "list INT, vid BIGINT, embedding ARRAY<DOUBLE>"
    narrow = entries.select("vid", "low", "embedding")
    postings = stored(narrow.mapInArrow(assign, "list INT, vid BIGINT, low BIGINT, embedding ARRAY<DOUBLE>"), "ann-postings")
    queries = stored(entries.where("asks = 1").select("vid", "embedding").mapInArrow(ask, schema), "ann-queries")
    blocks = (
        postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("pb"))
        .join(queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qb")), "list")
    )
    blocks = F.broadcast(blocks)  # a row per centroid
    own, other = F.pmod(F.xxhash64("vid"), F.col("pb")), F.pmod(F.xxhash64("vid"), F.col("qb"))
    left = postings.join(blocks, "list").withColumns(
        {"p": own, "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb").cast("long") - 1))}
    )
    right = queries.join(blocks, "list").withColumns(
        {"q": other, "p": F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb").cast("long") - 1))}
    )

    def answer(key, posts, asks):
        import pandas as pd

        if posts.empty or asks.empty:
            return pd.DataFrame({"vid": [], "best": []})
        posts = posts.sort_values(["low", "vid"])
        v, vids, lows = np.stack(posts["embedding"].to_numpy()), posts["vid"].to_numpy(), posts["low"].to_numpy()
        q, out = np.stack(asks["embedding"].to_numpy()), []
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ v.T
            top = min(k + 1, len(v))
            bar = np.partition(rough, len(v) - top, axis=1)[:, len(v) - top] - 1e-9 * longest
            row, col = np.nonzero(rough >= bar[:, None])
            score = inner_products(q[at + row], v[col])
            for r in range(len(rough)):
                s, e = np.searchsorted(row, [r, r + 1])
                first = s + np.argsort(-score[s:e], kind="stable")[:top]  # of equal scores, by id
                found = (-score[first], lows[col[first]], vids[col[first]])
                out.append([{"s": a, "low": b, "vid": c} for a, b, c in zip(*(x.tolist() for x in found), strict=True)])
        return pd.DataFrame({"vid": asks["vid"], "best": out})

    parts = (
        left.select("list", "p", "q", "vid", "low", "embedding")
        .groupBy("list", "p", "q")
        .cogroup(right.select("list", "p", "q", "vid", "embedding").groupBy("list", "p", "q"))
        .applyInPandas(answer, "vid BIGINT, best ARRAY<STRUCT<s: DOUBLE, low: BIGINT, vid: BIGINT>>")
    )
    # per query vector its best entries: as many as one answer and the query itself can hold, each in REPLICAS lists at most
    merged = parts.groupBy("vid").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))
    best = F.slice(F.array_distinct(F.slice("best", 1, (k + 1) * REPLICAS)), 1, k + 1)
    hits = merged.select(F.col("vid").alias("asker"), F.explode(best).alias("hit")).select("asker", "hit.*")
    with_ids = hits.join(entries.select("vid", "ids"), "vid").select(
        "asker", F.transform("ids", lambda i: F.struct(F.col("s"), i.alias("id"))).alias("found")
    )
    answers = with_ids.groupBy("asker").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    answers = stored(
        answers.join(entries.where("asks = 1").select(F.col("vid").alias("asker"), "key", "_count"), "asker").select(
            "key", "found", "_count"
        ),
        "ann-answers",
    )
    asked = rows.where(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id"))
    least = max(1000, rows.count() // 1000)  # at most a thousand vectors are that frequent
    full = look_up(asked, answers, "key", F.col("query_id"), least)
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = full.select("query_id", F.posexplode(others).alias("at", "hit"))
    return out.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )
