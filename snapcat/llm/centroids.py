"""Integer k-means by a bisector tournament.

A vector takes part if it has exactly ``dims`` components, none of them null or non-finite; its component x becomes the
integer ``floor(scale * x)``. For every pair of centroids a table holds the integer normal and threshold of the plane
between them. A vector meets the centroids in the order of their numbers: each of the k-1 tests is the sign of one
integer dot product, the loser is out, and zero (the plane itself) favours the champion, which has the smaller number.
Only the distance to the last champion is computed, exactly.

Each round is one scan of the vectors: a task assigns its batches and keeps one sum per cluster and component, split into
limbs of 60 bits, so that any magnitude adds up exactly as DECIMAL; what reaches the driver is k rows of sums.

* null, short or long vectors and those with null, NaN or infinite components: no row in the result;
* no vector left or an empty table: no rows; fewer than k vectors: each one is a centroid at the start;
* repeated rows: each counts; of rows with the same vec_id the smaller vector comes first in the choice of centroids;
* null vec_id: takes part, but is chosen as a centroid after all others;
* components whose scaled value reaches 2**27: computed with unbounded integers; a distance or inertia beyond 64 bits is null;
* further columns of the input pass untouched, unless they bear a name of the result, which then wins.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapcat.llm.shared import blank_free, stored

DIMS, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Below this magnitude 64-bit integers hold every test and distance of 64 components.
NARROW = 1 << 27
LIMB = 60
#: Vectors assigned at once.
BLOCK = 4096


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors that take part, their integer components, int64 or unbounded)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().fill_null(0))
    at = np.flatnonzero(lengths == dims)
    flat = column.take(pa.array(at)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # a null component becomes NaN
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(x[good] * scale)
    if not np.isfinite(scaled).all() or (np.abs(scaled) >= NARROW).any():
        wide = [[whole(v, scale) for v in row] for row in x[good].tolist()]
        return at[good], np.array(wide, dtype=object).reshape(-1, dims)
    return at[good], scaled.astype(np.int64)


def whole(v: float, scale: int) -> int:
    """floor(scale * v), also where the product is beyond a double; v has no fraction there."""
    return math.floor(v * scale) if math.isfinite(v * scale) else int(v) * scale


class Tournament:
    """The planes between all pairs of centroids."""

    def __init__(self, centroids: list[list[int]]):
        wide = any(abs(v) >= NARROW for c in centroids for v in c)
        self.c = np.array(centroids, dtype=object if wide else np.int64)
        squares = (self.c * self.c).sum(axis=1)
        self.normals = 2 * (self.c[None, :, :] - self.c[:, None, :])  # [champion, challenger]
        self.thresholds = squares[None, :] - squares[:, None]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row of x."""
        wide = x.dtype == object or self.c.dtype == object
        if wide:
            x = x.astype(object)
        champion = np.zeros(len(x), dtype=np.int64)
        for challenger in range(1, len(self.c)):
            normals = self.normals[champion, challenger]
            if wide:
                dots = (normals.astype(object) * x).sum(axis=1)
            else:
                dots = np.einsum("ij,ij->i", normals, x)
            champion[(dots > self.thresholds[champion, challenger]).astype(bool)] = challenger
        difference = x - (self.c.astype(object) if wide else self.c)[champion]
        return champion, (difference * difference).sum(axis=1)


def blocks(column: pa.Array, dims: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for start in range(0, len(column), BLOCK):
        at, x = integers(column.slice(start, BLOCK), dims, scale)
        if len(at):
            yield at + start, x


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, digit) in base 2**60, with the sign of the value."""
    sign, value, place = (-1, -value, 0) if value < 0 else (1, value, 0)
    while value:
        yield place, sign * (value & ((1 << LIMB) - 1))
        value >>= LIMB
        place += 1


def partial_sums(centroids: list[list[int]], dims: int, scale: int):
    """Per task: rows (cluster, component, limb, value); component -1 counts the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        sums = np.zeros((len(centroids), dims), dtype=object)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            for _, x in blocks(batch.column(0), dims, scale):
                cluster, _ = tournament.assign(x)
                counts += np.bincount(cluster, minlength=len(centroids))
                for c in np.unique(cluster):
                    sums[c] += x[cluster == c].sum(axis=0)
        rows = [(c, -1, 0, int(n)) for c, n in enumerate(counts) if n]
        rows += [
            (c, d, place, digit)
            for c in np.flatnonzero(counts).tolist()
            for d in range(dims)
            for place, digit in limbs(int(sums[c, d]))
        ]
        columns = [list(x) for x in zip(*rows)] or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            ["cluster", "component", "limb", "value"],
        )

    return run


def moved(vectors: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """The centroids after one round: floor of the mean of each non-empty cluster."""
    partial = vectors.mapInArrow(
        partial_sums(centroids, dims, scale), "cluster int, component int, limb int, value bigint"
    )
    total = partial.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    counts = [0] * len(centroids)
    sums = [[0] * dims for _ in centroids]
    for cluster, component, limb, value in total.collect():  # k * dims sums, whatever the table
        if component < 0:
            counts[cluster] = int(value)
        else:
            sums[cluster][component] += int(value) << (LIMB * limb)
    return [[s // n for s in row] if n else old for row, n, old in zip(sums, counts, centroids)]


def first_centroids(vectors: DataFrame, column: str, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hash of their id, as integers: a top-k of k rows."""
    x = F.col(column)
    usable = F.size(x) == dims
    usable &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = vectors.where(usable).select(rank.alias("rank"), x.alias("x")).orderBy(F.asc_nulls_last("rank"), "x").limit(k)
    rows = [row.x for row in chosen.collect()]
    _, found = integers(pa.array(rows, pa.list_(pa.float64())), dims, scale)
    return [[int(v) for v in row] for row in found]


def fit(
    vectors: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
    seed: int = SEED,
) -> list[list[int]]:
    """Integer centroids after the given rounds over all vectors."""
    centroids = first_centroids(vectors, column, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors.select(column), centroids, dims, scale)
    return centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """The rows whose vector takes part, without the vector, with cluster, distance, cluster_inertia, inertia and
    centroid_sha256."""
    added = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kept = [c for c in vectors.columns if c != column and c.lower() not in added]
    vectors = vectors.select(*kept, column)
    centroids = fit(vectors, column, k, rounds, dims, scale, seed)
    if not centroids:
        empty = vectors.where(F.lit(False)).select(*kept)
        types = ["int", "bigint", "bigint", "bigint", "string"]
        return empty.withColumns({c: F.lit(None).cast(t) for c, t in zip(added, types)})
    at = vectors.columns.index(column)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        for batch in batches:
            for places, x in blocks(batch.column(at), dims, scale):
                cluster, distance = tournament.assign(x)
                rows = batch.take(pa.array(places))
                exact = [int(d) for d in distance] if distance.dtype == object else None
                short = pa.array(distance if exact is None else [d if d < 1 << 63 else None for d in exact], pa.int64())
                arrays = [rows.column(i) for i in range(len(kept))] + [pa.array(cluster.astype(np.int32)), short]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, "cluster", "distance"])

    fields = [vectors.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = stored(vectors.mapInArrow(last, schema), "centroids")
    prefix = blank_free(assigned, "_c")

    def sum_of(name: str):
        """Null where a distance or the sum is beyond 64 bits."""
        total = F.sum(F.col(name).cast("decimal(38,0)"))
        return F.when(F.count(name) == F.count(F.lit(1)), total)

    per_cluster = assigned.groupBy("cluster").agg(sum_of("distance").alias("s"))
    sums = {row.cluster: row.s for row in per_cluster.collect()}  # k rows

    def long(value):
        return None if value is None or value >= 1 << 63 else int(value)

    whole = long(None if None in sums.values() else sum(sums.values()))
    spark = vectors.sparkSession
    facts = spark.createDataFrame(
        [(c, long(s), whole, digest(centroids[c])) for c, s in sorted(sums.items())],
        f"{prefix} int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col(prefix)).drop(prefix)  # at most k rows


def oracle_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for the rows of ``cluster_vectors``, by distances to all centroids."""
    steps = []
    nearest = """
        a{r} AS MATERIALIZED (
          SELECT id, min_by(c, (d, c)) AS c, min(d) AS d FROM (
            SELECT p.id, q.c, sum((p.x - q.x) * (p.x - q.x)) AS d FROM p JOIN m{r} q ON p.i = q.i GROUP BY p.id, q.c)
          GROUP BY id)"""
    for r in range(rounds):
        steps.append(nearest.format(r=r))
        steps.append(f"""
        m{r + 1} AS MATERIALIZED (
          SELECT m{r}.c, m{r}.i, coalesce(s.x, m{r}.x) AS x FROM m{r} LEFT JOIN (
            SELECT a{r}.c, p.i, floor_div(sum(p.x), count(*)) AS x FROM a{r} JOIN p ON p.id = a{r}.id GROUP BY a{r}.c, p.i) s
          ON s.c = m{r}.c AND s.i = m{r}.i)""")
    steps.append(nearest.format(r=rounds))
    body = ",".join(steps).replace("floor_div(sum(p.x), count(*))",
                                   "CAST((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)")
    return f"""
      WITH v AS MATERIALIZED (
        SELECT vec_id, embedding AS e, row_number() OVER (ORDER BY vec_id, embedding) AS id FROM embeddings
        WHERE len(embedding) = {dims}
          AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y::DOUBLE))) = {dims}),
      p AS MATERIALIZED (
        SELECT id, i, CAST(floor({scale} * x) AS BIGINT) AS x FROM (
          SELECT id, unnest(range(1, {dims + 1})) AS i, unnest(e)::DOUBLE AS x FROM v)),
      start AS MATERIALIZED (
        SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, e) - 1 AS c FROM v
        QUALIFY c < {k}),
      m0 AS MATERIALIZED (SELECT c, i, x FROM start JOIN p USING (id)),{body},
      names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM m{rounds} GROUP BY c),
      sums AS (SELECT c, sum(d) AS s FROM a{rounds} GROUP BY c)
      SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
        CAST(sums.s AS BIGINT) AS cluster_inertia, CAST((SELECT sum(s) FROM sums) AS BIGINT) AS inertia,
        names.h AS centroid_sha256
      FROM a{rounds} a JOIN v USING (id) JOIN names ON names.c = a.c JOIN sums ON sums.c = a.c"""
