"""The bisector tournament against a plain k-means on Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from snapcat.llm import centroids

SCHEMA = "vec_id BIGINT, embedding ARRAY<DOUBLE>, cluster STRING, note STRING"


def plain(rows, dims, k, rounds, scale=256, seed=2):
    kept = [
        (i, [math.floor(Fraction(x) * scale) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    rank = {i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i, _ in kept if i is not None}
    c = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, rank.get(r[0], ""), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(x) for x in zip(*groups[j])] if j in groups else m for j, m in enumerate(c)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, n in last if n == j) for _, _, j in last}
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]

    def long(x):
        return x if x < 1 << 63 else None

    def total(ds):
        return None if any(d is None for d in ds) else long(sum(ds))

    per = {j: total([long(d) for _, d, n in last if n == j]) for j in inertia}
    whole = total(list(per.values()))
    return sorted(((i, j, long(d), per[j], whole, names[j]) for i, d, j in last), key=repr)


def result(spark, rows, dims, k, rounds):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)
    got = centroids.cluster_vectors(df, k=k, rounds=rounds, dims=dims)
    assert sorted(got.columns) == sorted(["vec_id", "note", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.select(names).collect()), key=repr)


def test_equals_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-2.5, -1.0, -0.001, 0.0, 0.5, 1.0, 3.0]) for _ in range(4)]) for i in range(300)]
    rows += [(i, rows[i][1]) for i in range(40)] + [(900 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(200)]  # copies and ties
    rows += [(None, [9.0, 9.0, 9.0, 9.0]), (5000, None), (5001, []), (5002, [1.0] * 3), (5003, [1.0] * 5)]
    rows += [(5004, [1.0, None, 1.0, 1.0]), (5005, [1.0, math.nan, 1.0, 1.0]), (5006, [1.0, math.inf, 1.0, 1.0])]
    assert result(spark, rows, 4, 7, 3) == plain(rows, 4, 7, 3)


def test_more_centroids_than_vectors_and_no_vector(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 0.5])]
    assert result(spark, rows, 2, 40, 5) == plain(rows, 2, 40, 5)
    assert result(spark, [(1, None), (2, [1.0])], 2, 40, 5) == []
    assert result(spark, [], 2, 40, 5) == []


@pytest.mark.parametrize("large", [2.0**21, 2.0**40, 1e30, 8e307])
def test_any_magnitude_is_exact(spark, large):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-large, large), rng.uniform(-3, 3), float(i)]) for i in range(60)]
    assert result(spark, rows, 3, 5, 2) == plain(rows, 3, 5, 2)


def test_plane_favours_the_smaller_number():
    t = centroids.Tournament([[0, 0], [4, 0], [0, 4], [4, 4]])
    cluster, distance = t.assign(np.array([[2, 2], [2, 0], [4, 2], [3, 3]]))
    assert cluster.tolist() == [0, 0, 1, 3] and distance.tolist() == [8, 4, 4, 2]


def test_limbs_add_up():
    for value in (0, 1, -1, 1 << 60, -(1 << 61) - 7, 3**200, -(3**200)):
        assert sum(d << (centroids.LIMB * p) for p, d in centroids.limbs(value)) == value
