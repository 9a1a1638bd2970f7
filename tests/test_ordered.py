"""Chunked scans and salted joins against brute force, with a group that holds a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from snapcat.operators.ordered import duplicates, has_duplicates, ordered_scan, salted_join, top_k


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else f"g{rng.randrange(40)}"
        rows.append((group, rng.randrange(-500, 5000), i, rng.randrange(10), rng.choice([None, "x", "y"])))
    return rows, spark.createDataFrame(rows, "g STRING, k BIGINT, id INT, n INT, v STRING")


@pytest.mark.parametrize("bits", [0, 5, 18])
def test_scan(skewed, bits):
    rows, df = skewed
    scanned = ordered_scan(
        df, ["g"], ["k", "id"], sums={"before": F.col("n"), "pos": F.lit(1)}, totals={"total": F.col("n")},
        lasts={"last": F.col("v")}, bits=bits,
    )
    expected = {}
    for group in {r[0] for r in rows}:
        total, pos, last = 0, 0, None
        members = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1], r[2]))
        for _, _, key, n, v in members:
            expected[key] = (total, pos, sum(m[3] for m in members), last)
            total, pos, last = total + n, pos + 1, v if v is not None else last
    got = {r["id"]: (r["before"], r["pos"], r["total"], r["last"]) for r in scanned.collect()}
    assert got == expected
    assert scanned.columns == ["g", "k", "id", "n", "v", "before", "pos", "total", "last"]


def test_scan_splits_a_hot_group(skewed):
    """Rows are shuffled by (group, chunk): the plan never partitions whole rows by the group alone."""
    plan = ordered_scan(skewed[1], ["g"], ["k", "id"], sums={"s": F.col("n")}, bits=5)._jdf.queryExecution().executedPlan().toString()
    by_group = [line for line in plan.splitlines() if "hashpartitioning(g#" in line and "__chunk" not in line]
    assert all("__p_" not in line and "id#" not in line for line in by_group)
    assert "__chunk" in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, skewed, how):
    df = skewed[1]
    small = spark.createDataFrame([("hot", 1), ("g1", 2), ("none", 3)], "g STRING, w INT")
    salted = salted_join(df, small, ["g"], how, ["id"], salts=5)
    plain = df.join(small, ["g"], how)
    assert sorted(map(tuple, salted.select(plain.columns).fillna("-").fillna(-1).collect())) == sorted(
        map(tuple, plain.fillna("-").fillna(-1).collect())
    )


def test_top_k_limits_before_the_shuffle(skewed):
    rows, df = skewed
    top = top_k(df, ["g"], [F.desc("k"), F.desc("id")], 3)
    expected = set()
    for group in {r[0] for r in rows}:
        expected |= {r[2] for r in sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], -r[2]))[:3]}
    assert {r["id"] for r in top.collect()} == expected
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_duplicates(skewed):
    df = skewed[1]
    assert duplicates(df, "id").count() == 0
    assert has_duplicates(df, "g").first()["has_duplicates"] is True
    assert has_duplicates(df, ["id"]).first()["has_duplicates"] is False


def test_rows_without_keys_stay(spark):
    rows = [("a", None, 1), ("a", 3, 2), ("a", 1 << 40, 4), (None, 5, 8), (None, None, 16)]
    df = spark.createDataFrame(rows, "g STRING, k BIGINT, v BIGINT")
    got = ordered_scan(df, ["g"], ["k"], sums={"s": F.col("v")}, totals={"t": F.col("v")}, lasts={"l": F.col("v")})
    want = {(1, 0, 7, None), (2, 1, 7, 1), (4, 3, 7, 2), (16, 0, 24, None), (8, 16, 24, 16)}
    assert {(r["v"], r["s"], r["t"], r["l"]) for r in got.collect()} == want
