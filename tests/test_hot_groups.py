"""Groups and keys that hold a third of all rows: how they are found, cut, scanned and joined, and the plans that follow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleet_queries.base import QUERIES
from snapcat.operators import labels, summary
from snapcat.operators.labels import Label
from snapcat.operators.ordered import CHUNK, MOST_PARTS, Scans, hot_groups, salted_join

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        group = "hot" if i % 3 == 0 else None if i % 9 == 1 else f"g{rng.randrange(200)}"
        key = rng.choice([None, 10**12, rng.randrange(40), rng.randrange(10**6)])  # nulls, an outlier, many ties
        rows.append((group, key, i, rng.randrange(5)))
    return rows, spark.createDataFrame(rows, "g STRING, k BIGINT, id INT, n INT").repartition(4)


def test_hot_groups_are_counted(skewed):
    rows, df = skewed
    want = {g: n for g, n in Counter(r[0] for r in rows).items() if n > 1 << 7}
    got = {r["g"]: (r["__rows"], r["__parts"]) for r in hot_groups(df, ["g"], 7).collect()}
    assert got == {g: (n, -(-n // 128)) for g, n in want.items()} and {"hot", None} <= set(got)
    assert hot_groups(df, ["g"], 13) is None and MOST_PARTS >= 1 << 10


def test_parts_of_a_hot_group_are_even(skewed):
    rows, df = skewed
    scans = Scans(df, ["g"], ["k", "id"], bits=8)
    sizes = Counter((r["g"], r[CHUNK]) for r in scans.rows.collect())
    hot = {part: n for (g, part), n in sizes.items() if g == "hot"}
    assert len(hot) >= 6 and max(hot.values()) < 3 * 256 and set(hot) == set(range(len(hot)))
    assert {part for g, part in sizes if g not in ("hot", None)} == {-1}  # the others stay whole


def test_scans_in_a_row_share_parts(skewed):
    """Ranks among all rows, then among those the first rank kept, in hot groups and others."""
    rows, df = skewed
    scans = Scans(df, ["g"], ["k", "id"], bits=6)
    one = scans.add(scans.rows, sums={"r": F.lit(1)}, totals={"t": F.col("n")}, lasts={"l": F.when(F.col("n") == 4, F.col("id"))},
                    bests={"b": F.when(F.col("n") == 3, F.struct("id"))})
    odd = (F.col("r") % 2 == 1).cast("int")
    two = scans.add(one, sums={"r2": odd}, totals={"t2": odd})
    got = {r["id"]: (r["r"], r["t"], r["l"], r["r2"], r["t2"], r["b"] and r["b"]["id"]) for r in two.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        last, n_odd = None, 0
        best = max((m[2] for m in members if m[3] == 3), default=None)
        for rank, (_, _, i, n) in enumerate(members):
            want[i] = (rank, sum(m[3] for m in members), last, n_odd, len(members) // 2, best)
            last, n_odd = i if n == 4 else last, n_odd + rank % 2
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_of_hot_keys(spark, skewed, how):
    df = skewed[1]
    small = spark.createDataFrame([("hot", 1), ("hot", 5), ("g1", 2), ("none", 3), (None, 4)], "g STRING, w INT")
    joined = salted_join(df, small, ["g"], how, ["id"], bits=6)
    want = df.join(small, ["g"], how)
    assert joined.columns == want.columns
    assert joined.exceptAll(want).count() == want.exceptAll(joined).count() == 0


def tasks(df):
    """Rows per partition."""
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())


@pytest.fixture
def plain_shuffles(spark, no_broadcast):
    """Shuffle partitions as they are dealt, without adaptive splitting or merging."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_key_is_dealt_and_the_small_side_is_not_repeated(spark, skewed, plain_shuffles):
    df = skewed[1].filter(F.col("g").isNotNull())
    small = df.select("g").distinct().withColumn("w", F.lit(1))
    plain, dealt = tasks(df.join(small, "g")), tasks(salted_join(df, small, ["g"], "inner", ["id"], bits=6))
    assert plain[-1] > 3 * plain[len(plain) // 2]
    assert dealt[-1] < 2 * dealt[len(dealt) // 2]
    text = plan(salted_join(df, small, ["g"], "inner", ["id"]))  # nothing is hot at the normal size
    assert "__salt" not in text and "Generate" not in text


def test_hot_label_heads_are_dealt(spark, plain_shuffles):
    rng = random.Random(1)
    heads = ["prod_onsite_", "prod_", "test_eu_", "dev_"]
    rows = [
        (f"d{i % 50}", f"{'prod_onsite_' if i % 2 else rng.choice(heads)}2024-01-{i % 28 + 1:02}_{i}_daily", i)
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "dataset STRING, tag STRING, guid INT")
    wanted = labels.label_frame(spark, [Label("prod_", "onsite_", "_daily"), Label("prod_", "", "_daily"), Label("dev_", "", "_daily")])
    matched = labels.match_labels(df, wanted, bits=6)
    assert matched.exceptAll(labels.match_labels(df, wanted)).count() == 0
    sizes = tasks(matched)
    assert sum(sizes) > 2500 and len(sizes) >= 10 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


@pytest.mark.parametrize("name, scans, shuffles", [
    ("filter_rank_chain", 1, 1), ("filter_ranks", 1, 1), ("log_deltas", 1, 1), ("step_sizes", 2, 2),
    ("bookmark_targets", 2, 2), ("incremental_steps_long", 2, 2), ("trial_summary", 3, 10), ("compare_stats", 4, 5),
    ("replication_actions", 4, 5), ("tree_roots", 1, 2), ("tree_prune", 2, 3),
])
def test_rows_are_shuffled_once(spark, no_broadcast, name, scans, shuffles):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan parquet") <= scans and text.count("Exchange ") <= shuffles


# --- medians --------------------------------------------------------------------------------------------------------


def test_medians_are_exact_whatever_the_spread(spark):
    rng = random.Random(2)
    rows = []
    for i in range(9000):
        group = "hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 11}"
        a = rng.choice([rng.gauss(0, 1), 7.0, None]) if group != "g1" else None
        rows.append((group, 1, a, rng.random() * 1e-6 if i else 1e12))
    rows += [("two", 1, 1.0, 2.0), ("two", 1, 4.0, -1e12), ("one", 1, 5.0, None)]
    df = spark.createDataFrame(rows, "g STRING, h INT, a DOUBLE, b DOUBLE").repartition(5)

    def middle(values):
        values = sorted(v for v in values if v is not None)
        n = len(values)
        return values[(n - 1) // 2] * 0.5 + values[n // 2] * 0.5 if n else None

    for bits in (5, 18):
        got = summary.exact_medians(df, ["g", "h"], {"x": F.col("a"), "y": F.col("b")}, bits)
        want = {g: tuple(middle([r[c] for r in rows if r[0] == g]) for c in (2, 3)) for g in {r[0] for r in rows}}
        assert {r["g"]: (r["x"], r["y"]) for r in got.collect()} == want
    whole = summary.exact_medians(df, [], {"x": F.col("a")}).collect()
    assert [r["x"] for r in whole] == [middle([r[2] for r in rows])]


def test_brackets_hold_few_rows(spark):
    df = spark.range(200_000).select((F.rand(1) * F.when(F.col("id") == 0, 1e12).otherwise(1.0)).alias("v"))
    box = summary.median_brackets(df, [], {"v": F.col("v")}).first()
    inside = df.filter((F.col("v") >= box["__lo_v"]) & (F.col("v") <= box["__hi_v"])).count()
    assert 0 < inside < 0.02 * 200_000
