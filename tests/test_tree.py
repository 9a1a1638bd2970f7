"""Tree operators on worked cases and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from snapcat.operators import tree
from tests.conftest import values


def frame(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "dataset STRING")


def test_roots(spark):
    assert values(tree.tree_roots(frame(spark, "a", "a-b", "a/b", "c/d/e", "c/d")), "dataset") == ["a", "a-b", "c/d"]
    assert values(tree.minimal_roots(frame(spark, "x/y", "x/y/z", "x/y")), "dataset") == ["x/y"]


def test_recursive(spark):
    """A root counts only if nothing of its subtree was left out."""
    fleet = ["eu", "eu/db", "eu/db/log", "eu/web", "us", "us/web"]
    basis = frame(spark, *fleet)
    for left_out, roots in [
        ((), ["eu", "us"]),
        (("eu/web",), []),
        (("eu",), ["eu/db", "eu/web", "us"]),
        (("eu", "eu/db/log"), []),
        (("eu", "us", "eu/db"), ["eu/db/log", "eu/web", "us/web"]),
    ]:
        selected = frame(spark, *[n for n in fleet if n not in left_out])
        assert values(tree.recursive_roots(selected, basis), "dataset") == roots


def test_deletable(spark):
    """What the source no longer has, unless something below it has to stay."""
    rng = random.Random(11)
    names = sorted({"/".join(["b", *(rng.choice("uvw") for _ in range(rng.randrange(1, 5)))]) for _ in range(90)})
    on_source = {n for n in names if rng.random() < 0.25}
    selected = {n for n in names if rng.random() < 0.85}
    wanted = {n for n in selected - on_source if all(m in selected for m in names if m.startswith(n + "/"))}
    src = frame(spark, *["a" + n[1:] for n in on_source])
    got = tree.deletable_datasets(frame(spark, *names), frame(spark, *selected), src, "a", "b")
    assert set(values(got, "dataset")) == wanted and wanted


def test_orphans(spark):
    basis = frame(spark, "d", "d/a", "d/a/b", "d/c")
    snaps = spark.createDataFrame([("d/a/b", "bookmark"), ("d/c", "snapshot")], "dataset STRING, kind STRING")
    assert values(tree.orphan_datasets(basis, basis, snaps), "dataset") == ["d/a", "d/a/b"]
    assert values(tree.orphan_datasets(basis, basis, snaps, with_bookmarks=True), "dataset") == []


def test_missing_and_complete(spark):
    assert values(tree.missing_ancestors(frame(spark, "a/b/c/d"), frame(spark, "a", "a/b")), "dataset") == ["a/b/c"]
    assert values(tree.complete_tree(frame(spark, "a/b", "c")), "dataset") == ["a", "a/b", "c"]


def test_random_trees(spark):
    rng = random.Random(3)
    names = {"/".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(150)}
    flagged = set(rng.sample(sorted(names), 12))
    below = {n for n in names if any(n == f or n.startswith(f + "/") for f in flagged)}
    df, marks = frame(spark, *names), frame(spark, *flagged)
    assert set(values(tree.prune_subtrees(df, marks), "dataset")) == names - below
    assert set(values(tree.prune_subtrees(df, marks, keep=True), "dataset")) == below
    roots = {n for n in names if not any(n.startswith(m + "/") for m in names)}
    assert set(values(tree.tree_roots(df), "dataset")) == roots


@pytest.mark.parametrize("bits", [0, 3, 18])
def test_parts_of_a_large_pool(spark, bits):
    """All paths in one pool, which is cut into parts; names with characters around the slash, repeats and nulls."""
    rng = random.Random(8)
    names = ["/".join(["p", *(rng.choice(["a", "a-b", "a b", "a0", "b"]) for _ in range(rng.randrange(5)))]) for _ in range(200)]
    flagged = rng.sample(names, 6)
    below = lambda n, tops: any(n == t or n.startswith(t + "/") for t in tops)
    df = spark.createDataFrame([(n, i) for i, n in enumerate([*names, None])], "dataset STRING, i INT").repartition(3)
    marks = frame(spark, *flagged, "q", "p/a/")
    kept = tree.prune_subtrees(df, marks, bits=bits)
    assert kept.columns == ["dataset", "i"]
    assert sorted(r["i"] for r in kept.collect()) == [*(i for i, n in enumerate(names) if not below(n, flagged)), 200]
    inside = tree.prune_subtrees(df, marks, keep=True, bits=bits)
    assert values(inside, "i") == [i for i, n in enumerate(names) if below(n, flagged)]
    some = df.filter("dataset <> 'p'")
    rest = {n for n in names if n != "p"}
    roots = [i for i, n in enumerate(names) if n != "p" and not any(n.startswith(m + "/") for m in rest)]
    assert values(tree.tree_roots(some, bits), "i") == roots
    assert values(tree.recursive_roots(some, some, bits), "dataset") == sorted({names[i] for i in roots})
    last = max(rest, key=len)
    assert values(tree.recursive_roots(some.filter(F.col("dataset") != last), some, bits), "dataset") == []
