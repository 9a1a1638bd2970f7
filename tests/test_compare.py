"""Catalog comparison on worked cases."""

from snapcat.operators import compare
from snapcat.operators.filters import RegexFilter
from tests.conftest import snapshots, values

SRC = [
    ("tank/src/bar@snapBar", "g4", 400, 4, 4000),
    ("tank/src/foo@snapA", "g1", 100, 1, 1000),
    ("tank/src/foo@snapB", "g2", 200, 2, 2000),
    ("tank/src/foo#snapB", "g2", 200, 2),
]
DST = [
    ("back/dst/baz@snapBaz", "g5", 500, 5, 5000),
    ("back/dst/foo@snapA", "g1", 100, 1, 1500),
    ("back/dst/foo@snapC", "g3", 300, 3, 3000),
]


def both(spark, src=SRC, dst=DST, **kwargs):
    return compare.compare_catalogs(
        snapshots(spark, src), snapshots(spark, dst, "dst", "back/dst"), **kwargs
    )


def found(cmp):
    return values(cmp, "location", "rel_name")


def test_rows(spark):
    cmp = both(spark)
    assert found(cmp) == [("all", "/foo@snapA"), ("dst", "/baz@snapBaz"), ("dst", "/foo@snapC"), ("src", "/bar@snapBar"), ("src", "/foo@snapB")]
    common = cmp.filter("location = 'all'").first()
    assert (common["written"], common["root_dataset"], common["creation_iso"]) == (1000, "tank/src", "1970-01-01_00:01:40+00:00")
    assert compare.comparison_columns(cmp).columns[0] == "location" and len(compare.comparison_columns(cmp).columns) == 10
    assert [r["rel_name"] for r in compare.order_comparison(cmp).collect()][0] == "/bar@snapBar"


def test_choice_of_locations(spark):
    assert found(both(spark, locations=["src", "all"])) == [("all", "/foo@snapA"), ("src", "/bar@snapBar"), ("src", "/foo@snapB")]


def test_renamed_twin_shows_the_source_name(spark):
    cmp = both(spark, [("tank/src/a@old", "g1", 1, 1)], [("back/dst/a@new", "g1", 1, 9)])
    assert found(cmp) == [("all", "/a@old")]


def test_temporary_bookmarks(spark):
    tmp = ("tank/src/a#.TMP.x.c.p.d", "g1", 1, 1)
    assert found(both(spark, [tmp], [("back/dst/a@x", "g1", 1, 1)])) == [("all", "/a#.TMP.x.c.p.d")]
    assert found(both(spark, [tmp], [("back/dst/b@x", "g2", 1, 1)])) == [("dst", "/b@x")]
    # the filtered snapshot must not come back through its temporary bookmark
    twin = [("tank/src/a@x_hourly", "g1", 1, 1), tmp]
    dst = [("back/dst/a@y_daily", "g1", 1, 1)]
    assert found(both(spark, twin, dst, groups=[[RegexFilter((".*daily",))]], now=9)) == [("dst", "/a@y_daily")]


def test_stats_and_verdict(spark):
    cmp = both(spark)
    names = spark.createDataFrame([("/foo",), ("/bar",), ("/baz",), ("/empty",)], "rel_dataset STRING")
    stats = {(r["rel_dataset"], r["location"]): r for r in compare.comparison_stats(cmp, 1000, names).collect()}
    assert len(stats) == 12
    row = stats["/foo", "src"]
    assert (row["snapshots"], row["sum_written"], row["snapshots_since"], row["written_since"]) == (1, 2000, 1, 2000)
    assert (row["common_minus_latest"], row["latest_age"]) == (-100, 800)
    assert stats["/foo", "dst"]["written_since"] == 3000 and stats["/foo", "all"]["snapshots_since"] is None
    assert stats["/bar", "src"]["snapshots_since"] is None  # nothing in common
    assert stats["/empty", "all"]["snapshots"] == 0
    report = compare.comparison_report(compare.comparison_stats(cmp, 1000, names))
    row = report.filter("rel_dataset = '/foo' AND location = 'src'").first()
    assert (row["data_written"], row["latest_age"], row["common_minus_latest"]) == ("1.95 KiB", "13.3m", "-1.67m")
    assert report.filter("rel_dataset = '/empty'").first()["latest_snapshot"] == "n/a"
    assert dict(values(compare.sync_verdict(cmp), "rel_dataset", "in_sync")) == {"/foo": False, "/bar": False, "/baz": False}
    synced = both(spark, [("tank/src/a@x", "g", 1, 1)], [("back/dst/a@x", "g", 1, 1)])
    assert compare.sync_verdict(synced).first()["in_sync"] is True
    assert compare.sync_verdict(synced, ["src"]).first()["in_sync"] is None


def test_since_common_counts_rows_after_the_newest_common(spark):
    src = [(f"tank/src/a@{i}", f"g{i}", i, i, 10) for i in range(6)]
    dst = [(f"back/dst/a@{i}", f"g{i}", i, i, 10) for i in (1, 3)]
    since = compare.since_common(both(spark, src, dst))
    assert values(since.filter("since_common"), "rel_name") == ["/a@4", "/a@5"]


def test_dataset_map(spark):
    src = spark.createDataFrame([("/bar", "s/bar"), ("/foo", "s/foo")], "rel_dataset STRING, dataset STRING")
    dst = spark.createDataFrame([("/baz", "d/baz"), ("/foo", "d/foo")], "rel_dataset STRING, dataset STRING")
    assert values(compare.compare_datasets(src, dst), "location", "rel_dataset", "src_dataset", "dst_dataset") == [
        ("all", "/foo", "s/foo", "d/foo"), ("dst", "/baz", "", "d/baz"), ("src", "/bar", "s/bar", ""),
    ]


def test_a_hot_guid_is_combined_before_the_shuffle(spark):
    """A third of all rows are copies of one bookmark."""
    rows = [(f"tank/src/a#copy{i}", "hot", 5, 5) for i in range(100)] + [(f"tank/src/a@{i}", f"g{i}", i, i) for i in range(200)]
    one = compare.dedupe_bookmarks(snapshots(spark, rows))
    assert one.count() == 201
    assert one.filter("guid = 'hot'").first()["name"] == "tank/src/a#copy0"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
