"""Physical plans: what is pushed down, how often rows are shuffled, and that nothing is crossed or collected."""

import pytest

from __spark_entry__ import oracle_sql, queries
from fleet_queries.base import QUERIES, SQL, catalog, table
from snapcat.operators import compare, filters
from snapcat.operators.filters import times_and_ranks
from snapcat.plans import policy, replication

SF = "/root/testdata/sf0.001"
# the broadcast side of a nested loop is one row: a count, or the label limits
ONE_ROW_SIDES = {"tree_recursive"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith("stream_")])
def test_no_cross_joins(spark, name):
    text = plan(queries()[name](spark, SF))
    assert "CartesianProduct" not in text
    if name not in ONE_ROW_SIDES:
        assert "BroadcastNestedLoopJoin" not in text


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_comparison_shuffles_each_side_once(spark):
    cmp = compare.compare_catalogs(catalog(spark, SF, "src"), catalog(spark, SF, "dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(cmp).count("Exchange hashpartitioning") == 2  # the aggregation's partitioning serves the join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_time_filters_reach_the_scan(spark, tmp_path):
    catalog(spark, SF, "src").write.parquet(str(tmp_path / "cat"))
    rows = spark.read.parquet(str(tmp_path / "cat"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan(filters.filter_time(rows, 1704067200, 1705000000, now=0).select("guid"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(creation,1704067200)" in text and "LessThan(creation,1705000000)" in text
    assert "EqualTo(kind,snapshot)" in text
    assert "ReadSchema: struct<kind:string,guid:string,creation:bigint>" in text


def test_rank_filters_of_all_groups_share_a_scan(spark):
    one = [[times_and_ranks("notime", "latest 3")]]
    many = one + [[times_and_ranks("notime", f"oldest {i}%")] for i in (5, 10, 20)]
    rows = catalog(spark, SF, "src")
    shuffles = [plan(filters.select_snapshots(rows, groups, now=0)).count("Exchange") for groups in (one, many)]
    assert shuffles[0] == shuffles[1]


def test_plan_selection_cuts_before_the_shuffle(spark):
    text = plan(policy.select_by_plan(catalog(spark, SF, "src"), {"prod": {"onsite": {"daily": 5}}}, 1706659200))
    assert "WindowGroupLimit" in text


def test_common_base_joins_on_dataset_and_guid(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(replication.latest_common(catalog(spark, SF, "src"), catalog(spark, SF, "dst")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [rel_dataset" in text and "LeftSemi" in text


def test_column_pruning(spark):
    text = plan(table(spark, SF, "lineitem").groupBy("l_returnflag").count())
    assert "ReadSchema: struct<l_returnflag:string>" in text


@pytest.mark.parametrize(("name", "shuffles"), [("state_schedule_hits", 0), ("state_stale", 0), ("state_hit_ratio", 1), ("state_invalidate", 0)])
def test_state_in_buckets_is_not_shuffled(spark, name, shuffles):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange ") == shuffles  # the one sums counts
