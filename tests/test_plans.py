"""Retention, replication, bookmark, property, monitor and schedule plans."""

import itertools

import pytest
from pyspark.sql import functions as F

from snapcat.operators.filters import RegexFilter, times_and_ranks
from snapcat.operators.labels import Label, literal_frame, minmax_by_label, without_snapshots
from snapcat.plans import bookmarks, monitor, policy, properties, replication, retention, schedule
from snapcat.plans.properties import PropertyGroup
from tests.conftest import snapshots, values

DAY = 86400


def dst_rows(spark, lines):
    return snapshots(spark, lines, "dst", "back/dst")


# --- retention ------------------------------------------------------------------------------------------------------


def test_delete_plans(spark):
    dst = dst_rows(spark, [(f"back/dst/a@{i}", f"g{i}", i, i, 0, "1" if i == 2 else "0") for i in range(6)] + [("back/dst/a#3", "g3", 3, 3)])
    src = snapshots(spark, [("tank/src/a@1", "g1", 1, 1), ("tank/src/a#4", "g4", 4, 4)])
    oldest = [[times_and_ranks("notime", "all except latest 1")]]
    assert values(retention.plan_deletes(dst, src, oldest, now=9), "tag") == ["0", "3"]
    assert values(retention.plan_deletes(dst, src, oldest, crosscheck=False, now=9), "tag") == ["0", "3", "4"]
    assert values(retention.plan_deletes(dst, None, oldest, now=9), "tag") == ["0", "1", "3", "4"]
    assert values(retention.plan_deletes(dst, src, [[]], kind="bookmark", now=9), "name") == ["back/dst/a#3"]
    found = retention.delete_summary(dst, retention.plan_deletes(dst, src, oldest, now=9)).first()
    assert (found["found"], found["deleted"]) == (7, 2)


def test_retention_plan(spark):
    now = 10 * DAY
    lines = [(f"back/dst/a@s1_onsite_2024-01-0{i}_secondly", f"s{i}", now - 100 + i, i) for i in (1, 2, 3)]
    lines += [(f"back/dst/a@s1_onsite_2024-01-0{i}_daily", f"d{i}", now - 200 + i, i + 3) for i in (1, 2, 3)]
    dst = dst_rows(spark, lines)
    plan = {"s1": {"onsite": {"secondly": 1, "hourly": 1, "minutely": 0}}}
    doomed = retention.plan_deletes_except(dst, None, plan, now)
    assert values(dst.join(doomed, "name", "left_anti"), "tag") == ["s1_onsite_2024-01-03_secondly"]
    # with a source only what is also there is kept
    assert retention.plan_deletes_except(dst, snapshots(spark, [("tank/src/a@x", "s2", 1, 1)]), plan, now).count() == 6
    with pytest.raises(ValueError, match="refusing"):
        retention.plan_deletes_except(dst, None, {"s1": {"onsite": {}}}, now)


def test_select_by_plan_time_part_and_empty_target(spark):
    now = 100 * DAY
    lines = [(f"tank/src/a@org_2024-01-{i:02d}_daily", f"g{i}", now - i * DAY, 50 - i) for i in range(10)]
    lines += [("tank/src/a@org_site_2024-01-01_daily", "x", now, 60)]
    src = snapshots(spark, lines)
    assert len(values(policy.select_by_plan(src, {"org": {"": {"daily": 3}}}, now), "tag")) == 4  # 0..3 days old
    assert values(policy.select_by_plan(src, {"org": {"site": {"daily": 1}}}, now), "guid") == ["x"]
    assert policy.select_by_plan(src, {"org": {"": {"daily": 0}}}, now).count() == 0
    assert policy.select_by_plan(src, {}, now).count() == 0


def test_prune_by_age(spark):
    rows = snapshots(spark, [(f"tank/src/a#{i}", f"g{i}", i * DAY, i) for i in range(6)])
    assert values(retention.prune_by_age(rows, 2, 3, 5 * DAY), "tag") == ["0", "1", "2"]
    assert values(retention.prune_by_age(rows, 4, 3, 5 * DAY), "tag") == ["0", "1"]
    assert values(retention.beyond_minimum(rows, 5), "tag") == ["0"]


# --- replication ----------------------------------------------------------------------------------------------------


def cands(spark, series, base="@"):
    """Rows of one dataset per series such as ``d1 h1 d2``; the first is the base, d rows are included."""
    rows = []
    for k, names in enumerate(series):
        for i, name in enumerate(names):
            sep = base if i == 0 else "@"
            rows.append((f"/{k}", f"tank{sep}{name}", f"{k}-{i}", i, i, name, "snapshot" if sep == "@" else "bookmark", name[0] == "d", i == 0, 1))
    schema = "rel_dataset STRING, name STRING, guid STRING, createtxg BIGINT, creation BIGINT, tag STRING, kind STRING, included BOOLEAN, is_base BOOLEAN, written BIGINT"
    return spark.createDataFrame(rows, schema)


def steps(df, **kwargs):
    found = replication.incremental_steps(df, bits=1, **kwargs).collect()
    return [
        (r["flag"], r["from_name"].removeprefix("tank"), r["to_name"].removeprefix("tank"))
        for r in sorted(found, key=lambda r: (r["rel_dataset"], r["to_createtxg"]))
    ]


def test_steps_worked(spark):
    assert steps(cands(spark, ["d1 h1 d2 d3 d4".split()])) == [("-i", "@d1", "@d2"), ("-I", "@d2", "@d4")]
    assert steps(cands(spark, ["h0 m0 d1 h1 d2 d3 d4".split()])) == [("-i", "@h0", "@d1"), ("-i", "@d1", "@d2"), ("-I", "@d2", "@d4")]
    assert steps(cands(spark, ["h0 m0".split()])) == []
    assert steps(cands(spark, ["d0 d1 d2 d3".split()])) == [("-I", "@d0", "@d3")]
    assert steps(cands(spark, ["d0 d1 d2 d3".split()], "#")) == [("-i", "#d0", "@d1"), ("-I", "@d1", "@d3")]
    assert steps(cands(spark, ["d0 d1 d2 d3".split()]), resume=True) == [("-i", "@d0", "@d1"), ("-I", "@d1", "@d3")]
    assert steps(cands(spark, ["d0 d1 d2".split()]), force_i=True) == [("-i", "@d0", "@d1"), ("-i", "@d1", "@d2")]


@pytest.mark.parametrize("base", ["@", "#"])
@pytest.mark.parametrize("resume", [False, True])
def test_steps_exhaustive(spark, base, resume):
    """All series of d and h rows up to length 7, each as its own dataset, against a walk over the rows."""
    series = [[c + str(i) for i, c in enumerate(letters)] for n in range(1, 8) for letters in itertools.product("dh", repeat=n)]
    want = {}
    for k, names in enumerate(series):
        plan, run = [], []  # run: rows sent in one step so far, led by where it starts
        at = 0
        for i in range(1, len(names)):
            if names[i][0] != "d":
                continue
            unbroken = at == i - 1 and names[at][0] == "d" and not (at == 0 and (base == "#" or resume))
            if unbroken and run and run[-1] == at and run[0][0] == "run":
                run.append(i)
            elif unbroken:
                run = [("run", at), i]
                plan.append(run)
            else:
                run = [("hop", at), i]
                plan.append(run)
            at = i
        for step in plan:
            flag = "-I" if len(step) > 2 else "-i"
            want.setdefault(f"/{k}", []).append((flag, step[0][1], step[-1], len(step) - 1))
    found = {}
    df = replication.incremental_steps(cands(spark, series, base), resume=resume, bits=1)
    for r in sorted(df.collect(), key=lambda r: r["to_createtxg"]):
        position = [int(r[c].removeprefix("tank")[2:]) for c in ("from_name", "to_name")]
        found.setdefault(r["rel_dataset"], []).append((r["flag"], *position, r["snapshots"]))
    assert found == want


def test_latest_common_and_candidates(spark):
    src = snapshots(spark, [("tank/src/a@d1", "1", 1, 1), ("tank/src/a@h1", "2", 2, 2), ("tank/src/a#h1", "2", 2, 2), ("tank/src/a@d2", "3", 3, 3)])
    dst = dst_rows(spark, [("back/dst/a@h1", "2", 2, 77)])
    common = replication.latest_common(src, dst)
    assert common.first()["base_name"] == "tank/src/a@h1"
    flagged = src.withColumn("included", F.col("tag").startswith("d"))
    since = replication.candidates_since(flagged, common)
    assert values(since, "name") == ["tank/src/a@d2", "tank/src/a@h1"]
    assert replication.incremental_steps(since).first()["to_name"] == "tank/src/a@d2"
    assert replication.no_stream_steps(since).first()["from_name"] == "tank/src/a@h1"
    # only the bookmark is left on the source
    gone = replication.latest_common(src.filter("name != 'tank/src/a@h1'"), dst)
    assert gone.first()["base_name"] == "tank/src/a#h1"


ACTIONS = {
    "/new": ([("@d1", "1")], []),
    "/same": ([("@d1", "1")], [("@d1", "1")]),
    "/behind": ([("@d1", "1"), ("@d2", "2")], [("@d1", "1")]),
    "/ahead": ([("@d1", "1"), ("@d2", "2")], [("@d1", "1"), ("@x", "9")]),
    "/alien": ([("@d1", "1")], [("@x", "9")]),
    "/none": ([("@h1", "1")], []),
    "/only_bookmark": ([("@h1", "1"), ("#d0", "0")], [("@d0", "0")]),
    "/unselected_base": ([("@d1", "1"), ("@h2", "2")], [("@h2", "2")]),
}


@pytest.mark.parametrize(("force", "expected"), [(False, {}), (True, {"/ahead": "incremental", "/alien": "full"})])
def test_actions(spark, force, expected):
    def side(index, root):
        return [(root + rel + name, guid, i, i) for rel, pair in ACTIONS.items() for i, (name, guid) in enumerate(pair[index])]

    src, dst = snapshots(spark, side(0, "tank/src")), dst_rows(spark, side(1, "back/dst"))
    plan = replication.replication_action(src, dst, [[RegexFilter(("d.*",))]], force=force, now=9)
    want = {"/new": "full", "/same": "up-to-date", "/behind": "incremental", "/ahead": "conflict", "/alien": "conflict", "/none": "skip",
            "/only_bookmark": "up-to-date", "/unselected_base": "incremental"} | expected
    rows = {r["rel_dataset"]: r for r in plan.collect()}
    assert {k: r["action"] for k, r in rows.items()} == want
    assert rows["/ahead"]["rollback_to"] == "back/dst/ahead@d1" and rows["/behind"]["rollback_to"] is None
    assert replication.full_sends(plan).filter("rel_dataset = '/new'").first()["to_name"] == "tank/src/new@d1"


def test_step_sizes_and_bookmarks(spark):
    df = cands(spark, ["d0 d1 h1 d2 d3".split(), "d0 d1".split()])
    sized = replication.mark_last_step(replication.step_sizes(replication.incremental_steps(df, bits=1), bits=1))
    assert values(sized, "rel_dataset", "to_createtxg", "done_bytes", "total_bytes", "is_last") == [
        ("/0", 1, 0, 3, False), ("/0", 3, 1, 3, False), ("/0", 4, 2, 3, True), ("/1", 1, 0, 1, True),
    ]
    tagged = df.withColumn("tag", F.when(F.col("tag") == "d1", "x_hourly").otherwise("x_minutely"))
    assert values(replication.rows_to_bookmark(tagged, "hourly"), "name") == ["tank@d1", "tank@d1", "tank@d3"]
    assert replication.rows_to_bookmark(tagged, "none").count() == 0 and replication.rows_to_bookmark(tagged, "all").count() == 4
    total = replication.replication_summary(replication.incremental_steps(df, bits=1), 2_000_000_000).first()
    assert (total["snapshots"], total["bytes"], total["bytes_per_second"]) == (4, 4, 2)
    assert total["text"] == "sent 4 snapshots in 2s, 4 B [2 B/s]"


def test_bookmark_plan(spark, one):
    suffix = one(bookmarks.destination_suffix("15813919022682057", "back/dst/a"))
    name = one(bookmarks.tmp_bookmark_name(F.lit("tank/src/a"), F.lit("o_t_hourly"), F.lit("5"), F.lit(suffix)))
    lines = [(name, "5", 1, 1), (name.replace("o_t", "o_u"), "6", 1, 1), ("tank/src/a#.TMP.o_hourly.AAAAAAAAAAc.p.d", "7", 1, 1)]
    marks, dst = snapshots(spark, lines), dst_rows(spark, [("back/dst/a@o_t_hourly", "5", 1, 1), ("back/dst/a@z", "7", 1, 1)])
    plan = bookmarks.bookmark_plan(marks, dst, F.lit(suffix))
    assert values(plan.filter("action = 'promote'"), "to_name") == ["tank/src/a#o_t_5_hourly"]
    assert plan.filter("action = 'delete'").count() == 2
    done = marks.unionByName(snapshots(spark, [("tank/src/a#o_t_5_hourly", "5", 1, 1)]))
    assert bookmarks.bookmark_plan(done, dst, F.lit(suffix)).filter("action = 'promote'").count() == 0


def test_property_plan(spark):
    rows = [("fs", p, "v", "local", False) for p in ("atime", "volsize", "compression", "org:x", "quota")]
    rows += [("vol", p, "v", "local", True) for p in ("atime", "compression")] + [("vol", "sync", "v", "inherited", True)]
    props = spark.createDataFrame(rows, "dataset STRING, property STRING, value STRING, source STRING, is_volume BOOLEAN")
    groups = [PropertyGroup("-o", properties.COPIED_BY_DEFAULT + ("volsize",)), PropertyGroup("-x", ("quota|compression",), targets=("full",)), PropertyGroup("set", ("org:.*",))]
    plan = properties.property_plan(props, groups, full=True, explicit_options=["compression"], explicit_excludes=["mounted"])
    assert values(plan, "dataset", "option", "property") == [
        ("fs", "-o", "atime"), ("fs", "-x", "mounted"), ("fs", "-x", "quota"), ("fs", "set", "org:x"), ("vol", "-x", "mounted"),
    ]
    later = properties.property_plan(props, groups, full=False)
    assert values(later, "dataset", "option", "property") == [
        ("fs", "-o", "atime"), ("fs", "-o", "compression"), ("fs", "set", "org:x"), ("vol", "-o", "compression"),
    ]


# --- series, alerts, schedule ---------------------------------------------------------------------------------------

SERIES = [Label("org_", "", "_hourly"), Label("org_", "us-west-1_", "_hourly")]


def series_rows(spark):
    return snapshots(spark, [
        ("tank/ds1@org_2023-01-01_00:00:00_hourly", "1", 100, 1), ("tank/ds1@org_2024-01-01_00:00:00_hourly", "2", 200, 2),
        ("tank/ds2@unrelated_snap", "3", 150, 1),
        ("tank/ds4@org_us-west-1_2023-01-01_00:00:00_hourly", "4", 100, 1, 0, "1"),
        ("tank/ds4@org_us-west-1_2024-01-01_00:00:00_hourly", "5", 150, 2), ("tank/ds4@org_us-west-1_2025-01-01_00:00:00_hourly", "6", 200, 3),
    ], root="tank")


def four(spark):
    return spark.createDataFrame([(f"tank/ds{i}",) for i in (1, 2, 3, 4)], "dataset STRING")


def test_minmax(spark):
    best = minmax_by_label(series_rows(spark), four(spark), SERIES)
    got = {(r["dataset"][-3:], r["infix"]): (r["latest_creation"], r["oldest_creation"]) for r in best.collect()}
    assert got == {
        ("ds1", ""): (200, 100), ("ds1", "us-west-1_"): (0, 0), ("ds2", ""): (0, 0), ("ds2", "us-west-1_"): (0, 0),
        ("ds3", ""): (0, 0), ("ds3", "us-west-1_"): (0, 0), ("ds4", ""): (0, 0), ("ds4", "us-west-1_"): (200, 100),
    }
    held = minmax_by_label(series_rows(spark), four(spark), SERIES, skip_holds=[False, True])
    row = held.filter("dataset = 'tank/ds4' AND infix != ''").first()
    assert (row["latest_creation"], row["oldest_creation"]) == (200, 150)
    assert values(without_snapshots(four(spark), series_rows(spark)), "dataset") == ["tank/ds3"]


def test_monitor(spark):
    plan_rows = spark.createDataFrame([("org", "", "hourly", 2), ("org", "us-west-1", "hourly", 3)], "org STRING, target STRING, period STRING, amount INT")
    limits = spark.createDataFrame(
        [("org", "", "hourly", "10 seconds", "20seconds", None), ("org", "us-west-1", "hourly", "1 secs", "0 secs", 1)],
        "org STRING, target STRING, period STRING, warning STRING, critical STRING, src_snapshot_cycles INT",
    )
    alerts = monitor.build_alerts(limits, plan_rows)
    got = {(r["infix"], r["which"]): (r["warning_ms"], r["critical_ms"]) for r in alerts.collect()}
    assert got == {("", "latest"): (3610000, 3620000), ("", "oldest"): (7210000, 7220000),
                   ("us-west-1_", "latest"): (3601000, None), ("us-west-1_", "oldest"): (3601000, None)}
    now = 3811
    rows = monitor.monitor(minmax_by_label(series_rows(spark), four(spark), SERIES), alerts, now)
    picked = {(r["dataset"][-3:], r["infix"], r["which"]): r for r in rows.collect()}
    assert picked["ds1", "", "latest"]["level"] == 1  # age 3611 s
    assert picked["ds1", "", "oldest"]["level"] == 0
    assert picked["ds3", "", "latest"]["message"] == "No snapshot exists for tank/ds3@org_<timestamp>_hourly"
    assert picked["ds1", "", "latest"]["message"] == (
        "Latest snapshot for tank/ds1@org_<timestamp>_hourly is 1h old but should be at most 1h old: @org_2024-01-01_00:00:00_hourly"
    )
    worst = monitor.worst_alert(rows, rows.filter("level = 0")).first()
    assert (worst["code"], worst["kind"]) == (2, "Latest")
    quiet = monitor.monitor(minmax_by_label(series_rows(spark), four(spark), SERIES), alerts, now, dont_warn=True, dont_crit=True)
    assert monitor.worst_alert(quiet).first().asDict() == {"code": 0, "kind": "", "message": ""}


def test_due(spark):
    hour = 3600
    rows = snapshots(spark, [("tank/a@org_2024_hourly", "1", 4 * hour, 1), ("tank/b@org_2024_hourly", "2", 5 * hour, 1)], root="tank")
    sets = spark.createDataFrame([("tank/a",), ("tank/b",), ("tank/c",)], "dataset STRING")
    plan = {"org": {"": {"hourly": 1, "adhoc": 1}}}
    due = schedule.due_from_catalog(rows, sets, plan, 5 * hour + 1800)
    assert values(due.filter("due"), "dataset", "suffix") == [
        ("tank/a", "_adhoc"), ("tank/a", "_hourly"), ("tank/b", "_adhoc"), ("tank/c", "_adhoc"), ("tank/c", "_hourly"),
    ]
    assert schedule.work_list(due).first()["suffix"] == "_hourly"
    assert schedule.schedule_report(due.filter("suffix = '_hourly' AND dataset = 'tank/b'")).first()["remark"] == ""
    assert schedule.due_from_catalog(rows, sets, plan, 5 * hour, always=True).filter("due").count() == 6
    with pytest.raises(ValueError, match="divide"):
        schedule.due_from_catalog(rows, sets, {"org": {"": {"7hourly": 1}}}, 0)
    labels = policy.order_labels(policy.plan_frame(rows, {"o": {"": {"hourly": 1, "daily": 1, "monthly": 1}}}))
    assert [r["suffix"] for r in labels.collect()] == ["_monthly", "_daily", "_hourly"]


def test_monitor_rows_have_own_limits_and_holds(spark):
    plan = {"prod": {"onsite": {"hourly": {"latest": {"warning": "1 hours"}, "oldest": {"critical": "2 hours", "cycles": 3, "oldest_skip_holds": True}}}}}
    rows = monitor.monitor_plan_rows(plan)
    alerts = monitor.alerts_of_rows(literal_frame(spark, rows, monitor.PLAN_ROW_TYPES))
    hour = 3_600_000
    assert values(alerts, "which", "warning_ms", "critical_ms", "skip_holds") == [("latest", 2 * hour, None, False), ("oldest", None, 5 * hour, True)]
    for broken in ({"newest": {}}, {"latest": {"oldest_skip_holds": True}}, {"oldest": {"oldest_skip_holds": 1}}, {"latest": {"limit": 1}}):
        with pytest.raises(ValueError, match="no such check"):
            monitor.monitor_plan_rows({"o": {"t": {"hourly": broken}}})
    now = 100 * 3600
    label = Label("prod_", "onsite_", "_hourly")
    snaps = snapshots(spark, [("tank/a@prod_onsite_x_hourly", "g", now - 9 * 3600, 1, 0, 1), ("tank/a@prod_onsite_y_hourly", "h", now - 3600, 2, 0, 0)])
    found = minmax_by_label(snaps, spark.createDataFrame([("tank/a",), ("tank/b",)], "dataset STRING"), [label], free=True)
    got = monitor.monitor(found, alerts, now)
    assert values(got, "dataset", "which", "age_ms", "level") == [
        ("tank/a", "latest", hour, 0), ("tank/a", "oldest", hour, 0), ("tank/b", "latest", now * 1000, 1), ("tank/b", "oldest", now * 1000, 2)
    ]


def test_policy_collisions(spark):
    rows = [("h", "back/x", "a", True), ("h", "back/x", "a", True), ("h", "back/x", "b", True), ("h", "back/y", "c", True), ("h", "back/y", "d", False)]
    df = spark.createDataFrame(rows, "dst_host STRING, dst_dataset STRING, dataset STRING, replicate BOOLEAN")
    assert values(policy.policy_collisions(df), "dst_dataset", "sources", "first_dataset") == [("back/x", 2, "a")]
