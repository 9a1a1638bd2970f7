"""Log lines over split borders, hosts on both sides, and rates that grow from batch to batch."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleet_queries import details
from fleet_queries.base import QUERIES
from fleet_queries.logs import log_lines
from snapcat.operators import filters, logs, ordered
from snapcat.plans import policy
from snapcat.sources import readers
from snapcat.streaming import progress
from tests.conftest import values


@pytest.mark.parametrize("bits", [3, 18])
def test_a_long_transfer_is_read_by_many_tasks(spark, tmp_path, bits):
    sizes = [7 * i + i % 5 for i in range(1500)]
    text = "\r".join(f"x: {n} B" for n in sizes) + "\r" + "x: 20000 B\n" + "y: 4 B\ry: 9 B\rz: 1 B\nz: 2 B\n\nw: 6 B\r"
    (tmp_path / "log").write_bytes(text.encode())
    (tmp_path / "log_1").write_bytes(b"v: 3 B\rv: 8 B")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = readers.read_log_lines(spark, str(tmp_path / "log"))
        assert rows.rdd.getNumPartitions() >= 6
        assert rows.agg(F.max(F.length("line"))).first()[0] <= 12
        got = logs.bytes_delta(rows.drop("value"), bits=bits).orderBy("file", "seq").collect()
        per_file = dict(map(tuple, logs.bytes_transferred(rows).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = defaultdict(list)
    for r in got:
        by_file[r["file"].rsplit("/", 1)[-1]].append((r["line"], r["terminator"], int(r["delta"])))
    steps = [b - a for a, b in zip([0, *sizes], [*sizes, 20000])]
    assert [d for *_, d in by_file["log"][:1501]] == steps
    assert by_file["log"][1500:] == [
        ("x: 20000 B", "\n", 20000 - sizes[-1]), ("y: 4 B", "\r", 4), ("y: 9 B", "\r", 5), ("z: 1 B", "\n", -8),
        ("z: 2 B", "\n", 2), ("w: 6 B", "\r", 6),
    ]
    assert by_file["log_1"] == [("v: 3 B", "\r", 3), ("v: 8 B", "\r", 5)]
    assert sorted(int(b) for b in per_file.values()) == [8, 20000 + 1 + 2 + 6]


@pytest.mark.parametrize("bits", [1, 18])
def test_hosts_on_both_sides(spark, bits):
    pairs = spark.createDataFrame([(1, "tank/a", "in"), (1, "tank/b", "b"), (1, "tank/a", "in")], "job INT, src_root STRING, dst_root STRING")
    src_hosts = spark.createDataFrame([(1, "s1"), (1, "s2"), (1, "s1"), (2, "s3")], "job INT, src_host STRING")
    held = [("s1", "tank/a", "tank/a/x"), ("s2", "tank/a", "tank/a/x"), ("s2", "tank/b", "tank/b"), ("s3", "tank/a", "tank/a")]
    datasets = spark.createDataFrame(held, "src_host STRING, root STRING, dataset STRING")
    hosts = spark.createDataFrame([(1, "d1", "on"), (1, "d2", "on"), (1, "d3", "off")], "job INT, dst_host STRING, target STRING")
    roots = spark.createDataFrame([("d1", "^DST_HOST/of_^SRC_HOST"), ("d2", "")], "dst_host STRING, root STRING")
    plan = spark.createDataFrame([(1, "o", "on", "daily", 3), (1, "o", "off", "daily", 0)], "job INT, org STRING, target STRING, period STRING, amount INT")
    got = policy.expand_hosts(datasets, src_hosts, hosts, roots, hosts.filter("dst_host = 'd1'"), pairs, plan, bits)
    assert values(got, "src_host", "dataset", "dst_host", "dst_dataset", "retain") == [
        ("s1", "tank/a/x", "d1", "d1/of_s1/in/x", True), ("s1", "tank/a/x", "d2", "in/x", False),
        ("s2", "tank/a/x", "d1", "d1/of_s2/in/x", True), ("s2", "tank/a/x", "d2", "in/x", False),
        ("s2", "tank/b", "d1", "d1/of_s2/b", True), ("s2", "tank/b", "d2", "b", False),
    ]
    # without the source host in a root, two sources end up in one place
    assert values(policy.policy_collisions(got), "dst_host", "dst_dataset", "sources") == [("d2", "in/x", 2)]


def test_hosts_are_dealt_by_the_rows_they_make(spark):
    """Source and destination hosts by the dozen: rows are dealt over tasks by what the join makes, and counted there."""
    src = [(j, f"s{i}") for j in (1, 2) for i in range(3)]
    held = [(f"s{i % 3}", f"tank/{i % 2}", f"tank/{i % 2}/x{i}") for i in range(60)] + [("s0", "tank/0", "tank/0/x0")]
    src_hosts = spark.createDataFrame(src, "job INT, src_host STRING")
    datasets = spark.createDataFrame(held, "src_host STRING, root STRING, dataset STRING")
    pairs = spark.createDataFrame([(j, f"tank/{k}", f"in{k}") for j in (1, 2) for k in (0, 1)], "job INT, src_root STRING, dst_root STRING")
    hosts = spark.createDataFrame([(1 + i % 2, f"d{i}", "on") for i in range(24)], "job INT, dst_host STRING, target STRING")
    # two roots for a host, none for another
    roots = spark.createDataFrame([(f"d{i}", "^SRC_HOST" if i % 3 else "") for i in [0, *range(23)]], "dst_host STRING, root STRING")
    plan = spark.createDataFrame([(j, "o", "on", p, 3) for j in (1, 2) for p in ("daily", "weekly")], "job INT, org STRING, target STRING, period STRING, amount INT")
    expand = lambda **how: policy.expand_hosts(datasets, src_hosts, hosts, roots, hosts.filter("dst_host < 'd2'"), pairs, plan, **how)
    whole, dealt = expand(), expand(part="part", rows=50)
    want = Counter(map(tuple, whole.collect()))
    assert Counter(map(tuple, dealt.drop("part").collect())) == want and sum(want.values()) == 61 * 25 * 2
    assert Counter(map(tuple, expand(bits=1, rows=50).collect())) == want
    by = ["job", "src_host", "dst_host", "part"]
    assert dealt.select("part").distinct().count() > 4 and dealt.select(*by).distinct().count() == 72
    counted = dealt.groupBy(*by).agg(F.count_distinct("dst_dataset"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString().split("Join")[0]


def test_logs_of_many_users_share_files(spark, tmp_path, monkeypatch):
    events = spark.range(2000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "IF(id % 401 = 0, NULL, id % 400) AS user_id",
        "IF(id % 7 = 0, 'error', 'view') AS event_type", "IF(id % 50 = 1, NULL, id / 3) AS value", """concat('{"k": ', id % 100, '}') AS props""",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(details, "folder", lambda _, name: str(tmp_path / name))
    got = [tuple(r) for r in QUERIES["source_log_lines"](spark, str(tmp_path)).collect()]
    assert len(list((tmp_path / "log-lines").glob("**/*.txt"))) <= 8
    lines = log_lines(spark.read.parquet(str(tmp_path / "events.parquet"))).filter("line IS NOT NULL")
    want = [(r["file"], int(r["bytes"]), int(r["delta"])) for r in logs.bytes_delta(lines).collect()]
    assert Counter(got) == Counter(want) and None in {f for f, *_ in got}


@pytest.mark.parametrize("held, rows, bits", [(1 << 13, 1 << 20, 18), (4, 50, 18), (4, 50, 1)])
def test_hosts_are_grouped_in_the_order_they_are_made(spark, held, rows, bits):
    """Places are counted without a shuffle, sort or hash table of the rows, also where roots of a host share places."""
    held_there = [("s0", "t", n and f"t/{n}") for n in [*"abcdefgh", "in/a", "in/s0/a", "in/in/a", "s0/a", "in/b", "a", "a", None]]
    src_hosts = spark.createDataFrame([(1, "s0"), (2, "s0"), (1, "s1")], "job INT, src_host STRING")
    datasets = spark.createDataFrame([*held_there, ("s1", "t", "t/a")], "src_host STRING, root STRING, dataset STRING")
    pairs = spark.createDataFrame([(1, "t", "in"), (2, "t", "")], "job INT, src_root STRING, dst_root STRING")
    hosts = spark.createDataFrame([(j, f"d{i}", "on") for j in (1, 2) for i in range(9)], "job INT, dst_host STRING, target STRING")
    named = [(f"d{i}", r) for i in range(8) for r in ["", "in", "in/^SRC_HOST", "in/in", "x", None][: i % 7]]
    roots = spark.createDataFrame([*named, ("d1", ""), ("d3", "in")], "dst_host STRING, root STRING")
    plan = spark.createDataFrame([(j, o, "on", "daily", 3) for j in (1, 2) for o in "op"], "job INT, org STRING, target STRING, period STRING, amount INT")
    how = {"bits": bits, "part": "part", "rows": rows, "place": "place", "held": held}
    made = policy.expand_hosts(datasets, src_hosts, hosts, roots, hosts.filter("dst_host < 'd2'"), pairs, plan, **how)
    streamed = made.groupBy("part", "place_host").agg(
        F.bitmap_count(F.bitmap_construct_agg("place")).alias("n"), F.count(F.lit(1)).alias("rows"), F.min("dst_dataset").alias("least")
    )
    after_join = streamed._jdf.queryExecution().executedPlan().toString().split("ShuffledHashJoin")[0]
    assert bits == 1 or "SortAggregate" in after_join and not any(x in after_join for x in ("Exchange", "HashAggregate", "Sort ["))
    host = [F.col(f"place_host.{c}").alias(c) for c in policy.HOST]
    got = streamed.groupBy(*host).agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.min("least").alias("least"))
    want = made.groupBy(*policy.HOST).agg(
        F.count_distinct("dst_dataset").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("dst_dataset").alias("least")
    )
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() == 27
    # some places are shared by roots, so numbers alone are too many
    assert made.filter("place IS NULL AND dst_dataset IS NOT NULL").count() > 0
    assert (made.filter("job = 1 AND src_host = 's0'").select("part").distinct().count() > 1) == (held == 4)


def test_names_are_numbered_below_the_size_of_a_bitmap(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BITMAP_BITS", 8)
    rows = [(k, f"n{i % 50}") for k in (1, 2) for i in range(70)] + [(1, None)]
    got = ordered.number_names(spark.createDataFrame(rows, "k INT, name STRING"), ["k"], "name", "chunk", "number", 30).collect()
    assert len(got) == 141 and all((r.name is None) == (r.number is None) and (r.number or 0) < 8 for r in got)
    named = {(r.k, r.name): (r.k, r.chunk, r.number) for r in got if r.name}
    assert len(set(named.values())) == len(named) == 100 == len({(*named[r.k, r.name], r.name) for r in got if r.name})


def test_rates_take_late_samples_and_open_windows(spark, tmp_path):
    batches = [[(0, 10), (2, 20)], [(3, 5), (1, 7)], [(50, 1), (2, 4)], [(51, 2), (1, 1000)]]  # the last sample is too late
    schema = "seconds BIGINT, delta BIGINT"

    def start():
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        rows = feed.select(F.timestamp_seconds("seconds").alias("ts"), "delta")
        writer = progress.stream_rate_table(rows, str(tmp_path / "rates"), "2 seconds", "1 second", "10 seconds")
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    kept = defaultdict(int)
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start()
        for second, delta in batch:
            if delta < 1000:
                for first in (second - 1, second):
                    kept[first] += delta
        got = progress.current_rates(spark, str(tmp_path / "rates"))
        found = values(got.select(F.unix_seconds("start").alias("s"), F.col("bytes").cast("bigint"), "bytes_per_second"), "s", "bytes", "bytes_per_second")
        assert found == sorted((s, n, n / 2) for s, n in kept.items()), i


def test_property_names_are_filtered(spark):
    rows = spark.createDataFrame([("d", "org:a"), ("d", "quota"), ("e", "org:b")], "dataset STRING, property STRING")
    assert values(filters.filter_properties(rows, ["org:.*"], [".*b"]), "dataset", "property") == [("d", "org:a")]
