"""Refresh state, summaries, readers, writers and transfer logs."""

import pytest
from pyspark.sql import functions as F

from snapcat.functions.sizes import line_bytes
from snapcat.operators import compare, logs, state, summary
from snapcat.sources import readers, writers
from tests.conftest import snapshots, values

STATE = "namespace STRING, dataset STRING, family STRING, label_key STRING, created BIGINT, changed BIGINT"


def rows(spark, *lines):
    return spark.createDataFrame([("s", *line) for line in lines], STATE)


def live(spark, **changed):
    return spark.createDataFrame(list(changed.items()), "dataset STRING, changed BIGINT")


def test_schedule_hits(spark):
    known = rows(
        spark,
        ("a", "dataset", "", 0, 100), ("a", "label", "x", 90, 100), ("a", "label", "y", 100, 100),
        ("b", "dataset", "", 0, 100), ("b", "label", "x", 90, 100),  # a label is missing
        ("c", "dataset", "", 0, 99), ("c", "label", "x", 90, 99), ("c", "label", "y", 90, 99),  # changed since
        ("d", "dataset", "", 0, 100), ("d", "label", "x", 0, 100), ("d", "label", "y", 90, 100),  # unknown creation
        ("e", "dataset", "", 0, 100), ("e", "label", "x", 101, 100), ("e", "label", "y", 90, 100),  # implausible
    )
    labels = spark.createDataFrame([("x",), ("y",)], "label_key STRING")
    now = live(spark, a=100, b=100, c=100, d=100, e=100)
    hits = state.schedule_hits(now, known, labels, 102.0)
    assert values(hits, "dataset", "label_key", "created") == [("a", "x", 90), ("a", "y", 100)]
    assert values(state.stale_datasets(now, hits, expected=2), "dataset") == ["b", "c", "d", "e"]
    assert state.schedule_hits(now, known, labels, 101.0).count() == 0  # too fresh to trust
    named = state.schedule_hits(now, known, ["x", "y", "x"], 102.0)
    assert values(named, "dataset", "label_key", "created") == [("a", "x", 90), ("a", "y", 100)]
    stored = [state.store_buckets(df, "part", 3) for df in (now, known)]
    assert sorted(state.schedule_hits(*stored, ["x", "y"], 102.0).collect()) == sorted(hits.collect())
    ratio = state.hit_ratio(now, state.stale_datasets(now, hits)).first()
    assert (ratio["hit_text"], ratio["miss_text"]) == ("1/5=20%", "4/5=80%")


def test_state_of_an_earlier_run_stays_readable(spark):
    first = state.store_buckets(rows(spark, ("a", "dataset", "", 1, 10)), "state", 2)
    second = state.store_buckets(state.merge_state(first, rows(spark, ("a", "dataset", "", 2, 11))), "state", 2)
    assert (values(first, "changed"), values(second, "changed")) == ([10], [11])
    none = state.store_buckets(rows(spark), "state", 2)
    assert state.merge_state(none, rows(spark)).count() == 0


def test_merge_invalidate(spark):
    old = rows(spark, ("a", "dataset", "", 1, 10), ("b", "dataset", "", 1, 10), ("c", "dataset", "", 1, 10), ("c", "label", "x", 1, 10))
    new = rows(spark, ("a", "dataset", "", 2, 9), ("b", "dataset", "", 2, 10), ("c", "dataset", "", 0, 0), ("d", "dataset", "", 0, 0), ("e", "label", "y", 3, 0))
    merged = state.merge_state(old, new)
    assert values(merged, "dataset", "family", "created", "changed") == [
        ("a", "dataset", 1, 10), ("b", "dataset", 2, 10), ("c", "dataset", 0, 0), ("c", "label", 1, 10), ("e", "label", 3, 0),
    ]
    wrong = state.mismatched(live(spark, b=10, c=11), old)
    assert values(wrong, "dataset") == ["c"]
    assert values(state.invalidate(old, wrong), "dataset", "family", "changed")[2:] == [("c", "dataset", 0), ("c", "label", 0)]


def test_trusted_prefix(spark):
    df = spark.createDataFrame([("b", i, i in (3, 5)) for i in range(7)] + [("c", 0, False)], "batch STRING, seq INT, bad BOOLEAN")
    assert values(state.trusted_prefix(df, "batch", "seq", F.col("bad")), "batch", "seq") == [("b", 0), ("b", 1), ("b", 2), ("c", 0)]


@pytest.mark.parametrize(("codes", "worst"), [((7, 9), 9), ((0, 4), 4), ((4, 1), 1), ((2, 1), 2), ((2, 3), 3), ((None, 2), 3), ((0,), 0)])
def test_worst_status(spark, codes, worst):
    df = spark.createDataFrame([(c,) for c in codes], "code INT")
    assert summary.worst_status(df).first()["code"] == worst


def test_job_summary(spark):
    df = spark.createDataFrame([(True, True, False, 10), (True, True, True, 20), (True, False, False, 0), (False, False, False, 0)],
                               "started BOOLEAN, completed BOOLEAN, failed BOOLEAN, elapsed_nanos BIGINT")
    row = summary.job_summary(df).first()
    assert (row["started_text"], row["completed_text"], row["failed_text"], row["running"], row["mean_text"]) == ("3/4=75%", "2/4=50%", "1/4=25%", 1, "15ns")


def test_readers(spark, tmp_path):
    (tmp_path / "snaps.tsv").write_text("100\tg1\t1\t-\ttank/src/a@x\t1\n100\t18446744073709551615\t1\t5\ttank/src/a/b#y\n")
    snaps = readers.read_snapshots(spark, str(tmp_path / "snaps.tsv"), "src", "tank/src")
    assert values(snaps, "rel_dataset", "kind", "tag", "guid", "held") == [("/a", "snapshot", "x", "g1", True), ("/a/b", "bookmark", "y", "18446744073709551615", False)]
    assert snaps.first()["written"] is None
    (tmp_path / "sets.tsv").write_text("7\t-\t131072\ttank/src/a\n-\t8192\t-\ttank/src/v\n")
    sets = readers.read_datasets(spark, str(tmp_path / "sets.tsv"), "src", "tank/src")
    assert values(sets, "rel_dataset", "recordsize", "is_volume", "snapshots_changed") == [("/a", 131072, False, 7), ("/v", -8192, True, 0)]
    (tmp_path / "pairs").write_text("# comment\n\ntank/a\tback/a\ttail\n")
    assert values(readers.read_root_pairs(spark, str(tmp_path / "pairs")), "src_root", "dst_root") == [("tank/a", "back/a\ttail")]
    (tmp_path / "broken").write_text("tank/a\n")
    with pytest.raises(Exception, match="tab-separated"):
        readers.read_root_pairs(spark, str(tmp_path / "broken")).collect()
    for ask in (lambda d: d.select("dst_root").collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="tab-separated"):
            ask(readers.read_root_pairs(spark, str(tmp_path / "broken")))
    (tmp_path / "odd.tsv").write_text("1\tg\t2\t3\ttank/src/a@x\nwhat is this\nx\tg\t1\t2\ttank/src@b\t0\n5\tg\t6\t-\t-\n")
    with pytest.raises(Exception, match="malformed line"):
        readers.read_snapshots(spark, str(tmp_path / "odd.tsv"), "src", "tank/src").collect()
    odd = readers.read_snapshots(spark, str(tmp_path / "odd.tsv"), "src", "tank/src", rejects=True)
    assert [r["line"].split("\t")[0] for r in odd.collect()] == ["what is this", "x", "5"]
    (tmp_path / "props").write_text("tank/a\tatime\ton\tlocal\ntank/a\tsync\tx\tinherited\n")
    assert values(readers.read_properties(spark, str(tmp_path / "props"), ["local"]), "property") == ["atime"]


def test_writers(spark, tmp_path):
    src = snapshots(spark, [(f"tank/src/a@{i}", f"g{i}", 50 - i, i, None if i == 3 else i) for i in range(50)])
    cmp = compare.compare_catalogs(src, snapshots(spark, [], "dst", "back/dst"))
    writers.write_comparison(cmp, str(tmp_path / "cmp"))
    lines = []
    for part in sorted((tmp_path / "cmp").glob("part-*")):
        head, *body = part.read_text().splitlines()
        assert head.split("\t")[:3] == ["location", "creation_iso", "createtxg"]
        lines += body
    creations = [int(line.split("\t")[8]) for line in lines]
    assert creations == sorted(creations) and len(creations) == 50
    assert sum(line.endswith("\t-") for line in lines) == 1
    sets = spark.createDataFrame([("/a", "tank/src/a")], "rel_dataset STRING, dataset STRING")
    writers.write_dataset_map(compare.compare_datasets(sets, sets.limit(0)), str(tmp_path / "map"))
    text = "".join(p.read_text() for p in (tmp_path / "map").glob("part-*"))
    assert "src\t/a\ttank/src/a\t\n" in text


def test_log_files(spark, tmp_path):
    log = tmp_path / "x.pv"
    log.write_bytes(b": 800B foo")
    assert values(logs.transfer_bytes(readers.read_transfer_logs(spark, str(log))), "bytes") == [800]
    (tmp_path / "x.pv_001").write_bytes(
        b"1 KB\r\n2 KiB:20 KB\r3 KiB:300 KB\r\n4 KiB:4000 KB\r4 KiB:50000 KB\r4 KiB:600000 KB\r"
    )
    (tmp_path / "x.pv.other").write_bytes(b"9: 9 GB\n")
    transfers = readers.read_transfer_logs(spark, str(log))
    total = logs.transfer_bytes(transfers).agg(F.sum("bytes")).first()[0]
    assert total == 800 + 300 * 1000 + 600000 * 1000
    deltas = logs.transfer_deltas(transfers)
    assert deltas.agg(F.sum("delta")).first()[0] == total
    assert "Exchange" not in deltas._jdf.queryExecution().executedPlan().toString()


def line_table(spark):
    lines = [("a", 0, "x: 10 B", "\r"), ("a", 1, "x: 30 B", "\r"), ("a", 2, "x: 35 B", "\n"), ("a", 3, "x: 5 B", "\r"), ("b", 0, "x: 7 B", "\n")]
    return spark.createDataFrame([(f, s, line, t, i) for i, (f, s, line, t) in enumerate(lines)], "file STRING, seq BIGINT, line STRING, terminator STRING, second BIGINT")


def test_log_lines(spark):
    log = line_table(spark)
    assert values(logs.bytes_delta(log, bits=1), "file", "seq", "delta") == [("a", 0, 10), ("a", 1, 20), ("a", 2, 5), ("a", 3, 5), ("b", 0, 7)]
    assert values(logs.bytes_transferred(log), "file", "bytes") == [("a", 40), ("b", 7)]
    rate = logs.sliding_rate(logs.bytes_delta(log).withColumn("job", F.lit(1)), window=2)
    assert values(rate, "second", "bytes", "elapsed", "rate") == [(0, 10, 1, 10), (1, 30, 2, 15), (2, 25, 2, 12), (3, 10, 2, 5), (4, 12, 2, 6)]
    assert values(log.withColumn("b", line_bytes(F.col("line"))), "b") == [5, 7, 10, 30, 35]
