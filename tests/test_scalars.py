"""Expressions on worked values."""

import pytest
from pyspark.sql import functions as F

from snapcat.functions import hashing, human, names, periods, regexes, sizes


def column_of(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [row["r"] for row in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_human_float(spark):
    numbers = [3.14159, 5.0, 0.5, 0.499999, 1.999999, 12.34, 12.0, 12.56, 123.456, 123.516, 999.99, 0.0, -0.001, 100.0, 20.5, 10.25]
    assert column_of(spark, numbers, human.human_float, "DOUBLE") == (
        ["3.14", "5", "0.5", "0.5", "2", "12.3", "12", "12.6", "123", "124", "1000", "0", "0", "100", "20.5", "10.2"]
    )


def test_human_bytes(spark):
    sizes_in = [0.0, 580.608, 2048.0, 1024.0**2, 1024.0**8, 1024.0**10, 1024.0**11, -2048.0]
    assert column_of(spark, sizes_in, human.human_bytes, "DOUBLE") == (
        ["0 B", "581 B", "2 KiB", "1 MiB", "1 YiB", "1 QiB", "1024 QiB", "-2 KiB"]
    )
    assert column_of(spark, [2.567], lambda c: human.human_bytes(c, precision=1), "DOUBLE") == ["2.6 B"]


@pytest.mark.parametrize(
    ("unit", "pairs"),
    [
        ("ns", [(0, "0ns"), (3, "3ns"), (3e3, "3μs"), (1e9, "1s"), (1.8e11, "3m"), (1.08e14, "1.25d"), (125e9, "2.08m"), (0.3, "0.3ns")]),
        ("s", [(0, "0s"), (3, "3s"), (180, "3m"), (0.3, "300ms"), (-604800, "-7d")]),
        ("h", [(0, "0h"), (180, "7.5d"), (0.3, "18m")]),
        ("d", [(0.3, "7.2h"), (3e-12, "259ns"), (3e-15, "0.26ns"), (2.0, "2d")]),
    ],
)
def test_human_duration(spark, unit, pairs):
    given = [float(v) for v, _ in pairs]
    assert column_of(spark, given, lambda c: human.human_duration(c, unit), "DOUBLE") == [text for _, text in pairs]


def test_percent_and_clock(one):
    assert one(human.percent(F.lit(3), F.lit(10))) == "3=30%"
    assert one(human.percent(F.lit(0), F.lit(0), True)) == "0/0=inf%"
    assert one(human.hms(F.lit(3_723_999_999_999))) == "1:02:03"
    assert one(human.bytes_and_rate(F.lit(44_774_035_456), F.lit(46_000_000_000))["rate"]) == "[928.26 MiB/s]"


def test_sizes(spark, one):
    given = ["950B tail", "16b", "7.25 KiB", "12,5GiB", "12٫5GiB", "3 MB", "24 Gib", "40 Gb", "2 EiB", "5 ZiB", "3 QiB", "1.5 YB", "tail", "12-5GiB"]
    expected = [950, 2, 7424, 13421772800, 13421772800, 3 * 10**6, 3 * 1024**3, 5 * 10**9, 2 * 1024**6, 5 * 1024**7, 3 * 1024**10, round(1.5 * 1000**8), 0, 0]
    assert [int(v) for v in column_of(spark, given, sizes.size_to_bytes)] == expected
    with pytest.raises(Exception, match="Invalid size"):
        one(sizes.size_to_bytes(F.lit("7.25 KiB/s")))
    assert one(sizes.size_to_bytes(F.lit("7.25 KiB/s"), strict=False)) is None


def test_sizes_of_every_unit(spark, one):
    """What Python's floats give, digit by digit, with fractions and long numbers in every unit."""
    given, expected = [], []
    for number in ("0.5", "1.23456", "987.654321", "123456789012345678", "9223372036854775808"):
        for i, unit in enumerate(["", *"KMGTPEZYRQ"]):
            for binary in ("", "i"):
                value = round(float(number) * (1024 if binary else 1000) ** i)
                if value < 10**38:
                    given.append(f"{number} {unit}{binary}B")
                    expected.append(value)
    assert [int(v) for v in column_of(spark, given, sizes.size_to_bytes)] == expected
    with pytest.raises(Exception, match="38 digits"):
        one(sizes.size_to_bytes(F.lit("123456789012345678 QB")))


def test_rates_in_the_place_of_a_size(spark, one):
    lines = ["x: 12 B/s [>]", "x: 20 EiB", "no size", "x: 5 B ETA 1:00:00 ETA"]
    df = spark.createDataFrame([(v,) for v in lines], "line STRING")
    assert [r["line"] for r in sizes.rate_lines(df).collect()] == lines[:1]
    got = [r["bytes"] for r in sizes.with_line_bytes(df, strict=False).collect()]
    assert got == [None, 20 * 1024**6, 0, 5]
    with pytest.raises(Exception, match="Invalid size"):
        sizes.with_line_bytes(df).collect()


PROGRESS = [
    ("vault: 3,5GiB 0:00:21 [77,4MiB/s] [ 140MiB/s] [#...]  7% ETA 0:11:09 ETA 08:30:00", round(3.5 * 2**30), 669, "[#...]  7% ETA 0:11:09 ETA 08:30:00"),
    ("vault/ 1 B/ full: 40.25GiB 0:31:02 [ 22MiB/s] [ 24MiB/s] [##..] 61% ETA 3+1:02:03 ETA 08:30:00", round(40.25 * 2**30), 262923, "[##..] 61% ETA 3+1:02:03 ETA 08:30:00"),
    ("vault: 40.25GiB 0:31:02 ( 22MiB/s) ( 24MiB/s) [##..] ETA 2:04:05:06 ETA 2031-02-03 04:05:06", round(40.25 * 2**30), 187506, "[##..] ETA 2:04:05:06 ETA 2031-02-03 04:05:06"),
    ("vault: 64,5GiB 0:50:00 [ 22MiB/s] [ 22MiB/s] [####] 100%             ETA 08:30:00", round(64.5 * 2**30), 0, "[####] 100%             ETA 08:30:00"),
    ("vault: 3.5GiB[ #        ]  7% ETA 0:11:09 ETA 08:30:00", round(3.5 * 2**30), 669, "[ #        ]  7% ETA 0:11:09 ETA 08:30:00"),
    ("words only", 0, 0, ""),
    ("half: q", 0, 0, ""),
]


@pytest.mark.parametrize("end", ["", "\n", "\r", "\r\n"])
def test_progress_lines(spark, end):
    df = spark.createDataFrame([(i, row[0] + end) for i, row in enumerate(PROGRESS)], "i INT, line STRING")
    want = [row[1:] for row in PROGRESS]
    parsed = df.select("i", sizes.parse_progress(F.col("line")).alias("p")).orderBy("i").collect()
    assert [tuple(row["p"]) for row in parsed] == want
    staged = sizes.with_progress(df).orderBy("i").collect()
    assert [(r["bytes"], r["remaining_seconds"], r["tail"]) for r in staged] == want


def test_guids(spark):
    decimals = ["15813919022682057", "0", "18446744073709551615", "2406491805272097867"]
    compact = column_of(spark, decimals, hashing.compact_guid)
    assert compact[0] == "ADgurPHaj8k"
    assert all(len(c) == 11 and "_" not in c for c in compact)
    assert column_of(spark, compact, hashing.decimal_guid) == decimals


def test_bookmark_names(one):
    name = "tank/a#.TMP.org_us-west_2024-11-06_08:30:05_hourly.ADgurPHaj8k.AAAfaLnRWNQ.mjKQwJEMnjk"
    assert one(names.final_bookmark_name(F.lit(name))) == "tank/a#org_us-west_2024-11-06_08:30:05_15813919022682057_hourly"
    assert one(names.final_bookmark_name(F.lit("tank/a#.TMP.x.y.ADgurPHaj8k.p.d"))) == "tank/a#x.y_15813919022682057"


def test_names(spark, one):
    assert tuple(one(names.split_name(F.lit("a/b@t#x@y")))) == ("a/b", "@", "t#x@y")
    assert one(names.ancestors(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"]
    assert one(names.ancestors(F.lit("a"), proper=True)) == []
    assert one(names.is_descendant(F.lit("a-b"), "a")) is False
    assert column_of(spark, ["", "-", "0", "1", None], names.is_held) == [False, False, False, True, False]
    given = ["tank/a", "a b", "", ".", "..", "/a", "a/", "a//b", "a/./b", "a/../b", "./a", "a/..", "a@b", "a\tb", "1a", "é", "a\\b"]
    good = {"tank/a", "a b", "é"}
    assert column_of(spark, given, names.valid_dataset_name) == [g in good for g in given]
    assert one(names.valid_label(F.lit("a_"), F.lit(""), F.lit("_daily"))) is True
    assert one(names.valid_label(F.lit("a_b_"), F.lit(""), F.lit("_daily"))) is False
    assert one(names.sanitize_key(F.lit("a b..c/d\\e,f"))) == "a!b!c!d!e!f"
    assert one(names.render_label(F.lit("o_"), F.lit(""), F.expr("TIMESTAMP'2024-01-02 03:04:05.678'"), F.lit("_d"), "yyyyxx", True)).endswith(".678_d")


def test_periods(spark, one):
    given = ["10minutely", "hourly", "0hourly", "junk", "", "01daily"]
    parsed = column_of(spark, given, periods.period_parse)
    assert [tuple(p) for p in parsed] == [(10, "minutely"), (1, "hourly"), (0, ""), (0, ""), (0, ""), (0, "")]
    assert column_of(spark, ["a_2daily", "a_b", "daily", "x_monthly"], periods.label_millis) == [172800000, 0, 0, 2635200000]
    assert column_of(spark, ["2 hours", "3years", "x", "5mins", "7 millis"], periods.duration_millis) == [7200000, 3 * 31536000000, None, 300000, 7]
    with pytest.raises(Exception, match="Invalid duration"):
        one(periods.duration_millis(F.lit("2 lightyears"), strict=True))
    assert one(periods.iso_from_unix(F.lit(1730878205))) == "2024-11-06_07:30:05+00:00"
    isos = ["2024-11-06_07:30:05+00:00", "2024-11-06T07:30:05Z", "2024-11-06 08:30:05+01:00", "2024-11-06"]
    assert column_of(spark, isos, periods.unix_from_iso) == [1730878205] * 3 + [1730851200]


def test_regex_lists(spark):
    tags = ["a_daily", "a_hourly", "b_daily", "a_daily\n"]

    def picked(include, exclude=()):
        return [t for t, r in zip(tags, column_of(spark, tags, lambda c: regexes.regex_included(c, include, exclude))) if r]

    assert picked(["a_.*"]) == ["a_daily", "a_hourly"]
    assert picked([".*daily", "(?P<x>a)_h.*"]) == ["a_daily", "a_hourly", "b_daily"]
    assert picked([".*"], ["a.*"]) == ["b_daily", "a_daily\n"]  # a dot does not match a newline
    assert picked(["!a.*"]) == ["b_daily", "a_daily\n"]
    assert picked([".*"], ["!.*daily"]) == ["a_daily", "b_daily"]
    assert picked([]) == [] and picked([".*"], [".*"]) == []
    assert regexes.with_descendants(["a$", "!b", ".*"]) == ["a(?:/.*)?", "!b(?:/.*)?", ".*"]
    with pytest.raises(ValueError, match="end"):
        regexes.with_descendants(["a$b"])
