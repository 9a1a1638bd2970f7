"""Rounding up to period boundaries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from snapcat.functions.periods import Anchors, round_up, unix_from_wall, wall_from_unix


def at(text):
    return datetime.fromisoformat(text)


CASES = [
    # hourly on the day's grid
    ("2024-11-05 14:00:00", 1, "hourly", {}, "2024-11-05 14:00:00"),
    ("2024-11-05 14:05:01", 1, "hourly", {}, "2024-11-05 15:00:00"),
    ("2024-11-05 23:55:01", 1, "hourly", {}, "2024-11-06 00:00:00"),
    ("2024-11-05 14:05:01", 2, "hourly", {}, "2024-11-05 16:00:00"),
    ("2024-11-05 16:05:01", 2, "hourly", {}, "2024-11-05 18:00:00"),
    ("2024-11-05 00:10:00", 1, "hourly", {"hourly_minute": 15}, "2024-11-05 00:15:00"),
    ("2024-11-05 14:05:01", 0, "hourly", {}, "2024-11-05 14:05:01"),
    ("2024-11-05 14:05:01.000001", 1, "secondly", {}, "2024-11-05 14:05:02"),
    ("2024-11-05 14:05:01.000001", 250, "millisecondly", {}, "2024-11-05 14:05:01.250000"),
    ("2024-11-05 14:05:01", 10, "minutely", {"minutely_second": 30}, "2024-11-05 14:10:30"),
    ("2024-11-05 14:05:01", 1, "daily", {"daily_hour": 4}, "2024-11-06 04:00:00"),
    ("2024-11-05 14:05:01", 1, "weekly", {}, "2024-11-10 00:00:00"),  # Sunday
    ("2024-11-05 14:05:01", 1, "weekly", {"weekly_weekday": 2, "weekly_hour": 15}, "2024-11-05 15:00:00"),
    # months: the day is cut to the length of the months passed and stays cut
    ("2025-02-15 10:00:00", 1, "monthly", {"monthly_monthday": 31, "monthly_hour": 12}, "2025-02-28 12:00:00"),
    ("2025-01-15 10:00:00", 1, "monthly", {"monthly_month": 3}, "2025-02-01 00:00:00"),
    ("2025-03-15 10:00:00", 2, "monthly", {"monthly_month": 4, "monthly_monthday": 2}, "2025-04-02 00:00:00"),
    ("2025-12-15 10:00:00", 2, "monthly", {"monthly_month": 4, "monthly_monthday": 2}, "2026-02-02 00:00:00"),
    ("2025-11-05 10:00:00", 3, "monthly", {}, "2026-01-01 00:00:00"),
    ("2025-01-15 10:00:00", 1, "monthly", {"monthly_month": 2, "monthly_monthday": 31, "monthly_hour": 12}, "2025-01-28 12:00:00"),
    ("2024-01-15 10:00:00", 1, "monthly", {"monthly_month": 2, "monthly_monthday": 29, "monthly_hour": 12}, "2024-01-29 12:00:00"),
    ("2025-04-10 09:00:00", 3, "monthly", {"monthly_monthday": 31}, "2025-04-30 00:00:00"),
    ("2025-04-30 00:00:00", 3, "monthly", {"monthly_monthday": 31}, "2025-04-30 00:00:00"),
    ("2025-03-10 10:00:00", 3, "monthly", {"monthly_monthday": 15}, "2025-04-15 00:00:00"),
    ("2025-03-03 12:00:00", 1, "monthly", {"monthly_month": 9, "monthly_monthday": 10}, "2025-03-10 00:00:00"),
    ("2024-03-01 10:00:00", 1, "monthly", {"monthly_month": 2, "monthly_monthday": 31}, "2024-03-29 00:00:00"),
    ("2025-05-15 10:00:00", 14, "monthly", {}, "2026-03-01 00:00:00"),
    ("2025-11-30 02:00:00.000001", 2, "monthly", {"monthly_month": 11, "monthly_monthday": 30, "monthly_hour": 2}, "2026-01-30 02:00:00"),
    # years
    ("2025-01-01 00:00:01", 3, "yearly", {"yearly_year": 2025}, "2028-01-01 00:00:00"),
    ("2025-03-01 10:00:00", 1, "yearly", {"yearly_month": 2, "yearly_monthday": 29}, "2026-02-28 00:00:00"),
    ("2028-01-15 10:00:00", 1, "yearly", {"yearly_month": 2, "yearly_monthday": 29}, "2028-02-29 00:00:00"),
    ("2028-03-01 10:00:00", 1, "yearly", {"yearly_month": 2, "yearly_monthday": 29}, "2029-02-28 00:00:00"),
    ("2024-05-15 10:00:00", 2, "yearly", {"yearly_year": 2051}, "2025-01-01 00:00:00"),
    ("2024-05-15 10:00:00", 2, "yearly", {"yearly_year": 2050}, "2026-01-01 00:00:00"),
]


def test_worked_cases(spark):
    frames = None
    for i, (when, amount, unit, anchors, _) in enumerate(CASES):
        row = spark.range(1).select(
            F.lit(i).alias("i"), round_up(F.lit(when).cast("timestamp_ntz"), amount, unit, Anchors(**anchors)).alias("r")
        )
        frames = row if frames is None else frames.union(row)
    got = {row["i"]: row["r"] for row in frames.collect()}
    assert [got[i] for i in range(len(CASES))] == [at(case[4]) for case in CASES]


def test_unit_column_and_unknown_unit(spark):
    rows = [("2025-02-20 10:00:00", 3, "monthly"), ("2025-02-20 10:00:00", 2, "daily"), ("2025-02-20 10:00:00", 1, "adhoc"), ("2025-02-20 10:00:00", 0, "")]
    df = spark.createDataFrame(rows, "ts STRING, n INT, unit STRING")
    got = [r["r"] for r in df.select(round_up(F.col("ts").cast("timestamp_ntz"), F.col("n"), F.col("unit")).alias("r")).collect()]
    assert got == [at("2025-04-01"), at("2025-02-22"), None, at("2025-02-20 10:00:00")]
    with pytest.raises(ValueError, match="unknown"):
        round_up(F.lit("2025-01-01").cast("timestamp_ntz"), 1, "adhoc")


def test_daily_against_enumeration(spark):
    """Anchored days: the boundary is the first anchor time at or after the moment that lies on the period grid."""
    start = datetime(2024, 2, 27)
    moments = [start + timedelta(minutes=97 * i) for i in range(120)]
    df = spark.createDataFrame([(m,) for m in moments], "ts TIMESTAMP_NTZ")
    got = [r["r"] for r in df.select(round_up(F.col("ts"), 1, "daily", Anchors(daily_hour=4, daily_minute=30)).alias("r")).collect()]
    grid = [datetime(2024, 2, 26, 4, 30) + timedelta(days=d) for d in range(30)]
    assert got == [min(g for g in grid if g >= m) for m in moments]


def test_zones(spark, one):
    # summer time began 2024-03-31 01:00 UTC: wall clock 03:00 in Berlin
    assert one(wall_from_unix(F.lit(1711846800), "Europe/Berlin")) == at("2024-03-31 03:00:00")
    assert one(wall_from_unix(F.lit(1711846800), "+05:30")) == at("2024-03-31 06:30:00")
    assert one(unix_from_wall(wall_from_unix(F.lit(1711846801), "Europe/Berlin"), "Europe/Berlin")) == 1711846801
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(wall_from_unix(F.lit(1711846800))) == at("2024-03-31 01:00:00")
        assert one(round_up(wall_from_unix(F.lit(1711846801)), 1, "daily")) == at("2024-04-01")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
