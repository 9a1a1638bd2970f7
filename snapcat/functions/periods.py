"""Periods, durations and calendar rounding.

Rounding works on the wall clock (TIMESTAMP_NTZ), never on epoch seconds, so an hour or day boundary is one of the
zone's own clock.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds per period unit and per duration unit (a month is 30.5 days, a year 365).
PERIOD_MILLIS = {
    "yearly": 31_536_000_000,
    "monthly": 2_635_200_000,
    "weekly": 604_800_000,
    "daily": 86_400_000,
    "hourly": 3_600_000,
    "minutely": 60_000,
    "secondly": 1_000,
    "millisecondly": 1,
}
DURATION_MILLIS = {
    "milliseconds": 1,
    "millis": 1,
    "seconds": 1_000,
    "secs": 1_000,
    "minutes": 60_000,
    "mins": 60_000,
    "hours": 3_600_000,
    "days": 86_400_000,
    "weeks": 604_800_000,
    "months": 2_635_200_000,
    "years": 31_536_000_000,
}
PERIOD_PATTERN = "([1-9][0-9]*)?(" + "|".join(PERIOD_MILLIS) + ")"
DURATION_PATTERN = r"(\d+)\s*(" + "|".join(DURATION_MILLIS) + ")"

DAY = 86_400_000_000  # microseconds
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@dataclass(frozen=True)
class Anchors:
    """Where periods start: daily at 04:30, weekly on a weekday (0 = Sunday), and so on."""

    yearly_year: int = 2025
    yearly_month: int = 1
    yearly_monthday: int = 1
    yearly_hour: int = 0
    yearly_minute: int = 0
    yearly_second: int = 0
    monthly_month: int = 1
    monthly_monthday: int = 1
    monthly_hour: int = 0
    monthly_minute: int = 0
    monthly_second: int = 0
    weekly_weekday: int = 0
    weekly_hour: int = 0
    weekly_minute: int = 0
    weekly_second: int = 0
    daily_hour: int = 0
    daily_minute: int = 0
    daily_second: int = 0
    hourly_minute: int = 0
    hourly_second: int = 0
    minutely_second: int = 0
    secondly_millisecond: int = 0
    millisecondly_microsecond: int = 0


def _lookup(key: Column, table: dict[str, int]) -> Column:
    result = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for name, value in table.items():
        result = result.when(key == name, F.lit(value).cast("bigint"))
    return result


def unit_millis(unit: Column) -> Column:
    """Milliseconds of a period unit, null for anything else."""
    return _lookup(unit, PERIOD_MILLIS)


def period_parse(period: Column) -> Column:
    """``10minutely`` -> {10, minutely}, ``hourly`` -> {1, hourly}, anything else -> {0, ''}."""
    known = period.rlike(rf"\A{PERIOD_PATTERN}\z")
    amount = F.regexp_extract(period, rf"\A{PERIOD_PATTERN}\z", 1)
    unit = F.regexp_extract(period, rf"\A{PERIOD_PATTERN}\z", 2)
    return F.struct(
        F.when(~known, 0).when(amount == "", 1).otherwise(amount.cast("int")).alias("amount"),
        F.when(known, unit).otherwise("").alias("unit"),
    )


def label_millis(name: Column) -> Column:
    """Period length in the last ``_`` part of a name, 0 if there is none."""
    last = F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", -1)).otherwise("")
    parsed = period_parse(last)
    return F.coalesce(parsed["amount"].cast("bigint") * unit_millis(parsed["unit"]), F.lit(0).cast("bigint"))


def duration_millis(duration: Column, strict: bool = False) -> Column:
    """``2 hours`` -> 7200000. Bad input is null, or an error with ``strict``."""
    quantity = F.regexp_extract(duration, rf"\A{DURATION_PATTERN}\z", 1)
    unit = F.regexp_extract(duration, rf"\A{DURATION_PATTERN}\z", 2)
    millis = F.when(quantity != "", quantity.cast("bigint") * _lookup(unit, DURATION_MILLIS))
    if not strict:
        return millis
    message = F.concat(F.lit("Invalid duration format: "), duration)
    return F.when(duration.isNull() | (quantity != ""), millis).otherwise(F.raise_error(message).cast("bigint"))


# --- instants and wall clock -------------------------------------------------------------------------------------


def ntz_from_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)")
    return F.expr(EPOCH_NTZ) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def micros_from_ntz(when: Column) -> Column:
    """Microseconds of the wall clock since 1970-01-01 00:00, whatever the session zone is."""
    when = when.cast("timestamp_ntz")
    seconds = F.date_part(F.lit("SECOND"), when)  # decimal(8,6)
    minutes = F.hour(when).cast("bigint") * 60 + F.minute(when)
    micros = (seconds * F.lit(1_000_000)).cast("bigint")
    return F.unix_date(when.cast("date")).cast("bigint") * DAY + minutes * 60_000_000 + micros


def wall_from_unix(seconds: Column, zone: str = "UTC") -> Column:
    """UTC epoch seconds as the wall clock of a zone (``UTC``, ``+05:30`` or ``Area/City``)."""
    utc = ntz_from_micros(seconds.cast("bigint") * 1_000_000)
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def wall_micros(seconds: Column, zone: str = "UTC") -> Column:
    """:func:`wall_from_unix` in microseconds."""
    return seconds.cast("bigint") * 1_000_000 if zone == "UTC" else micros_from_ntz(wall_from_unix(seconds, zone))


def unix_from_wall(when: Column, zone: str = "UTC") -> Column:
    utc = when if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), when)
    return F.floor(micros_from_ntz(utc) / 1_000_000).cast("bigint")


def iso_from_unix(seconds: Column) -> Column:
    """``2024-11-06_08:30:05+00:00``."""
    return F.concat(F.date_format(wall_from_unix(seconds), "yyyy-MM-dd'_'HH:mm:ss"), F.lit("+00:00"))


def unix_from_iso(value: Column) -> Column:
    """ISO 8601 text, ``T``, blank or ``_`` between date and time. Text without an offset is taken as UTC."""
    normal = F.regexp_replace(value, r"\A(\d{4}-\d\d-\d\d)(?:_|\z)", "$1T")
    normal = F.when(F.endswith(normal, F.lit("T")), F.concat(normal, F.lit("00:00:00"))).otherwise(normal)
    zoned = F.when(normal.rlike(r"(?:Z|[+-]\d\d:?\d\d)\z"), normal).otherwise(F.concat(normal, F.lit("Z")))
    return F.floor(F.unix_micros(zoned.cast("timestamp")) / 1_000_000).cast("bigint")


# --- rounding ------------------------------------------------------------------------------------------------------


def _clock(hour: int, minute: int, second: int) -> int:
    return ((hour * 60 + minute) * 60 + second) * 1_000_000


def _round_fixed(micros: Column, amount: Column, unit: str, a: Anchors) -> Column:
    """Units of fixed length: the next multiple of the period after an anchor of the same day (or week)."""
    offset, step_back = {
        "millisecondly": (a.millisecondly_microsecond, 1_000),
        "secondly": (a.secondly_millisecond * 1_000, 1_000_000),
        "minutely": (_clock(0, 0, a.minutely_second), 60_000_000),
        "hourly": (_clock(0, a.hourly_minute, a.hourly_second), DAY),
        "daily": (_clock(a.daily_hour, a.daily_minute, a.daily_second), DAY),
        "weekly": (_clock(a.weekly_hour, a.weekly_minute, a.weekly_second), 7 * DAY),
    }[unit]
    day = F.floor(micros / F.lit(DAY)).cast("bigint")
    if unit == "weekly":
        # 1970-01-01 was a Thursday; anchors count weekdays from Sunday
        day = day - F.pmod(day + 4 - a.weekly_weekday, F.lit(7))
    anchor = day * DAY + offset
    anchor = F.when(anchor <= micros, anchor).otherwise(anchor - step_back)
    period = amount.cast("bigint") * (PERIOD_MILLIS[unit] * 1_000)
    return micros + F.pmod(anchor - micros, period)


def _last_day(month: Column) -> Column:
    """Length of a month, given as year * 12 + month - 1."""
    return F.dayofmonth(F.last_day(F.add_months(F.lit(date(1970, 1, 1)), (month - 1970 * 12).cast("int"))))


def _month_start(month: Column) -> Column:
    first = F.add_months(F.lit(date(1970, 1, 1)), (month - 1970 * 12).cast("int"))
    return F.unix_date(first).cast("bigint") * DAY


def _today(micros: Column) -> Column:
    return F.date_from_unix_date(F.floor(micros / F.lit(DAY)).cast("int"))


def _round_monthly(micros: Column, amount: Column, a: Anchors) -> Column:
    """Boundaries lie ``amount`` months apart, counted from the anchor month of the same year. The anchor day is cut to
    the length of every month passed through - the anchor month, the month one period before it if the anchor itself
    lies ahead, and the months stepped to - and stays cut."""
    today, amount = _today(micros), amount.cast("int")
    clock = _clock(a.monthly_hour, a.monthly_minute, a.monthly_second)
    year, month = F.year(today), F.month(today)
    into_month = micros - F.unix_date(F.trunc(today, "month")).cast("bigint") * DAY
    anchor_month = year * 12 + (a.monthly_month - 1)
    anchor_day = F.least(F.lit(a.monthly_monthday), _last_day(anchor_month))

    def into(day: Column) -> Column:
        return (day - 1).cast("bigint") * DAY + clock

    lies_ahead = (month < a.monthly_month) | ((month == a.monthly_month) & (into(anchor_day) > into_month))
    anchor_day = F.when(lies_ahead, F.least(anchor_day, _last_day(anchor_month - amount))).otherwise(anchor_day)
    behind = F.pmod(month - a.monthly_month, amount)  # months since the last boundary month
    reached = year * 12 + month - 1 - behind
    day = F.least(anchor_day, _last_day(reached))
    passed = (behind > 0) | (into(day) < into_month)
    target = reached + F.when(passed, amount).otherwise(0)
    return _month_start(target) + into(F.least(day, _last_day(target)))


def _round_yearly(micros: Column, amount: Column, a: Anchors) -> Column:
    year, amount = F.year(_today(micros)), amount.cast("int")
    clock = _clock(a.yearly_hour, a.yearly_minute, a.yearly_second)
    month = (year - F.pmod(year - a.yearly_year, amount)) * 12 + (a.yearly_month - 1)
    day = F.least(F.lit(a.yearly_monthday), _last_day(month))
    passed = _month_start(month) + (day - 1).cast("bigint") * DAY + clock < micros
    target = month + F.when(passed, amount * 12).otherwise(0)
    return _month_start(target) + (F.least(day, _last_day(target)) - 1).cast("bigint") * DAY + clock


def round_up_micros(
    micros: Column,
    amount: Column,
    unit: Column | str,
    anchors: Anchors = Anchors(),
    units: Iterable[str] = tuple(PERIOD_MILLIS),
) -> Column:
    """Wall-clock microseconds rounded up to the next period boundary; an exact boundary, or amount 0, is unchanged.

    ``unit`` may be a column (one plan row per unit) with values out of ``units``; any other unit gives null."""
    positive = F.when(amount > 0, amount)  # keeps the modulo away from a zero period

    def rounded(name: str) -> Column:
        if name == "monthly":
            return _round_monthly(micros, positive, anchors)
        if name == "yearly":
            return _round_yearly(micros, positive, anchors)
        return _round_fixed(micros, positive, name, anchors)

    result = F.when(amount == 0, micros)
    if isinstance(unit, str):
        if unit not in PERIOD_MILLIS:
            raise ValueError(f"unknown period unit: {unit}")
        return result.otherwise(rounded(unit))
    for name in units:
        result = result.when(unit == name, rounded(name))
    return result


def round_up(when: Column, amount: Column | int, unit: Column | str, anchors: Anchors = Anchors()) -> Column:
    """:func:`round_up_micros` from and to TIMESTAMP_NTZ."""
    amount = amount if isinstance(amount, Column) else F.lit(amount)
    return ntz_from_micros(round_up_micros(micros_from_ntz(when), amount, unit, anchors))
