"""Numbers, sizes and durations as people read them.

Rounding is half-even on the shortest decimal form of a double; an exact decimal tie such as 2.675 can therefore round
the other way than binary rounding would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, and how many of one time unit make the next.
SIZE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB", "RiB", "QiB")
TIME_UNITS = ("ns", "μs", "ms", "s", "m", "h", "d")
TIME_STEPS = (1000, 1000, 1000, 60, 60, 24)


def _fixed(value: Column, digits: int) -> Column:
    return F.bround(value, digits).cast(f"decimal(38,{digits})").cast("string")


def human_float(value: Column) -> Column:
    """Two, one or no decimals by magnitude, without trailing zeros."""
    value = value.cast("double")
    size = F.abs(value)

    def trimmed(digits: int) -> Column:
        return F.regexp_replace(_fixed(value, digits), r"\.?0+$", "")

    shown = F.when(size < 10, trimmed(2)).when(size < 100, trimmed(1)).otherwise(_fixed(value, 0))
    return F.when(shown.isin("-0", ""), F.lit("0")).otherwise(shown)


def _first_fit(size: Column, steps: list[tuple[float, float, str]]) -> tuple[Column, Column]:
    """Divisor and unit of the first step whose value stays below its limit. steps: (divisor, limit, unit)."""
    *limited, last = steps
    divisor, unit = F.lit(last[0]), F.lit(last[2])
    for factor, limit, name in reversed(limited):
        fits = size < F.lit(factor * limit)
        divisor, unit = F.when(fits, F.lit(factor)).otherwise(divisor), F.when(fits, name).otherwise(unit)
    return divisor, unit


def _rendered(size: Column, divisor: Column, unit: Column, precision: int | None, gap: str) -> Column:
    scaled = size / divisor
    return F.concat(human_float(scaled) if precision is None else _fixed(scaled, precision), F.lit(gap), unit)


def human_bytes(value: Column, precision: int | None = None, separator: str = " ") -> Column:
    """1024-based, B to QiB."""
    value = value.cast("double")
    steps = [(1024.0**i, 1024.0, unit) for i, unit in enumerate(SIZE_UNITS)]
    divisor, unit = _first_fit(F.abs(value), steps)
    return F.concat(F.when(value < 0, "-").otherwise(""), _rendered(F.abs(value), divisor, unit, precision, separator))


def human_duration(value: Column, unit: str = "ns", precision: int | None = None, separator: str = "") -> Column:
    """Scales by 1000 up to seconds, then 60, 60, 24; a value below one unit is shown from nanoseconds up."""
    value = value.cast("double")
    size = F.abs(value)

    def steps_from(first: int) -> list[tuple[float, float, str]]:
        divisor, steps = 1.0, []
        for i in range(first, len(TIME_UNITS)):
            limit = TIME_STEPS[i] if i < len(TIME_STEPS) else float("inf")
            steps.append((divisor, limit, TIME_UNITS[i]))
            divisor *= limit
        return steps

    start = TIME_UNITS.index(unit)
    nanos = 1.0
    for step in TIME_STEPS[:start]:
        nanos *= step
    is_tiny = (size < 1) & (size != 0) & F.lit(start > 0)
    divisor, name = _first_fit(size, steps_from(start))
    if start > 0:
        tiny_divisor, tiny_name = _first_fit(size * F.lit(nanos), steps_from(0))
        divisor = F.when(is_tiny, tiny_divisor / F.lit(nanos)).otherwise(divisor)
        name = F.when(is_tiny, tiny_name).otherwise(name)
    return F.concat(F.when(value < 0, "-").otherwise(""), _rendered(size, divisor, name, precision, separator))


def percent(number: Column, total: Column, print_total: bool = False) -> Column:
    share = F.when(total == 0, "inf").otherwise(
        human_float(number.cast("double") * 100 / F.when(total != 0, total.cast("double")))
    )
    tail = F.concat(F.lit("/"), total.cast("string")) if print_total else F.lit("")
    return F.concat(number.cast("string"), tail, F.lit("="), share, F.lit("%"))


def hms(nanos: Column) -> Column:
    """``H:MM:SS``."""
    seconds = F.floor(nanos / F.lit(1_000_000_000)).cast("bigint")
    return F.concat(
        F.floor(seconds / 3600).cast("string"),
        F.lit(":"),
        F.lpad(F.floor((seconds % 3600) / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((seconds % 60).cast("string"), 2, "0"),
    )


def bytes_and_rate(num_bytes: Column, nanos: Column) -> Column:
    """struct<size, rate>, for example ``{41.70 GiB, [963.00 MiB/s]}``."""
    rate = F.bround(num_bytes.cast("double") * 1e9 / F.greatest(nanos, F.lit(1)), 0)
    return F.struct(
        human_bytes(num_bytes, 2).alias("size"),
        F.concat(F.lit("["), human_bytes(rate, 2), F.lit("/s]")).alias("rate"),
    )
