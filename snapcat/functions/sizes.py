"""Sizes and progress lines of transfer logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The size syntax, its unit letters, and the ETA part of a progress line.
SIZE_PATTERN = "(\\d+[.,٫]?\\d*)\\s*([KMGTPEZYRQ]?)(i?)([Bb])(.*)"
UNIT_LETTERS = "KMGTPEZYRQ"
RATES_PATTERN = r"\A.*/s\s*[)\]]?\s*"
ETA_PATTERN = r"\A.*?ETA\s*(?:(\d+)[+:])?(\d\d?):(\d\d):(\d\d).*(?:ETA|FIN).*\z"
BLANKS = " \t\r\n\x0b\x0c"


SEPARATOR = "\x01"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(value: Column, pattern: str, count: int) -> Column:
    """All groups of a full match as an array, a one-element array without a match: one regex run per row."""
    joined = F.regexp_replace(value, pattern, SEPARATOR.join(f"${i}" for i in range(1, count + 1)))
    return F.split(joined, SEPARATOR, count)


def _size_groups(size: Column) -> Column:
    return _groups(size, rf"(?d)\A{SIZE_PATTERN}\z", 5)


def _exponent(groups: Column) -> Column:
    letter = F.get(groups, F.lit(1))
    return F.when(letter == "", 0).otherwise(F.position(letter, F.lit(UNIT_LETTERS)))


def _whole(value: Column) -> Column:
    """A whole non-negative DOUBLE as DECIMAL(38,0), digit by digit what the number is in binary; beyond it is an error.

    A number of 2**63 and more is a multiple of 2**11, and so on in steps of 2**11, so it is divided until it fits BIGINT."""
    exact = F.raise_error(F.concat(F.lit("size beyond 38 digits: "), value.cast("string"))).cast("decimal(38,0)")
    for shift in range(66, -1, -11):
        part = (value / F.lit(float(2**shift))).cast("bigint").cast("decimal(19,0)")
        scaled = (part * F.lit(str(2**shift)).cast("decimal(20,0)")).cast("decimal(38,0)")
        exact = F.when(value < F.lit(min(2.0 ** (63 + shift), 1e38)), scaled).otherwise(exact)
    return exact


def _number(groups: Column) -> Column:
    """Bytes as a whole DOUBLE: number times unit, rounded half-even, in binary floating point for every unit."""
    number = F.translate(F.get(groups, F.lit(0)), ",٫", "..").cast("double")
    binary, decimal = (F.array(*[F.lit(float(base**i)) for i in range(11)]) for base in (1024, 1000))
    factor = F.get(F.when(F.get(groups, F.lit(2)) == "i", binary).otherwise(decimal), _exponent(groups))
    return F.rint(number * factor / F.when(F.get(groups, F.lit(3)) == "b", 8).otherwise(1))


def _is_rate(groups: Column) -> Column:
    return F.startswith(F.get(groups, F.lit(4)), F.lit("/s"))


def size_to_bytes(size: Column, strict: bool = True) -> Column:
    """``4.12 KiB foo`` -> 4219 as DECIMAL(38,0); text that is no size gives 0. A rate (``/s`` right behind the size)
    is an error, or null without ``strict``."""
    return _let(_size_groups(size), lambda groups: _bytes(groups, strict, size))


def _after_colon(line: Column) -> Column:
    rest = line.substr(F.length(F.substring_index(line, ":", 1)) + 2, F.length(line))
    return F.btrim(rest, F.lit(BLANKS))


def _bytes(groups: Column, strict: bool, shown: Column | None = None) -> Column:
    # the condition keeps a failing size out of rows that have none
    value = F.when(~_is_rate(groups), _let(_number(groups), _whole))
    if strict:
        text = F.concat(F.lit("Invalid size: "), F.array_join(groups, " ") if shown is None else shown)
        value = F.when(_is_rate(groups), F.raise_error(text).cast("decimal(38,0)")).otherwise(value)
    return F.when(F.size(groups) == 5, value).otherwise(F.lit(0).cast("decimal(38,0)"))


def line_bytes(line: Column, strict: bool = True) -> Column:
    """Bytes of a progress line, 0 for a line without ``:`` or without a size. DECIMAL(38,0).

    A rate in the place of the size is an error, or null without ``strict`` (see :func:`rate_lines`)."""
    # without a colon nothing is left behind it, and that is no size
    return _let(_size_groups(_after_colon(line)), lambda groups: _bytes(groups, strict))


def rate_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """The rows whose line has a rate in the place of the size: what the functions here reject."""
    groups = _size_groups(_after_colon(F.col(line)))
    return df.filter(_let(groups, lambda g: (F.size(g) == 5) & _is_rate(g)))


def with_line_bytes(df: DataFrame, output: str = "bytes", line: str = "line", strict: bool = True) -> DataFrame:
    """:func:`line_bytes` as a column of a table. The parsed parts are a column of their own in between, which keeps
    the whole step in generated code and runs the regex once per row."""
    parsed = df.withColumn("__size", _size_groups(_after_colon(F.col(line))))
    return parsed.withColumn(output, _bytes(F.col("__size"), strict)).drop("__size")


def parse_progress(line: Column, strict: bool = True) -> Column:
    """struct<bytes DECIMAL(38,0), remaining_seconds DECIMAL(38,0), tail STRING>: what is sent, how long the transfer
    still takes, and the rest of the line behind the last rate."""
    return _let(_size_groups(_after_colon(line)), lambda groups: _progress(groups, strict))


def with_progress(df: DataFrame, line: str = "line", strict: bool = True) -> DataFrame:
    """The parts of :func:`parse_progress` as columns bytes, remaining_seconds and tail, parsed step by step in
    generated code."""
    parsed = df.withColumn("__size", _size_groups(_after_colon(F.col(line))))
    trimmed = parsed.withColumn("tail", _tail(F.col("__size")))
    timed = trimmed.withColumn("__eta", _groups(F.col("tail"), ETA_PATTERN, 4))
    sized = timed.withColumns({"bytes": _bytes(F.col("__size"), strict), "remaining_seconds": _remaining(F.col("__eta"))})
    return sized.drop("__size", "__eta")


def _tail(groups: Column) -> Column:
    return F.regexp_replace(F.ltrim(F.coalesce(F.get(groups, F.lit(4)), F.lit(""))), RATES_PATTERN, "")


def _remaining(times: Column) -> Column:
    """Seconds from the ETA parts; a line without ETA has no four parts."""
    zero = F.lit(0).cast("decimal(38,0)")
    total = zero
    for i, seconds in enumerate((86400, 3600, 60, 1)):
        digits = F.get(times, F.lit(i))
        # a missing part is empty text; a failing cast would cost an exception per row
        part = F.when(F.length(digits) > 0, digits.cast("decimal(30,0)")).otherwise(F.lit(0).cast("decimal(30,0)"))
        total = (total + part * F.lit(seconds).cast("decimal(5,0)")).cast("decimal(38,0)")
    return F.when(F.size(times) == 4, total).otherwise(zero)


def _progress(groups: Column, strict: bool) -> Column:
    return _let(
        _tail(groups),
        lambda tail: F.struct(
            _bytes(groups, strict).alias("bytes"),
            _let(_groups(tail, ETA_PATTERN, 4), _remaining).alias("remaining_seconds"),
            tail.alias("tail"),
        ),
    )
