"""Include / exclude regex lists as one boolean expression."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DESCENDANTS = "(?:/.*)?"  # fixed value: a dataset pattern also selects everything below the dataset
# Fixed value: datasets named like tmp, temp, tmp-1 are left out unless patterns say otherwise.
DEFAULT_EXCLUDE_DATASETS = r"(?:.*/)?[Tt][Ee]?[Mm][Pp][-_]?[0-9]*"


def java_pattern(pattern: str) -> str:
    """Checks a pattern and rewrites named groups to the Java spelling."""
    for unsupported in ("(?P=", "(?(", "(?#"):
        if unsupported in pattern:
            raise ValueError(f"regex syntax {unsupported!r} is not supported: {pattern}")
    return pattern.replace("(?P<", "(?<")


def _any_match(value: Column, patterns: Sequence[str]) -> list[Column]:
    """Full-match tests. Plain patterns share one alternation; back references keep a pattern on its own."""
    shared = [p for p in patterns if not re.search(r"\\[1-9]|\(\?<[A-Za-z]", p)]
    lone = [p for p in patterns if p not in shared]
    groups = (["|".join(f"(?:{p})" for p in shared)] if shared else []) + lone
    # (?d): only \n ends a line for the dot; \A and \z because $ also matches before a final newline
    return [value.rlike(rf"(?d)\A(?:{p})\z") for p in groups]


def _matches(value: Column, patterns: Sequence[str]) -> Column | bool:
    """True / False where the list alone decides, a Column otherwise."""
    positive = [java_pattern(p) for p in patterns if not p.startswith("!")]
    negative = [java_pattern(p[1:]) for p in patterns if p.startswith("!")]
    if ".*" in positive:
        return True
    tests = _any_match(value, positive)
    tests += [~value.rlike(rf"(?d)\A(?:{p})\z") for p in negative if p != ".*"]
    if not tests:
        return False
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def regex_included(value: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Not matched by any exclude, and matched by some include. ``!`` in front negates a pattern."""
    wanted, unwanted = _matches(value, include), _matches(value, exclude)
    if wanted is False or unwanted is True:
        return F.lit(False)
    if unwanted is False:
        return F.lit(True) if wanted is True else wanted
    return ~unwanted if wanted is True else wanted & ~unwanted


def with_descendants(patterns: Sequence[str]) -> list[str]:
    """Extends dataset patterns to whole subtrees; a trailing ``$`` is dropped, any other ``$`` is an error."""
    result = []
    for pattern in patterns:
        if pattern.endswith("$") and not pattern.endswith("\\$"):
            pattern = pattern[:-1]
        elif "$" in pattern and not pattern.endswith("\\$"):
            raise ValueError(f"'$' is only allowed at the end: {pattern}")
        negation, body = ("!", pattern[1:]) if pattern.startswith("!") else ("", pattern)
        if body != ".*":
            # an alternation must take the suffix on its last branch only, exactly as written by the user
            body += DESCENDANTS
        result.append(negation + body)
    return result
