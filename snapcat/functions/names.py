"""Expressions over dataset, snapshot and bookmark names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapcat.functions.hashing import decimal_guid
from snapcat.schema import BOOKMARK, SNAPSHOT, TMP_BOOKMARK, TMP_PREFIX

# Characters a dataset name must not contain, and userrefs values that mean "no hold".
FORBIDDEN_CHARS = "\"'`~!@#$%^&*()+={}[]|;<>?,\\"
NOT_HELD = ("", "-", "0")
YEAR_PATTERN = "[1-9][0-9][0-9][0-9]"


def text(value: str | Column) -> Column:
    """A plain string is a literal here; pass a Column to read from the row."""
    return value if isinstance(value, Column) else F.lit(value)


def split_name(name: Column) -> Column:
    """``pool/fs@tag`` or ``pool/fs#tag`` as struct<dataset, separator, tag>, cut at the first separator."""
    dataset = F.regexp_extract(name, r"\A([^@#]*)", 1)
    at = F.length(dataset)
    return F.struct(
        dataset.alias("dataset"),
        name.substr(at + 1, F.lit(1)).alias("separator"),
        name.substr(at + 2, F.length(name)).alias("tag"),
    )


def relativize(dataset: Column, root: str | Column) -> Column:
    return dataset.substr(F.length(text(root)) + 1, F.length(dataset))


def replace_prefix(path: Column, old: str | Column, new: str | Column) -> Column:
    return F.concat(text(new), relativize(path, old))


def ancestors(path: Column, proper: bool = False) -> Column:
    """``a/b/c`` -> [a, a/b, a/b/c]; ``proper`` leaves out the path itself."""
    parts = F.split(path, "/")
    depth = F.size(parts) - (1 if proper else 0)
    lengths = F.when(depth > 0, F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def is_descendant(path: Column, root: str | Column) -> Column:
    """True for the root itself and everything below it."""
    root = text(root)
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def kind(name: Column, tmp_prefix: str = TMP_PREFIX) -> Column:
    return (
        F.when(F.contains(name, F.lit("#" + tmp_prefix)), TMP_BOOKMARK)
        .when(F.contains(name, F.lit("#")), BOOKMARK)
        .otherwise(SNAPSHOT)
    )


def is_held(userrefs: Column) -> Column:
    return ~F.coalesce(userrefs.cast("string"), F.lit("")).isin(*NOT_HELD)


def label_matches(tag: Column, prefix: str | Column, infix: str | Column, suffix: str | Column) -> Column:
    """Whether a tag belongs to a series. An empty infix demands a 4-digit year right after the prefix, so that the
    series ``org_<time>_daily`` does not swallow ``org_site_<time>_daily``."""
    infix, suffix = text(infix), text(suffix)
    head = F.concat(text(prefix), infix)
    no_infix = infix == ""
    shortest = F.length(head) + F.length(suffix) + F.when(no_infix, 4).otherwise(0)
    return (
        F.startswith(tag, head)
        & F.endswith(tag, suffix)
        & (F.length(tag) >= shortest)
        & (~no_infix | tag.substr(F.length(head) + 1, F.lit(4)).rlike(rf"\A{YEAR_PATTERN}\z"))
    )


def valid_dataset_name(name: Column) -> Column:
    escaped = "".join("\\" + c for c in FORBIDDEN_CHARS)
    bad = (
        r"\A(?:|\.|\.\.)\z"  # empty, dot, dot-dot
        r"|\A(?:/|\./|\.\./)|(?:/|/\.|/\.\.)\z"  # leading or trailing slash forms
        r"|//|/\./|/\.\./"  # empty or dotted segments
        rf"|[{escaped}]|[^\S ]"  # shell characters, any white space but blank
    )
    return name.isNotNull() & ~name.rlike(bad) & name.rlike(r"\A\p{L}")


def valid_label(prefix: Column, infix: Column, suffix: Column, timestamp: str = "2024-01-01_00:00:00") -> Column:
    tag = F.concat(prefix, infix, F.lit(timestamp), suffix)
    return (
        valid_dataset_name(tag)
        & ~F.contains(tag, F.lit("/"))
        & prefix.rlike(r"\A[^_]*_\z")
        & infix.rlike(r"\A(?:|[^_]*_)\z")
        & suffix.rlike(r"\A(?:|_[^_]*)\z")
    )


def render_label(
    prefix: Column,
    infix: Column,
    when: Column,
    suffix: Column,
    pattern: str = "yyyy-MM-dd'_'HH:mm:ss",
    millis: bool = False,
) -> Column:
    """The tag of a new snapshot. ``millis`` appends milliseconds; ``+`` of a zone offset becomes ``z``."""
    stamp = F.date_format(when, pattern + (".SSS" if millis else ""))
    return F.concat(prefix, infix, F.translate(stamp, "+", "z"), suffix)


def final_bookmark_name(name: Column, tmp_prefix: str = TMP_PREFIX) -> Column:
    """Name a temporary bookmark gets on promotion: the guid goes before the last ``_`` part, or at the end."""
    dataset = F.substring_index(name, "#", 1)
    tag = name.substr(F.length(dataset) + 2 + len(tmp_prefix), F.length(name))
    # <snapshot>.<compact guid>.<pool id>.<dataset id>
    pool_and_guid = F.substring_index(tag, ".", -3)
    snapshot = tag.substr(F.lit(1), F.length(tag) - F.length(pool_and_guid) - 1)
    guid = decimal_guid(F.substring_index(pool_and_guid, ".", 1))
    suffix = F.substring_index(snapshot, "_", -1)
    front = snapshot.substr(F.lit(1), F.length(snapshot) - F.length(suffix) - 1)
    final = F.when(
        F.contains(snapshot, F.lit("_")), F.concat_ws("_", front, guid, suffix)
    ).otherwise(F.concat_ws("_", snapshot, guid))
    return F.concat(dataset, F.lit("#"), final)


def sanitize_key(value: Column, separator: str = ",") -> Column:
    """Every blank, ``..``, slash, backslash and separator becomes ``!``."""
    quoted = "".join("\\" + c for c in separator)
    return F.regexp_replace(value, rf"\.\.|[ /\\]|{quoted}", "!")
