"""Which dataset properties a copy sets, excludes or takes over."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapcat.functions.regexes import regex_included

# Properties a receiver rejects, always or on volumes only, and those copied by default.
NEVER_VALID = ("casesensitivity", "normalization", "utf8only", "volblocksize", "volsize")
NOT_ON_VOLUME = (
    "aclinherit", "aclmode", "acltype", "atime", "canmount", "devices", "mountpoint", "overlay", "recordsize",
    "relatime", "sharenfs", "sharesmb", "snapdir", "xattr",
)
COPIED_BY_DEFAULT = (
    "aclinherit", "aclmode", "acltype", "atime", "checksum", "compression", "copies", "logbias", "primarycache",
    "recordsize", "redundant_metadata", "relatime", "secondarycache", "snapdir", "sync", "xattr",
)


@dataclass(frozen=True)
class PropertyGroup:
    """``option``: -o (set on receive), -x (exclude on receive) or set (set afterwards)."""

    option: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    sources: tuple[str, ...] = ("local",)
    targets: tuple[str, ...] = ("full", "incremental")

    def applies(self, full: bool) -> bool:
        return bool(self.include) and ("full" if full else "incremental") in self.targets

    def chooses(self) -> Column:
        return F.col("source").isin(*self.sources) & regex_included(F.col("property"), self.include, self.exclude)


def property_plan(
    props: DataFrame,
    groups: Sequence[PropertyGroup],
    full: bool,
    explicit_options: Sequence[str] = (),
    explicit_excludes: Sequence[str] = (),
) -> DataFrame:
    """``dataset, option, property, value`` from rows (dataset, property, value, source, is_volume), one per dataset and
    property. Precedence: explicit options, explicit excludes, -o, -x; ``set`` is independent. -o and -x of properties
    that the dataset type rejects are left out. Everything but the explicit excludes is decided row by row."""
    chosen = {"-o": F.lit(False), "-x": F.lit(False), "set": F.lit(False)}
    for group in groups:
        if group.applies(full):
            chosen[group.option] = chosen[group.option] | group.chooses()
    taken = F.col("property").isin(*explicit_options, *explicit_excludes)
    rejected = F.col("property").isin(*NEVER_VALID)
    rejected_o = rejected | (F.col("is_volume") & F.col("property").isin(*NOT_ON_VOLUME))
    as_o = chosen["-o"] & ~taken
    as_x = chosen["-x"] & ~taken & ~as_o
    picks = F.array_compact(
        F.array(
            F.when(as_o & ~rejected_o, F.struct(F.lit("-o").alias("option"), "value")),
            F.when(as_x & ~rejected, F.struct(F.lit("-x").alias("option"), F.lit(None).cast("string").alias("value"))),
            F.when(chosen["set"], F.struct(F.lit("set").alias("option"), "value")),
        )
    )
    plan = props.select("dataset", "property", F.inline(picks)).select("dataset", "option", "property", "value")
    names = [name for name in dict.fromkeys(explicit_excludes) if name not in NEVER_VALID]
    if not names:
        return plan
    excluded = props.select("dataset").distinct().select(
        "dataset",
        F.lit("-x").alias("option"),
        F.explode(F.array(*[F.lit(name) for name in names])).alias("property"),
        F.lit(None).cast("string").alias("value"),
    )
    return plan.unionByName(excluded)
