"""Ordered, skew-safe scans and joins.

One series may hold a large share of all rows, so nothing here sorts or collects a whole hot series in one task. Groups are
counted first; only those with more rows than a task should hold are treated apart:

* :func:`ordered_scan` computes prefix sums, "last value before" and group totals. Rows are shuffled once, by group, and
  windowed; several scans over the same rows and order share that shuffle (:class:`Scans`). A hot group is cut into parts at
  sampled values of its order key; what a part hands on to the next is one row per part, broadcast back. No row is
  shuffled a second time.
* :func:`salted_join` deals the rows of hot keys over several partitions and repeats the other side for these keys only.
* :func:`fan_join` counts the rows a join will make, deals it over tasks by them and hands them on in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcat.session import shared_folder

# A task holds at most 2**18 rows of one group, or the MOST_PARTS-th part of the rows of hot groups if that is more.
CHUNK_BITS = 18
# Parts of all hot groups together number at most twice this, whatever the input: small enough to broadcast.
MOST_PARTS = 1 << 16
# Rows sampled per part to find where to cut.
SAMPLED = 16
# Parts of one key in a salted join at most.
MOST_SALTS = 256
# Rows of a fan-out that a task makes, about, or the FAN_PARTS-th part of all if that is more; its tasks at most.
FAN_ROWS = 1 << 20
FAN_PARTS = 1_000
FAN_TASKS = 10_000
# Rows of one key that a task of a fan-out holds, about, and what Spark's bitmaps count at most.
FAN_HELD = 1 << 13
BITMAP_BITS = 1 << 15

CHUNK, _SALT, _ROWS, _CUTS = "__chunk", "__salt", "__rows", "__cuts"


# --- hot groups -----------------------------------------------------------------------------------------------------


def fits_one_task(df: DataFrame) -> bool:
    """Whether all files and tables behind df together are no larger than what Spark lets one task read."""
    query = df._jdf.queryExecution()
    leaves = query.optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size <= df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a small table to the shared folder and returns the written rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_groups(df: DataFrame, group: Sequence[str], bits: int = CHUNK_BITS) -> DataFrame | None:
    """Groups with more rows than a task should hold, their number of rows and of parts to cut them into; None if there is
    none. One counting pass with map-side combine, left out where the whole input is small enough for one task, and for
    streams, whose rows come in batches of a size the trigger sets."""
    if df.isStreaming:
        return None
    if bits >= CHUNK_BITS and fits_one_task(df):
        return None
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias(_ROWS))
    many = counted.filter(F.col(_ROWS) > (1 << bits))
    n_hot, n_rows = many.agg(F.count(F.lit(1)), F.coalesce(F.sum(_ROWS), F.lit(0))).first()
    if not n_hot:
        return None
    most = max(1 << bits, n_rows // MOST_PARTS)
    parts = F.ceil(F.col(_ROWS) / most).cast("int")
    return written(many.filter(F.col(_ROWS) > most).withColumn("__parts", parts), "hot")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join by keys where null keys meet; the keys of ``right`` are dropped. ``right`` holds at most 2 * MOST_PARTS rows."""
    renamed = right.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)})
    matching = [F.col(k).eqNullSafe(F.col(f"__r_{i}")) for i, k in enumerate(keys)]
    joined = left.join(F.broadcast(renamed), matching, how)
    return joined if how == "left_semi" else joined.drop(*[f"__r_{i}" for i in range(len(keys))])


# --- ordered scans --------------------------------------------------------------------------------------------------


class Scans:
    """Ordered scans over rows of the same groups in the same order (nulls first).

    ``rows`` are the input's rows, with the part of their group in a column of their own where some group is hot. Each scan
    takes rows that were made from them by adding columns, and finds them partitioned and sorted already."""

    def __init__(self, df: DataFrame, group: Sequence[str], order: Sequence[str], bits: int = CHUNK_BITS):
        self.group, self.order, self.columns = list(group), list(order), df.columns
        hot = hot_groups(df, group, bits)
        self.cut = hot is not None
        self.keys = [*self.group, CHUNK] if self.cut else self.group
        self.rows = df
        if hot is not None:
            position = F.struct(*self.order)
            places = self._places(df, hot, 1 << bits)
            marked = same_keys(df, places, self.group, "left")
            part = F.size(F.filter(_CUTS, lambda c: c <= position))
            self.rows = marked.withColumn(CHUNK, F.when(F.col(_CUTS).isNull(), -1).otherwise(part)).drop(_CUTS)

    def _places(self, df: DataFrame, hot: DataFrame, rows: int) -> DataFrame:
        """Values of the order key at which hot groups are cut into parts of about equal size, from a sample of the keys."""
        position = F.struct(*self.order).alias("__at")
        drawn = F.pmod(F.xxhash64(*self.group, *self.order), F.lit(max(1, rows // SAMPLED))) == 0
        names = hot.select(*self.group, "__parts")
        sample = same_keys(df.select(*self.group, *self.order).filter(drawn), names, self.group, "inner")
        ranked = sample.select(*self.group, "__parts", position).withColumns(
            {
                "__rank": F.row_number().over(Window.partitionBy(*self.group).orderBy("__at")),
                "__n": F.count(F.lit(1)).over(Window.partitionBy(*self.group)),
            }
        )
        step = lambda rank: F.floor(rank * F.col("__parts") / F.col("__n"))
        border = ranked.filter(step(F.col("__rank")) > step(F.col("__rank") - 1))
        return written(border.groupBy(*self.group).agg(F.sort_array(F.collect_set("__at")).alias(_CUTS)), "cuts")

    def add(
        self,
        rows: DataFrame,
        sums: Mapping[str, Column] | None = None,
        totals: Mapping[str, Column] | None = None,
        lasts: Mapping[str, Column] | None = None,
        bests: Mapping[str, Column] | None = None,
        peaks: Mapping[str, Column] | None = None,
    ) -> DataFrame:
        """See :func:`ordered_scan`."""
        sums, totals, lasts = dict(sums or {}), dict(totals or {}), dict(lasts or {})
        bests, peaks = dict(bests or {}), dict(peaks or {})
        numbers = {n: F.coalesce(c, F.lit(0)).cast("bigint") for n, c in (sums | totals).items()}
        result = [*rows.columns, *sums, *totals, *lasts, *bests, *peaks]
        rows = rows.withColumns({f"__v_{n}": c for n, c in (numbers | lasts | bests | peaks).items()})
        earlier = Window.partitionBy(*self.keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.keys)
        local = rows.withColumns(
            {n: F.coalesce(F.sum(f"__v_{n}").over(earlier), F.lit(0)) for n in sums}
            | {n: F.last(f"__v_{n}", ignorenulls=True).over(earlier) for n in lasts}
            | {n: F.sum(f"__v_{n}").over(whole) for n in totals}
            | {n: F.max(f"__v_{n}").over(whole) for n in bests}
            | {n: F.max(f"__v_{n}").over(earlier) for n in peaks}
        )
        if self.cut:
            local = self._carry(local, rows, list(sums), list(totals), list(lasts), list(bests), list(peaks))
        return local.select(*result)

    def _carry(
        self,
        local: DataFrame,
        rows: DataFrame,
        sums: list[str],
        totals: list[str],
        lasts: list[str],
        bests: list[str],
        peaks: list[str],
    ) -> DataFrame:
        """Adds to the rows of hot groups what the parts before theirs hand on."""
        value = lambda n: F.struct(F.struct(*self.order), F.col(f"__v_{n}").alias("v"))
        parts = rows.filter(F.col(CHUNK) >= 0).groupBy(*self.keys).agg(
            *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in dict.fromkeys([*sums, *totals])],
            *[F.max(F.when(F.col(f"__v_{n}").isNotNull(), value(n)))["v"].alias(f"__l_{n}") for n in lasts],
            *[F.max(f"__v_{n}").alias(f"__m_{n}") for n in [*bests, *peaks]],
        )
        whole = Window.partitionBy(*self.group)
        before = Window.partitionBy(*self.group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        carried = parts.select(
            *self.keys,
            *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__c_{n}") for n in sums],
            *[F.sum(f"__s_{n}").over(whole).alias(f"__t_{n}") for n in totals],
            *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in lasts],
            *[F.max(f"__m_{n}").over(whole).alias(f"__t_{n}") for n in bests],
            *[F.max(f"__m_{n}").over(before).alias(f"__c_{n}") for n in peaks],
        )
        joined = same_keys(local, written(carried, "carried"), self.keys, "left")
        return joined.withColumns(
            {n: F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in sums}
            | {n: F.coalesce(f"__t_{n}", n) for n in [*totals, *bests]}
            | {n: F.coalesce(n, f"__c_{n}") for n in lasts}
            | {n: F.greatest(n, f"__c_{n}") for n in peaks}
        )


def ordered_scan(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    bits: int = CHUNK_BITS,
    bests: Mapping[str, Column] | None = None,
    peaks: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Adds columns to every row of ``df``, by group in the given order (nulls first; a null group is a group):

    * ``sums``: sum of an integer expression over all earlier rows of the group;
    * ``totals``: its sum over the whole group;
    * ``lasts``: the latest non-null value of an expression among all earlier rows;
    * ``bests``: the greatest non-null value of an expression in the whole group;
    * ``peaks``: the greatest non-null value of an expression among all earlier rows.

    Whole rows are shuffled once. Groups with more than ``2**bits`` rows are cut into parts, see :class:`Scans`; to find
    them, large inputs are counted when the scan is built. An expensive input is better written to a table first.
    """
    scans = Scans(df, group, order, bits)
    return scans.add(scans.rows, sums, totals, lasts, bests, peaks).drop(CHUNK)


# --- joins and ranks ------------------------------------------------------------------------------------------------


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    salts: int = MOST_SALTS,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """``big`` join ``small`` where a key may be hot in ``big``. Keys of ``big`` with more than ``2**bits`` rows are counted
    first and dealt by ``spread``, columns that differ between rows of one key, over as many parts as they need, ``salts`` at
    most; ``small``, which should hold each key few times, is repeated for those keys only. All other keys, and all of them
    where none is hot, are joined as they are. ``how``: inner, left, left_semi or left_anti."""
    hot = hot_groups(big, on, bits)
    if hot is None:
        return big.join(small, list(on), how)
    parts = hot.select(*on, F.least(F.col("__parts"), F.lit(salts)).alias("__parts"))
    dealt = F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int")
    salted = same_keys(big, parts, on, "left").withColumn(_SALT, F.coalesce(dealt, F.lit(0))).drop("__parts")
    copies = F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)
    repeated = same_keys(small, parts, on, "left").withColumn(_SALT, F.explode(copies)).drop("__parts")
    return salted.join(repeated, [*on, _SALT], how).drop(_SALT)


def number_names(
    df: DataFrame, on: Sequence[str], name: str, chunk: str, number: str, held: int = FAN_HELD
) -> DataFrame:
    """Cuts the rows of each key into chunks of about ``held`` rows, equal names in one, and numbers the names of a chunk.

    Adds the columns ``chunk`` and ``number``: rows of one key and chunk have the same number if and only if they have the same
    name. Numbers begin at 0, stay below ``BITMAP_BITS`` (a chunk with more names is cut again) and are null for null names."""
    on = list(on)
    counts = df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / held).alias("__chunks"))
    cut = df.join(counts, on).withColumn(chunk, F.pmod(F.xxhash64(name), "__chunks"))
    place = F.dense_rank().over(Window.partitionBy(*on, chunk).orderBy(name)) - 1
    again = F.floor(F.col("__place") / BITMAP_BITS)
    return cut.withColumn("__place", place).select(
        *df.columns,
        (F.col(chunk) + F.col("__chunks") * again).alias(chunk),
        F.when(F.col(name).isNotNull(), F.col("__place") - again * BITMAP_BITS).cast("bigint").alias(number),
    )


def fan_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    deal: Sequence[str],
    order: Sequence[str],
    chunk: str,
    spread: Sequence[str],
    part: str,
    rows: int = FAN_ROWS,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """``left`` inner join ``right`` by keys of which both sides have many rows, so that the result is far larger than both.

    ``right`` has its rows in chunks (a column from 0, see :func:`number_names`). How many rows each key and chunk makes is
    counted first. The rows of ``left`` are repeated for the chunks of their key and dealt by ``deal`` over as many parts as make
    about ``rows`` rows each; those of ``right`` are repeated for the parts of their chunk. The result has the column ``part``:
    rows with the same key, ``deal`` and chunk have the same part, other keys and chunks have others, and a part is in one task.

    Each task sorts its rows of ``left``, which are few, by part and ``order`` (columns of ``left``), looks up those of ``right``
    in a hash table, and hands the result on in that order. So an aggregate by part and these columns, in this order, reads the
    result as it is made: it is neither shuffled nor sorted, and no table of groups is held.

    A chunk with more than ``2**bits`` rows, most of them copies, is no matter for one task: then ``right`` is dealt by ``spread``
    (see :func:`salted_join`), ``part`` is the chunk, and the rows come as they are."""
    on = list(on)
    made = F.col("__l") * F.col("__r")
    n = lambda side, name, *by: side.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    counts = n(left, "__l", *on).join(n(right, "__r", *on, chunk), on)
    counts = written(counts.withColumn("__first", F.monotonically_increasing_id() * FAN_TASKS), "fan")
    total, widest = counts.agg(F.sum(made), F.max("__r")).first()
    if (widest or 0) > 1 << bits:
        return salted_join(right, left, on, "inner", spread, bits=bits).withColumnRenamed(chunk, part)
    most = max(rows, (total or 0) // FAN_PARTS)
    parts = F.least(F.ceil(made / most), F.col("__l"), F.lit(FAN_TASKS))
    places, first = counts.select(*on, chunk, "__first", parts.alias("__parts")), F.col("__first")
    tasks = min(FAN_TASKS, max(1, 2 * -(-(total or 0) // most)))
    ours = left.join(places, on).withColumn(part, first + F.pmod(F.xxhash64(*deal), "__parts")).drop("__parts", "__first", chunk)
    theirs = right.join(places, [*on, chunk]).withColumn(part, F.explode(F.sequence(first, first + F.col("__parts") - 1)))
    theirs = theirs.drop("__parts", "__first", chunk, *on)
    # Spark drops a sort below a join, unless something that is not deterministic comes between
    ordered = ours.repartition(tasks, part).sortWithinPartitions(part, *order).filter(F.monotonically_increasing_id() >= 0)
    return ordered.join(theirs.repartition(tasks, part).hint("shuffle_hash"), part)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """First k rows of each group. Spark cuts every partition to k rows per group before the shuffle, so a hot group
    sends at most k rows per map task."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def latest_k(df: DataFrame, k: int, group: Sequence[str] = ("dataset",)) -> DataFrame:
    return top_k(df, group, [F.desc(c) for c in ("createtxg", "creation", "tag")], k)


def oldest_k(df: DataFrame, k: int, group: Sequence[str] = ("dataset",)) -> DataFrame:
    return top_k(df, group, [F.asc(c) for c in ("createtxg", "creation", "tag")], k)


# --- set operations by key --------------------------------------------------------------------------------------


def semi(df: DataFrame, keys: DataFrame, on: str | Sequence[str] = "guid") -> DataFrame:
    """Rows whose key is in ``keys``; an empty set keeps nothing."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on), on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str | Sequence[str] = "guid") -> DataFrame:
    """Rows whose key is not in ``keys``; an empty set keeps everything."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*on), on, "left_anti")


def difference(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that are not in ``b``."""
    key = [key] if isinstance(key, str) else list(key)
    return anti(a.select(*key).distinct(), b, key)


def intersection(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Distinct keys in both."""
    key = [key] if isinstance(key, str) else list(key)
    return semi(a.select(*key).distinct(), b, key)


def duplicates(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def has_duplicates(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """One row, one boolean column."""
    return duplicates(df, key).agg((F.count(F.lit(1)) > 0).alias("has_duplicates"))
