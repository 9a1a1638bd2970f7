"""Summaries of jobs and trials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapcat.functions.human import human_duration, percent
from snapcat.operators.ordered import CHUNK_BITS, salted_join
from snapcat.plans.monitor import CRITICAL, DIE, OK, STILL_RUNNING, WARNING


def worst_status(df: DataFrame, code: str = "code", by: Sequence[str] = ()) -> DataFrame:
    """Exit code of many jobs: fatal before critical / warning before still running before ok, the highest within a
    class. A missing code counts as fatal (3)."""
    value = F.coalesce(F.col(code), F.lit(DIE)).cast("int")
    rank = F.when(value == OK, 0).when(value == STILL_RUNNING, 1).when(value.isin(WARNING, CRITICAL), 2).otherwise(3)
    worst = F.max(F.struct(rank.alias("rank"), value.alias("code")))["code"]
    return df.groupBy(*by).agg(worst.alias("code"))


def job_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts over jobs (started, completed, failed BOOLEAN, elapsed_nanos) with shares of all and mean elapsed time."""
    done = F.col("completed")
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if("started").alias("started"),
        F.count_if(done).alias("completed"),
        F.count_if(done & F.col("failed")).alias("failed"),
        F.coalesce(F.sum(F.when(done, F.col("elapsed_nanos"))), F.lit(0).cast("bigint")).alias("elapsed_nanos"),
    )
    mean = F.col("elapsed_nanos") / F.greatest("completed", F.lit(1))
    shares = [percent(F.col(c), F.col("jobs"), True).alias(f"{c}_text") for c in ("started", "completed", "failed")]
    return counted.select(
        *by, "jobs", "started", "completed", "failed", (F.col("started") - F.col("completed")).alias("running"),
        "elapsed_nanos", F.bround(mean, 0).cast("bigint").alias("mean_nanos"), *shares,
        human_duration(mean).alias("mean_text"),
    )


# Brackets of a median come from a sketch of this accuracy (its ranks are off by at most 1 / ACCURACY of the rows) and are
# widened by four times that, so they hold less than a hundredth of the rows, besides repeats of one value.
ACCURACY = 2000
_KEY = "__key"


def _keyed(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """With the group as one column; null keys are equal there."""
    return df.withColumn(_KEY, F.struct(*by) if by else F.lit(0))


def median_brackets(df: DataFrame, by: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """One row per group: for each value ``n`` (non-null), ``lo`` and ``hi``, between which the median lies for sure."""
    margin = 4 / ACCURACY
    sketches = {
        n: F.percentile_approx(v, [0.5 - margin, 0.5 + margin], ACCURACY) for n, v in values.items()
    }
    return (
        df.groupBy(*by)
        .agg(
            *[F.count(v).alias(f"__n_{n}") for n, v in values.items()],
            *[sketch.alias(f"__q_{n}") for n, sketch in sketches.items()],
        )
        .withColumns({f"__lo_{n}": F.col(f"__q_{n}")[0] for n in values} | {f"__hi_{n}": F.col(f"__q_{n}")[1] for n in values})
        .drop(*[f"__q_{n}" for n in values])
    )


def exact_medians(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], bits: int = CHUNK_BITS) -> DataFrame:
    """One row per group: its keys and the median of the non-null values of each expression, named as in ``values``.

    Two passes for all values together: a sketch brackets each median, then the values below a bracket are counted and
    those inside are ranked, each different one being one row. Where values lie does not matter, only how many there are."""
    rows = df.select(*by, *[v.cast("double").alias(f"__v_{n}") for n, v in values.items()])
    bounds = _keyed(median_brackets(rows, by, {n: F.col(f"__v_{n}") for n in values}), by).drop(*by)
    if by:
        met = salted_join(_keyed(rows, by), bounds, [_KEY], "inner", [f"__v_{n}" for n in values], bits=bits)
    else:
        met = rows.crossJoin(bounds)  # one row
    found = F.array(
        *[
            F.struct(
                F.lit(n).alias("which"),
                F.col(f"__v_{n}").alias("v"),
                F.col(f"__lo_{n}").alias("lo"),
                F.col(f"__hi_{n}").alias("hi"),
                F.col(f"__n_{n}").alias("n"),
            )
            for n in values
        ]
    )
    flat = met.select(*by, F.inline(found)).filter(F.col("v").isNotNull() & (F.col("v") <= F.col("hi")))
    # a null stands for all values below the bracket
    inside = flat.withColumn("v", F.when(F.col("v") >= F.col("lo"), F.col("v")))
    counted = inside.groupBy(*by, "which", "v").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    earlier = Window.partitionBy(*by, "which").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("first", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    result = []
    for n in values:
        own = F.col("which") == n
        low, high = (
            F.max(F.when(own & (F.col("first") <= at) & (F.col("first") + F.col("c") > at), F.col("v")))
            for at in (F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
        )
        result.append((low * 0.5 + high * 0.5).alias(n))
    return ranked.groupBy(*by).agg(*result)


def trial_summary(df: DataFrame, by: Sequence[str], objects: str = "objects", seconds: str = "seconds") -> DataFrame:
    """min, max, median, mean and sample deviation of rate and seconds per group of trials."""
    rate = F.col(objects) / F.col(seconds)

    def four(value, name):  # noqa: ANN001, ANN202
        return [
            F.min(value).alias(f"min_{name}"),
            F.max(value).alias(f"max_{name}"),
            F.avg(value).alias(f"avg_{name}"),
            F.stddev_samp(value).alias(f"stddev_{name}"),
        ]

    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("measurements"), *four(rate, "rate"), *four(F.col(seconds), "seconds"))
    medians = _keyed(exact_medians(df, by, {"median_rate": rate, "median_seconds": F.col(seconds)}), by).drop(*by)
    out = _keyed(out, by).join(medians, _KEY, "left").drop(_KEY)
    order = ["min", "max", "median", "avg", "stddev"]
    return out.select(*by, "measurements", *[f"{k}_{name}" for name in ("rate", "seconds") for k in order])
