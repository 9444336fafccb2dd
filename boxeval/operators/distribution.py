"""Exact nearest-rank percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxeval.operators.keys import join_groups

_QUANTILES = {"p50": 0.5, "p95": 0.95}
#: Steps per power of e, and steps of each of those; numbers of the outermost coarse buckets.
_COARSE, _FINE = 64, 65_536
_INFINITE, _NAN = 1_000_000, 2_000_000


def _buckets(value: Column) -> tuple[Column, Column]:
    """Two numbers that rise with the value: a coarse one, and a fine one inside of it."""
    x = value.cast("double")
    scale = F.log(F.abs(x)) * _COARSE
    finite = F.abs(x) < F.lit(float("inf"))
    whole = F.floor(scale)
    coarse = (
        F.when(F.isnan(x), F.lit(_NAN))
        .when(x == 0, F.lit(0))
        .when(finite, F.signum(x) * (whole + 100_000))
        .otherwise(F.signum(x) * _INFINITE)
    )
    fine = F.when(~F.isnan(x) & (x != 0) & finite, F.signum(x) * F.floor((scale - whole) * _FINE)).otherwise(F.lit(0))
    return coarse.cast("bigint"), fine.cast("bigint")


def distribution(df: DataFrame, keys: list[str], value: str, prefix: str = "", weight: str | None = None) -> DataFrame:
    """Count, min, p50, p95 and max of ``value`` per group; ``weight`` counts equal values.

    Null values don't count, and a group of nothing else has count 0 and nulls.
    A null key is a group.  NaN is larger than all numbers.

    Equal values are counted first, before they are shuffled.  The wanted rank
    is then located among coarse buckets of the value's logarithm, among fine
    buckets inside that one, and last among the values of the fine bucket, so
    no task holds a group.
    """
    coarse, fine = _buckets(F.col("_v"))
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    there = F.col("_v").isNotNull()
    total = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(there, F.col("_n"))), F.lit(0).cast("bigint")).alias("_total"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    placed = counts.where(there).withColumn("_coarse", coarse).withColumn("_fine", fine)
    ranks = [F.struct(F.lit(q).alias("q"), F.ceil(F.lit(p) * F.col("_total")).alias("rank")) for q, p in _QUANTILES.items()]
    want = total.select(*keys, F.explode(F.array(*ranks)).alias("w")).select(*keys, "w.q", "w.rank")
    path = list(keys)
    for level in ("_coarse", "_fine", "_v"):
        sums = join_groups(placed, want, path).groupBy(*path, "q", "rank", level).agg(F.sum("_n").alias("n"))
        upto = Window.partitionBy(*path, "q").orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        summed = sums.withColumn("upto", F.sum("n").over(upto))
        holds = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
        rest = (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")
        want = summed.where(holds).select(*path, level, "q", rest)
        path.append(level)
    found = want.groupBy(*keys).agg(*(F.max(F.when(F.col("q") == q, F.col("_v"))).alias(q) for q in _QUANTILES))
    return join_groups(total, found, keys, "left").select(
        *keys,
        F.col("_total").alias(prefix + "count"),
        F.col("_min").alias(prefix + "min"),
        *(F.col(q).alias(prefix + q) for q in _QUANTILES),
        F.col("_max").alias(prefix + "max"),
    )


def cold_warm(df: DataFrame, keys: list[str], value: str, cold: str) -> DataFrame:
    """The summary for cold rows, warm rows and all rows of each group; equal values are counted once for all three."""
    counted = df.groupBy(*keys, cold, value).agg(F.count("*").alias("_rows"))
    halves = distribution(counted, [*keys, cold], value, weight="_rows")
    whole = distribution(counted, keys, value, "all_", weight="_rows")
    names = ["count", "min", *_QUANTILES, "max"]
    picked = [
        F.max(F.when(F.col(cold) == flag, F.col(n))).alias(prefix + n)
        for prefix, flag in (("cold_", True), ("warm_", False))
        for n in names
    ]
    split = halves.groupBy(*keys).agg(*picked)
    counts = {p + "count": F.coalesce(p + "count", F.lit(0).cast("bigint")) for p in ("cold_", "warm_")}
    return join_groups(split.withColumns(counts), whole, keys)
