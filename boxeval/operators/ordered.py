"""Row numbers and running values that survive one very large group.

A window sorts a whole group in one task.  Groups above ``limit`` rows are
taken out and sorted across the cluster instead: the range-sorted rows are
checkpointed, so partition number and position are fixed, and only one small
row per partition is needed to carry a group over a partition border.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxeval.operators.keys import join_groups
from boxeval.session import cut

GROUP_LIMIT = 1_000_000


def hot_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; counts combine before the shuffle."""
    return df.groupBy(*keys).count().where(F.col("count") > limit).select(*keys)


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of oversized ones if there are any."""
    hot = cut(hot_groups(df, keys, limit))
    if hot.isEmpty():
        return df, None
    return join_groups(df, hot, keys, "left_anti"), join_groups(df, hot, keys, "left_semi")


def _sorted_parts(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    lead = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(*lead, *order).sortWithinPartitions(*lead, *order)
    placed = cut(ranged).withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("_part", F.shiftright("_at", 33))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    value: Column,
    name: str,
    how: str = "sum",
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add ``name``: the sum or max of ``value`` from the group's start to this row."""
    fold = {"sum": F.sum, "max": F.max}[how]
    valued = df.withColumn("_v", value)
    small, big = split_hot(valued, keys, limit)
    to_here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = small.withColumn(name, fold("_v").over(to_here)).drop("_v")
    if big is None:
        return done

    parts = _sorted_parts(big, keys, order)
    in_part = (
        Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and group; groups here exceed the limit, so there are few
    carry = (
        parts.groupBy("_part", *keys)
        .agg(fold("_v").alias("_total"))
        .withColumn("_carry", fold("_total").over(before))
        .drop("_total")
    )
    local = parts.withColumn("_local", fold("_v").over(in_part))
    joined = join_groups(local, carry, ["_part", *keys])
    if how == "sum":
        total = F.col("_local") + F.coalesce("_carry", F.lit(0))
    else:
        total = F.greatest("_local", "_carry")
    return done.unionByName(
        joined.withColumn(name, total).drop("_v", "_at", "_part", "_local", "_carry")
    )


def row_numbers(
    df: DataFrame, keys: list[str], order: list[Column], name: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Add ``name``: position in the group, from 1."""
    one = F.lit(1).cast("bigint")
    return running(df, keys, order, one, name, "sum", limit)


def first_flag(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Mark the first row of each group without sorting any group.

    The minimum combines before its shuffle; the join back is one that
    adaptive execution can split when a key is skewed.  Null keys are a group,
    and nulls in ``order`` come first.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_first.{c}")) for c in order))
    return join_groups(df, first, keys).withColumn(name, same).drop("_first")
