"""Joins on group keys in which a null is a group like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, nulls matching nulls; the keys of ``left`` stay."""
    other = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(other)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()))
    return left.join(right, same, how).drop(*other.values())
