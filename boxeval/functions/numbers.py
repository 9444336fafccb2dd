"""Scalar rules shared by summaries and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Null on a zero denominator, also under ANSI mode."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(hit, F.lit(name)) for hit, name in rules)))


def strict_double(text: Column) -> Column:
    """A finite decimal number, else null; no hex, suffix or blank forms."""
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    value = F.when(plain, F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def strict_duration(text: Column) -> Column:
    value = strict_double(text)
    return F.when(value >= 0, value)


def strict_boolean(text: Column) -> Column:
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))
