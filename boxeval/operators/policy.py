"""Licence expressions against a policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: words of a licence line and the identifier they stand for
ALIASES = [
    ("Apache License, Version 2.0", "Apache-2.0"),
    ("MIT License", "MIT"),
    ("GNU General Public License, version 3", "GPL-3.0"),
    ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
]
LICENCE_LINE = r"(?i)licen[sc]e|released under"


def parse_expression(text: Column) -> Column:
    """``kind`` (or, and, plain), the parts, and whether both operators occur.

    One outer pair of parentheses is removed; OR is looked for before AND, so a
    mixed expression is split at OR and flagged.
    """
    trimmed = F.trim(text)
    wrapped = trimmed.startswith("(") & trimmed.endswith(")")
    inner = F.trim(F.substring(trimmed, F.lit(2), F.length(trimmed) - 2))
    bare = F.when(wrapped, inner).otherwise(trimmed)
    has_or, has_and = bare.contains(" OR "), bare.contains(" AND ")

    def split(word: str) -> Column:
        return F.transform(F.split(bare, f" {word} "), lambda p: F.trim(p))

    return F.struct(
        F.when(has_or, F.lit("or")).when(has_and, F.lit("and")).otherwise(F.lit("plain")).alias("kind"),
        F.when(has_or, split("OR")).when(has_and, split("AND")).otherwise(F.array(bare)).alias("parts"),
        (has_or & has_and).alias("mixed"),
    )


def is_allowed(parsed: Column, allowed: list[str]) -> Column:
    """One allowed part is enough for OR; AND and plain need all of them."""
    some = F.exists(parsed["parts"], lambda p: p.isin(allowed))
    every = F.forall(parsed["parts"], lambda p: p.isin(allowed))
    return F.when(parsed["kind"] == "or", some).otherwise(every)


def without_exceptions(inventory: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Rows not exempt; an exception names package and licence expression."""
    return inventory.join(exceptions.select("name", "licence"), ["name", "licence"], "left_anti")


def find_violations(inventory: DataFrame, allowed: list[str], exceptions: DataFrame) -> DataFrame:
    checked = without_exceptions(inventory, exceptions)
    return checked.where(~is_allowed(parse_expression(F.col("licence")), allowed))


def licence_line(text: Column) -> Column:
    """The first line that speaks of a licence, or null."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(LICENCE_LINE))
    return F.when(text.rlike(LICENCE_LINE), F.get(lines, F.lit(0)))


def detect_licence(text: Column) -> Column:
    """Identifier of the licence line's wording; ``unknown`` when it has another."""

    def named(line: Column) -> Column:
        found = F.when(line.isNull(), F.lit(None).cast("string"))
        for words, name in ALIASES:
            found = found.when(F.contains(line, F.lit(words)), F.lit(name))
        return found.otherwise(F.lit("unknown"))

    # the line is looked for once and then compared with every wording
    return F.get(F.transform(F.array(licence_line(text)), named), F.lit(0))


def inventory_count(inventory: DataFrame) -> DataFrame:
    """Packages per licence, and in total in the row without a licence."""
    return inventory.rollup("licence").agg(F.count("*").alias("packages"))
