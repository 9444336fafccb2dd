"""Lines that many fixture contents share, dropped from all of them but one.

Contents are exploded into lines, lines are normalised and hashed, and the
different fixtures of each hash are counted.  Where there are too many, the
line stays only in the fixture with the largest id, and contents are put
together again from what is left, by position.  All of it is DataFrame
operations; what is shuffled for the counts are hashes, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.session import cut

#: Lines with fewer code points stay, and so do those found in fewer fixtures.
LEAST_CHARS, LEAST_FIXTURES = 40, 5
#: A line with at least this part of all repeated ones is looked up without a shuffle; there can be no more such lines.
HOT_LINES = 10_000
# fixed values: what is stripped at both ends of a line
_BLANKS = " \t\n\v\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(value: Column) -> Column:
    """128 bits of a SHA-256; 10^13 different lines share one with a chance of 10^-13."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def _occurrences(rows: DataFrame, least_chars: int) -> DataFrame:
    """``id, row, at, line`` of each line that is long enough; ``line`` is the hash of its normal form."""
    lines = rows.select("id", "row", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    stripped = lines.select("id", "row", "at", F.btrim("line", F.lit(_BLANKS)).alias("line"))
    lowered = F.translate("line", _UPPER, _LOWER)
    return stripped.where(F.length("line") >= least_chars).select("id", "row", "at", _digest(lowered).alias("line"))


def _without(lines: Column, at: Column) -> Column:
    """The lines at other than the given rising positions; linear, as only stretches between them are copied."""
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda a: a + 1))
    ends = F.concat(at, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def drop_repeated_lines(
    contents: DataFrame, least_chars: int = LEAST_CHARS, least_fixtures: int = LEAST_FIXTURES
) -> DataFrame:
    """``id, content, n_lines, n_dropped`` for every row of ``contents`` (fixture ``id``, ``content``).

    Lines end at each ``\\n``.  Two are the same if they are equal once blanks
    are stripped at both ends and A to Z lowered.  One with at least
    ``least_chars`` code points, found in at least ``least_fixtures`` fixtures,
    is dropped from all of them but that with the largest id, where it stays as
    often as it stood there.

    A null content is an empty one, and both are one empty line.  Ids may have
    any type that has an order.  Rows with one id are one fixture, and rows
    without an id are one too, which comes before all others; equal rows give
    equal results.  Other columns are not looked at.  A content may be as long
    as a row can be: its lines meet in one row again.

    A line in very many fixtures is one row per task when hashes are counted,
    and is looked up in a table of at most ``HOT_LINES`` such lines afterwards,
    so neither lands in one task.
    """
    rows = contents.select("id", F.coalesce("content", F.lit("")).alias("content"))
    # rows that have an id in common are told apart by their contents
    rows = rows.withColumn("row", _digest(F.col("content")))
    found = _occurrences(rows, least_chars)
    holders = found.select("line", "id").distinct().groupBy("line").agg(F.count("*").alias("n"), F.max("id").alias("holder"))
    repeated = cut(holders.where(F.col("n") >= least_fixtures).withColumn("salt", F.lit(0).cast("bigint")))
    share = (repeated.agg(F.sum("n")).first()[0] or 0) / HOT_LINES
    hot = repeated.where(F.col("n") >= share).select("line", F.col("holder").alias("hot_holder"))
    rest = repeated.where(F.col("n") < share).drop("n")
    # lines that are settled already are spread over all tasks of the join
    spread = F.when(F.col("hot_holder").isNotNull(), F.xxhash64("row", "at")).otherwise(F.lit(0).cast("bigint"))
    looked_up = found.join(F.broadcast(hot), "line", "left").withColumn("salt", spread).join(rest, ["line", "salt"], "left")
    holder = F.coalesce("hot_holder", "holder")
    dropped = looked_up.where(holder.isNotNull() & ~F.col("id").eqNullSafe(holder))
    dropped = dropped.groupBy(F.col("id").alias("of"), F.col("row").alias("in")).agg(F.array_sort(F.collect_set("at")).alias("at"))
    both = rows.join(dropped, F.col("id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("in")), "left")
    split = both.select(
        "id", F.split("content", "\n").alias("lines"), F.coalesce("at", F.array().cast("array<int>")).alias("at")
    )
    return split.select(
        "id",
        F.array_join(_without(F.col("lines"), F.col("at")), "\n").alias("content"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size("at").cast("bigint").alias("n_dropped"),
    )
