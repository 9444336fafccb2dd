"""What the operators of this subpackage share: input columns, batch sizes, bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contents handed to a Python worker at a time; long contents must not add up to a large batch.
BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
_RESOLUTION = 1 << 30


def bounded_batches(spark: SparkSession) -> None:
    """Hand at most ``BATCH_ROWS`` rows at a time to Python workers, in the whole session."""
    if not 0 < int(spark.conf.get(_BATCHES)) <= BATCH_ROWS:
        spark.conf.set(_BATCHES, str(BATCH_ROWS))


def fixture_contents(df: DataFrame, fixture_id: str, content: str) -> DataFrame:
    """``id`` and ``content`` of a table; its other columns are left behind, so none can clash."""
    return df.select(F.col(fixture_id).alias("id"), F.col(content).alias("content"))


def new_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores before it as it takes to be none of the ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def held_out(fixture_id: Column) -> Column:
    """Is this fixture kept from training? A fifth is; a fixture without an id is not."""
    return F.coalesce(F.crc32(fixture_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(contents: DataFrame, verdicts: DataFrame, rows: int) -> DataFrame:
    """``id, content, verdict`` of about ``rows`` judged contents, or of all if there are fewer.

    ``verdicts`` has ``id`` and ``verdict`` (0 or 1).  Rows where either is null
    don't count; of several verdicts on one id the largest holds.  The choice
    depends on ids only, so it is the same on each run.  The chosen verdicts
    are bounded by ``rows`` and hence broadcast; contents are not shuffled.
    """
    known = verdicts.where(F.col("id").isNotNull() & F.col("verdict").isNotNull())
    known = known.groupBy("id").agg(F.max("verdict").cast("int").alias("verdict"))
    there = known.count()
    if there > rows:
        at = F.pmod(F.xxhash64("id"), F.lit(_RESOLUTION))
        known = known.where(at < F.lit(int(_RESOLUTION * rows / there)))
    return contents.select("id", "content").join(F.broadcast(known), "id")


#: A key with at least this part of all rows is joined without a shuffle; there can be no more such keys.
HOT_KEYS = 10_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` with what ``facts`` says about their ``key``; rows of no fact go.

    ``facts`` has one row per key, and the number of rows with that key as
    ``n``, which is not returned.  Keys that many rows have are looked up in a
    table of at most ``HOT_KEYS`` of them, so that no task gets all of a key.
    """
    share = (facts.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(facts.where(F.col(n) >= share).drop(n))
    rest = facts.where(F.col(n) < share).drop(n)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key))
