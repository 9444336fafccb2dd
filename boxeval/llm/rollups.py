"""Token counts of fixtures, kept up to date by signed changes.

A change says what happened to one fixture's count: it was inserted, deleted
(with the count that it had), or revised (with the count before).  A batch of
changes becomes signed sums by source, language and tokenizer version, and is
committed as one partition of the rollup table.  Committing a batch again
replaces that partition: however often a batch is sent, it counts once.
Totals are the sums over all batches.

``compact`` adds the batches so far to stored totals and closes them, so that
a read meets the batches since then only.  Closed batches are in a ledger, and
one that is sent again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.streaming.sinks import remove_folder

GROUP = ("source", "language", "tokenizer")
SCHEMA = "source string, language string, tokenizer string, n_fixtures bigint, n_tokens bigint, batch_id bigint"
#: Below the table: one folder for each compaction.  Readers of partitions pass over names like this.
_STORED = "_stored"


def signed_sums(changes: DataFrame) -> DataFrame:
    """``batch_id`` and group with the signed ``n_fixtures`` and ``n_tokens`` of each.

    ``changes`` has ``batch_id, kind, source, language, tokenizer, n_tokens,
    prev_tokens``; kind is ``insert``, ``delete`` or ``revise``.  Null counts are
    0, other kinds change nothing, nulls in a group column are a group, and
    equal rows are changes of their own.  Sums are made before anything is
    shuffled, so a source with a third of all rows is no larger than others.
    """
    sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
    new = F.coalesce(F.col("n_tokens"), F.lit(0))
    revised = F.when(F.col("kind") == "revise", new - F.coalesce(F.col("prev_tokens"), F.lit(0)))
    tokens = F.coalesce(revised, sign * new)
    return changes.groupBy("batch_id", *GROUP).agg(
        F.sum(sign.cast("long")).alias("n_fixtures"), F.sum(tokens.cast("long")).alias("n_tokens")
    )


def commit(changes: DataFrame, table: str) -> None:
    """Write the batches that ``changes`` holds to the rollup table at ``table``.

    Each batch has to be whole.  A commit that broke off is mended by sending
    it again.  Changes without a batch id can't be sent twice and are refused.
    Batches that ``compact`` has closed are passed over.
    """
    known = F.when(F.col("batch_id").isNull(), F.raise_error(F.lit("a change has no batch_id"))).otherwise(F.col("batch_id"))
    sums = signed_sums(changes).withColumn("batch_id", known.cast("long"))
    sums = _open(sums, table)
    # a batch is a few rows: one file each
    sums.select(*GROUP, "n_fixtures", "n_tokens", "batch_id").repartition("batch_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch_id").parquet(table)


def totals(spark: SparkSession, table: str) -> DataFrame:
    """``source, language, tokenizer, n_fixtures, n_tokens`` over all committed batches.

    Groups whose fixtures have all been deleted stay, with zeros.
    """
    rows = _open(spark.read.schema(SCHEMA).parquet(table), table).drop("batch_id")
    last = _last_stored(spark, table)
    return _summed(rows.unionByName(spark.read.parquet(f"{last}/totals")) if last else rows)


def compact(spark: SparkSession, table: str) -> None:
    """Add all committed batches to the stored totals, close them and delete their partitions.

    The ledger of closed batches is written before the totals, which are made
    from the batches in it, and a mark after them: what broke off before that
    mark does not count and is written again by the next call, and what broke
    off after it is cleared away then.  Batches may be committed meanwhile, but
    none that has been committed before; and nothing may read meanwhile.
    """
    rows, last = spark.read.schema(SCHEMA).parquet(table), _last_stored(spark, table)
    number = int(last.rsplit("/", 1)[1]) + 1 if last else 1
    folder = f"{table}/{_STORED}/{number}"
    seen = rows.select("batch_id").distinct()
    ledger = seen.unionByName(spark.read.parquet(f"{last}/closed")).distinct() if last else seen
    ledger.write.mode("overwrite").parquet(f"{folder}/closed")
    closing = _open(rows.join(spark.read.parquet(f"{folder}/closed"), "batch_id", "left_semi"), table).drop("batch_id")
    stored = closing.unionByName(spark.read.parquet(f"{last}/totals")) if last else closing
    _summed(stored).write.mode("overwrite").parquet(f"{folder}/totals")
    files, mark = _files(spark, f"{folder}/whole")
    files.create(mark, True).close()
    for batch in seen.join(spark.read.parquet(f"{folder}/closed"), "batch_id", "left_semi").toLocalIterator():
        remove_folder(spark, f"{table}/batch_id={batch.batch_id}")
    for older in _stored_numbers(spark, table):
        if older < number:
            remove_folder(spark, f"{table}/{_STORED}/{older}")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("n_fixtures").alias("n_fixtures"), F.sum("n_tokens").alias("n_tokens"))


def _open(rows: DataFrame, table: str) -> DataFrame:
    """Rows of batches that are not closed."""
    last = _last_stored(rows.sparkSession, table)
    return rows.join(rows.sparkSession.read.parquet(f"{last}/closed"), "batch_id", "left_anti") if last else rows


def _last_stored(spark: SparkSession, table: str) -> str | None:
    """The folder of the last compaction that came to its end."""
    marks = {n: _files(spark, f"{table}/{_STORED}/{n}/whole") for n in _stored_numbers(spark, table)}
    whole = [n for n, (files, mark) in marks.items() if files.exists(mark)]
    return f"{table}/{_STORED}/{max(whole)}" if whole else None


def _stored_numbers(spark: SparkSession, table: str) -> list[int]:
    files, root = _files(spark, f"{table}/{_STORED}")
    return [int(f.getPath().getName()) for f in files.listStatus(root)] if files.exists(root) else []


def _files(spark: SparkSession, path: str):
    """The store that ``path`` is in, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
