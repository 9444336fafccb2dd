"""Running a bounded stream to its end and reading the final state."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxeval.session import checkpoint_root, cut


def work_folder(spark, name: str) -> str:
    """A new folder for one run, next to the checkpoints."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark, path: str) -> None:
    """Delete a work folder, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def replay(rows: DataFrame, order: str, steps: int = 3, bounds: list | None = None):
    """A stream over ``rows`` that delivers them in ``steps`` along ``order``; its files go when the block ends.

    A step ends with the rows whose ``order`` is one of the ``bounds``, which
    are shares of the rows unless they are given.

    The file source takes older files first, so each step is written after the
    one before it, by as many tasks as the session shuffles with.  Rows whose
    ``order`` is null come first.
    """
    spark = rows.sparkSession
    folder = work_folder(spark, "source")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_kept = cut(rows)
    if bounds is None:
        shares = [i / steps for i in range(1, steps)]
        bounds = rows_kept.agg(F.percentile_approx(order, shares).alias("b")).first().b or []
    step = sum((F.coalesce(F.col(order) > F.lit(b), F.lit(False)).cast("int") for b in bounds), F.lit(0))
    for number in range(len(bounds) + 1):
        rows_kept.where(step == number).repartition(tasks).write.mode("append").parquet(folder)
    try:
        yield spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", tasks).parquet(folder)
    finally:
        remove_folder(spark, folder)


def final_state(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run all available input and return the last row written per key.

    Each batch writes only the rows it changed, under its number, so a batch
    that runs twice replaces itself.
    """
    spark = stream.sparkSession
    folder, progress = work_folder(spark, "state"), work_folder(spark, "progress")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    run = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    written = spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(folder)
    rest = [c for c in stream.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "batch").alias("r")
    state = cut(written.groupBy(*keys).agg(last).select(*keys, "r.*").select(*stream.columns))
    remove_folder(spark, folder)
    remove_folder(spark, progress)
    return state


def appended(stream: DataFrame) -> DataFrame:
    """Run all available input of an append-only stream and read what it wrote."""
    return appended_with_progress(stream)[0]


def appended_with_progress(stream: DataFrame) -> tuple[DataFrame, list[dict]]:
    """As :func:`appended`, with the progress of each batch's first stateful step: ``numRowsTotal``, ``numRowsDroppedByWatermark``, ...

    Spark keeps the newest hundred batches
    (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    spark = stream.sparkSession
    folder, progress = work_folder(spark, "rows"), work_folder(spark, "progress")
    run = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", folder)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    rows = cut(spark.read.schema(stream.schema).parquet(folder))
    remove_folder(spark, folder)
    remove_folder(spark, progress)
    states = [json.loads(p.json)["stateOperators"] for p in run.recentProgress]
    return rows, [operators[0] for operators in states if operators]


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
