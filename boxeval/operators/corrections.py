"""Edits on boards and per-cell readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_corrections(boards: DataFrame, edits: DataFrame) -> DataFrame:
    """The latest edit of a cell wins; corrected boards lose their confidences.

    ``edits`` has ``vec_id, square, value, ts, edit_id``.  The newest edit per
    cell combines before the shuffle; what is gathered per board has at most
    64 entries.
    """
    newest = edits.groupBy("vec_id", "square").agg(
        F.max_by("value", F.struct("ts", "edit_id")).alias("value")
    )
    packed = newest.groupBy("vec_id").agg(
        F.map_from_entries(F.collect_list(F.struct("square", "value"))).alias("edits")
    )
    joined = boards.join(packed, "vec_id", "left")
    corrected = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.coalesce(
            F.try_element_at("edits", i), F.substring(F.col("cells"), i + 1, F.lit(1))
        ),
    )
    edited = F.col("edits").isNotNull()
    return (
        joined.withColumn("cells", F.when(edited, F.array_join(corrected, "")).otherwise(F.col("cells")))
        .withColumn("confidences", F.when(~edited, F.col("confidences")))
        .withColumn("corrected", edited)
        .drop("edits")
    )


def cell_rows(boards: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell: its confidence and whether it was read right.

    Confidences are kept bottom-left first, cells top-left first.
    """
    from boxeval.functions.boards import board_order

    zipped = F.arrays_zip(
        board_order(F.col("confidences")).alias("confidence"),
        F.split("cells", "").alias("value"),
        F.split("truth_cells", "").alias("truth"),
    )
    rows = boards.select(*keys, F.posexplode(zipped).alias("square", "c"))
    return rows.select(
        *keys, "square", "c.confidence", "c.value", (F.col("c.value") == F.col("c.truth")).alias("correct")
    )


def label_values(cells: DataFrame, names: DataFrame) -> DataFrame:
    """Cell letters with their names; ``names`` is the fixed 12-row dimension."""
    return cells.join(F.broadcast(names), "value", "left")
