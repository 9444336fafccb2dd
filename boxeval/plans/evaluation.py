"""The evaluation as one chain: pair, match, score, measure, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxeval.functions.numbers import safe_ratio
from boxeval.operators import matching as J
from boxeval.operators.metrics import score_paired, score_predictions


def score_pages(
    pred: DataFrame, truth: DataFrame, inputs: DataFrame, given: bool = False, boxes: DataFrame | None = None
) -> DataFrame:
    """Records of all predictions.  Inputs that were ``given`` their box have one
    truth and one prediction each, which belong together whatever their IoU.

    Pages with few boxes are paired and scored in one go.  ``boxes`` tells which
    have many, where something cheaper to read than both sides has a row of its
    ``page`` for each box.
    """
    large = J.large_pages(pred.select("page").unionByName(truth.select("page")) if boxes is None else boxes)
    if large is None:
        return score_paired(J.paired_boxes(pred, truth, given=given), inputs)
    few, (pred, truth) = J.split_pages(pred, truth, large)
    records = score_paired(J.paired_boxes(*few, given=given), inputs)
    if given:
        together = pred.select("page", "p").join(truth.select("page", "a"), "page")
        paired = together.withColumn("iou", F.lit(1.0)).withColumn("duplicate", F.lit(False))
    else:
        paired = J.pairing(pred, truth)
    return records.unionByName(score_predictions(pred, truth, paired, inputs))


def detector_quality(pred: DataFrame, truth: DataFrame, groups: DataFrame) -> DataFrame:
    """Precision and recall per group of pages; pages without boxes count too.

    Truths, predictions and matches are counted per page first, so one row per
    page and kind meets the group table.
    """
    match = J.greedy_match(pred, truth)
    kinds = [("expected_boards", truth), ("predictions", pred), ("matched", match)]
    counted = None
    for name, df in kinds:
        part = df.groupBy("page").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    names = [name for name, _ in kinds]
    per_page = counted.groupBy("page").agg(
        *(F.sum(F.when(F.col("kind") == n, F.col("n")).otherwise(0)).alias(n) for n in names)
    )
    summed = (
        groups.join(per_page, "page", "left")
        .groupBy("page_group")
        .agg(F.count("*").alias("pages"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    )
    return (
        summed.withColumn("missed", F.col("expected_boards") - F.col("matched"))
        .withColumn("false_positive", F.col("predictions") - F.col("matched"))
        .withColumn("precision", safe_ratio(F.col("matched"), F.col("predictions")))
        .withColumn("recall", safe_ratio(F.col("matched"), F.col("expected_boards")))
    )
