"""Which inputs to measure, and the truth each of them can see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.functions.geometry import Rect, pad_outward

PADDING = 0.08


def style_key(style: Column) -> Column:
    """Label of a square style struct ``kind, gray, angle, density``."""
    return (
        F.when(style["kind"] == "flat", F.concat(F.lit("flat-gray-"), style["gray"].cast("string")))
        .when(
            style["kind"] == "hatch",
            F.concat_ws("-", F.lit("hatch"), style["angle"].cast("string"), style["density"]),
        )
        .when(style["kind"] == "halftone", F.concat(F.lit("halftone-"), style["density"]))
    )


def page_styles(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """``negative``, the one style, or the sorted mix of a page's styles.

    What is gathered per page are distinct style labels, a small closed set.
    """
    found = truth.groupBy("page").agg(F.array_sort(F.collect_set("style")).alias("styles"))
    size = F.size("styles")
    label = (
        F.when(F.col("styles").isNull(), F.lit("negative"))
        .when(size == 1, F.element_at("styles", 1))
        .otherwise(F.concat(F.lit("mixed:"), F.array_join("styles", "+")))
    )
    return pages.join(found, "page", "left").withColumn("style", label).drop("styles")


def _rect(prefix: str = "") -> Rect:
    return Rect(*(F.col(prefix + c) for c in ("x", "y", "width", "height")))


def _crop(rect: Rect) -> list[Column]:
    return [c.alias(n) for c, n in zip(rect, ("crop_x", "crop_y", "crop_width", "crop_height"))]


def plan_inputs(pages: DataFrame, truth: DataFrame) -> DataFrame:
    """One exact input per complete truth, one padded per truth, one per page.

    ``pages`` has ``page, page_width, page_height``; ``truth`` has ``page, a, kind,
    style, x, y, width, height``.
    """
    page_of = truth.join(pages, "page")
    padded = pad_outward(_rect(), PADDING, F.col("page_width"), F.col("page_height"))
    exact = F.struct(F.lit("classifier").alias("stage"), F.lit(True).alias("oracle"), *_crop(_rect()))
    manual = F.struct(F.lit("manual").alias("stage"), F.lit(False).alias("oracle"), *_crop(padded))
    # both inputs of a truth come from one pass over it
    wanted = F.when(F.col("kind") == "complete", F.array(exact, manual)).otherwise(F.array(manual))
    crops = ("crop_x", "crop_y", "crop_width", "crop_height")
    boxed = page_of.withColumn("i", F.explode(wanted)).select(
        F.concat_ws(":", "i.stage", F.col("page").cast("string"), "a").alias("input_id"),
        "page", "i.stage", "style", "a", "i.oracle", *(F.col(f"i.{c}") for c in crops),
    )
    whole = page_styles(pages, truth).select(
        F.concat(F.lit("full-page:"), F.col("page").cast("string")).alias("input_id"),
        "page",
        F.lit("full-page").alias("stage"),
        "style",
        F.lit(None).cast(truth.schema["a"].dataType).alias("a"),
        F.lit(False).alias("oracle"),
        F.lit(0.0).alias("crop_x"),
        F.lit(0.0).alias("crop_y"),
        F.col("page_width").alias("crop_width"),
        F.col("page_height").alias("crop_height"),
    )
    return boxed.unionByName(whole)


def plan_truth(plan: DataFrame, truth: DataFrame) -> DataFrame:
    """Complete truths visible to each input, seen from its crop."""
    whole = truth.where(F.col("kind") == "complete").select(
        "page", F.col("a").alias("truth_a"), "x", "y", "width", "height"
    )
    # an input made for one truth meets only that one; the rest meet their page
    single = plan.where(F.col("a").isNotNull()).join(
        whole, (plan["page"] == whole["page"]) & (plan["a"] == whole["truth_a"])
    ).drop(whole["page"])
    full = plan.where(F.col("a").isNull()).join(whole, "page")
    names = ["page", "input_id", "truth_a"]

    def seen(df: DataFrame) -> DataFrame:
        return df.select(
            *names,
            (F.col("x") - F.col("crop_x")).alias("x0"),
            (F.col("y") - F.col("crop_y")).alias("y0"),
            (F.col("x") + F.col("width") - F.col("crop_x")).alias("x1"),
            (F.col("y") + F.col("height") - F.col("crop_y")).alias("y1"),
        )

    return seen(single).unionByName(seen(full))


def assign_split(df: DataFrame, key: str, dev_ids: DataFrame) -> DataFrame:
    """``development`` for listed keys, else ``held-out``."""
    listed = dev_ids.select(key).distinct().withColumn("_dev", F.lit(True))
    split = F.when(F.col("_dev"), F.lit("development")).otherwise(F.lit("held-out"))
    return df.join(listed, key, "left").withColumn("split", split).drop("_dev")


def sweep_grid(base: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Every combination of the parameter lists for each row of ``base``.

    ``expected`` is the number of combinations, for a later completeness check.
    """
    grid, expected = base, 1
    for name, values in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
        expected *= len(values)
    return grid.withColumn("expected", F.lit(expected).cast("bigint"))


def oracle_predictions(truth: DataFrame) -> DataFrame:
    """Perfect predictions built from truth, with full confidence."""
    facing = F.when(F.col("orientation") == "black", F.lit("black")).otherwise(F.lit("white"))
    return truth.select(
        "page",
        F.col("a").alias("p"),
        "x0",
        "y0",
        "x1",
        "y1",
        "cells",
        F.lit(1.0).alias("min_conf"),
        facing.alias("orientation"),
        F.lit(False).alias("orientation_ambiguous"),
    )


def attach_plan(obs: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """Plan columns for each observation; ``planned`` is false for unknown inputs."""
    known = plan.withColumn("planned", F.lit(True))
    joined = obs.join(known, key, "left")
    return joined.withColumn("planned", F.coalesce("planned", F.lit(False)))


def expected_grid(sessions: DataFrame, keys: list[str], runs_per_session: int) -> DataFrame:
    """Every (session, run) that should exist; runs come from a short sequence."""
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(runs_per_session - 1).cast("bigint"))
    return sessions.select(*keys).distinct().withColumn("run", F.explode(numbers))


def missing_runs(sessions: DataFrame, runs: DataFrame, keys: list[str], runs_per_session: int) -> DataFrame:
    wanted = expected_grid(sessions, keys, runs_per_session)
    return wanted.join(runs, [*keys, "run"], "left_anti")
