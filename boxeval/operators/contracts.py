"""Checks that turn bad rows into a violations table.

Every check returns ``entity, row_id, path, message`` and drops nothing
silently; ``fail_fast`` raises at the first violation a task meets instead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.functions.boards import mean_confidence


class Rule(NamedTuple):
    """``ok`` must be true; false and null are violations."""

    path: str
    message: str
    ok: Column


def _finding(path: Column, message: Column) -> Column:
    return F.struct(path.alias("path"), message.alias("message"))


def _listed(df: DataFrame, entity: str, row_id: Column, findings: Column, fail_fast: bool) -> DataFrame:
    rows = df.select(F.lit(entity).alias("entity"), row_id.cast("string").alias("row_id"), F.explode(findings).alias("f"))
    found = rows.select("entity", "row_id", "f.path", "f.message")
    if not fail_fast:
        return found
    text = F.concat_ws(" ", "entity", "row_id", "path", "message")
    return found.withColumn("message", F.coalesce(F.raise_error(text).cast("string"), "message"))


def broken(rules: list[Rule]) -> Column:
    """The findings of one row, in rule order."""
    return F.array_compact(
        F.array(
            *(
                F.when(~F.coalesce(r.ok, F.lit(False)), _finding(F.lit(r.path), F.lit(r.message)))
                for r in rules
            )
        )
    )


def check_fields(
    df: DataFrame, entity: str, row_id: Column, rules: list[Rule], fail_fast: bool = False
) -> DataFrame:
    return _listed(df, entity, row_id, broken(rules), fail_fast)


def check_keys(df: DataFrame, entity: str, row_id: Column, json: Column, allowed: list[str]) -> DataFrame:
    """Unexpected and missing properties of a JSON object."""
    names = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    want = F.array(*(F.lit(a) for a in allowed))
    extra = F.transform(F.array_except(names, want), lambda n: _finding(n, F.lit("unexpected property")))
    gone = F.transform(F.array_except(want, names), lambda n: _finding(n, F.lit("missing property")))
    return _listed(df, entity, row_id, F.concat(extra, gone), False)


def check_unique(df: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Keys that occur more than once within their scope."""
    counted = df.groupBy(*scope, key).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") > 1)


def check_references(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """Keys on one side only, in both directions."""

    def lone(a: DataFrame, b: DataFrame, name: str, other: str) -> DataFrame:
        return (
            a.select(key).distinct().join(b.select(key), key, "left_anti")
            .select(F.lit(name).alias("entity"), F.col(key).cast("string").alias("row_id"), F.lit("not in " + other).alias("message"))
        )

    return lone(left, right, left_name, right_name).unionByName(lone(right, left, right_name, left_name))


def check_coverage(df: DataFrame, tags: str, required: dict[str, int]) -> DataFrame:
    """Required tags with their number of rows and whether it is enough."""
    counted = df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    wanted = F.explode(
        F.array(*(F.struct(F.lit(t).alias("tag"), F.lit(n).cast("bigint").alias("at_least")) for t, n in required.items()))
    )
    needed = df.sparkSession.range(1).select(wanted.alias("w")).select("w.tag", "w.at_least")
    joined = needed.join(counted, "tag", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    return joined.withColumn("covered", F.col("n") >= F.col("at_least"))


def check_constants(df: DataFrame, entity: str, row_id: Column, expected: dict[str, object]) -> DataFrame:
    """Columns locked to one value."""
    rules = [Rule(c, f"must equal {v}", F.col(c) == F.lit(v)) for c, v in expected.items()]
    return check_fields(df, entity, row_id, rules)


def quarantine(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the reasons they were set aside."""
    checked = df.withColumn("reasons", F.transform(broken(rules), lambda f: f["message"]))
    bad = F.size("reasons") > 0
    return checked.where(~bad).drop("reasons"), checked.where(bad)


def aggregate_rules(confidences: Column, low: Column, mean: Column) -> list[Rule]:
    """Stored minimum and mean must agree with their vector."""
    return [
        Rule("min_conf", "contradicts vector", F.abs(F.array_min(confidences) - low) <= 1e-6),
        Rule("mean_conf", "contradicts vector", F.abs(mean_confidence(confidences) - mean) <= 1e-6),
    ]


def confidence_rules(confidences: Column) -> list[Rule]:
    return [
        Rule("confidences", "must hold 64 values", F.size(confidences) == 64),
        Rule("confidences", "must lie in [0, 1]", F.forall(confidences, lambda v: v.between(0.0, 1.0) & ~F.isnan(v))),
    ]


def measurement_rules(confidences: Column, low: Column, mean: Column) -> list[Rule]:
    """All that must hold of one prediction's confidences."""
    return [*confidence_rules(confidences), *aggregate_rules(confidences, low, mean)]


def input_problems(inputs: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """``page, reason`` for inputs that can't be measured.

    ``inputs`` has ``page, width, height, oracle``; sides are positive, ids of
    annotations and predictions are unique on a page, and an input that was
    given its box has one annotation and one prediction.
    """

    def counted(df: DataFrame, index: str, name: str) -> DataFrame:
        per_id = df.groupBy("page", index).agg(F.count("*").alias("_n"))
        return per_id.groupBy("page").agg(F.sum("_n").alias(name), F.max("_n").alias(name + "_most"))

    def number(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    joined = inputs.join(counted(truth, "a", "truths"), "page", "left").join(counted(pred, "p", "preds"), "page", "left")
    sides = F.col("width").between(1e-300, 1e300) & F.col("height").between(1e-300, 1e300)
    alone = ~F.col("oracle") | ((number("truths") == 1) & (number("preds") == 1))
    rules = [
        Rule("size", "page-size", sides),
        Rule("a", "duplicate-annotation", number("truths_most") <= 1),
        Rule("p", "duplicate-prediction", number("preds_most") <= 1),
        Rule("oracle", "oracle-not-one-to-one", alone),
    ]
    return joined.select("page", F.explode(F.transform(broken(rules), lambda f: f["message"])).alias("reason"))


def region_rules(width: Column, height: Column, data: Column, channels: int, low: int = 8, high: int = 4096) -> list[Rule]:
    """Whole sides within limits, a sample per pixel and channel, values 0 to 255."""
    return [
        Rule("width", f"must be {low} to {high}", width.between(low, high)),
        Rule("height", f"must be {low} to {high}", height.between(low, high)),
        Rule("data", "length must match the size", F.size(data) == width * height * channels),
        Rule("data", "samples must be 0 to 255", F.forall(data, lambda v: v.between(0.0, 255.0) & ~F.isnan(v))),
    ]
