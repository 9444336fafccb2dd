"""Scores per prediction and input, and their grouped summaries.

Every summary adds up columns that partial aggregation combines before the
shuffle, so a group that holds a third of all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.functions.boards import correct_cells, is_reliable
from boxeval.functions.geometry import box, grid_error, in_bounds
from boxeval.functions.numbers import reasons, safe_ratio
from boxeval.operators.distribution import cold_warm, distribution
from boxeval.operators.keys import join_groups

GRID_ERROR_LIMIT = 0.08
COUNTS = [
    "expected_boards",
    "predictions",
    "exact",
    "correct_squares",
    "expected_squares",
    "reliable",
    "reliable_exact",
    "reliable_wrong",
    "reliable_wrong_study",
    "identifiable",
    "correct_orientations",
    "ambiguous_truth",
    "ambiguous_predictions",
    "ambiguity_acknowledged",
    "out_of_image",
]
# null for inputs that were given their box
DETECTION = ["matched", "missed", "false_positive", "duplicate", "aligned"]
COMPARED = [
    "expected_boards", "predictions", "exact", "correct_squares", *DETECTION, "precision", "recall", "exact_rate", "square_rate",
    "reliable", "unreliable", "reliable_exact", "reliable_wrong", "reliable_wrong_study", "out_of_image",
    "correct_orientations", "orientation_rate",
]


def score_predictions(
    pred: DataFrame, truth: DataFrame, paired: DataFrame, inputs: DataFrame
) -> DataFrame:
    """One record per prediction: what it matched and whether it read it right.

    ``pred`` has ``cells, min_conf, orientation, orientation_ambiguous``, ``truth``
    has ``cells, orientation``, ``inputs`` has ``width, height, oracle`` and ``paired``
    holds the matches and duplicates of ``matching.pairing``.
    """
    known = truth.select(
        "page", "a", F.col("cells").alias("true_cells"), F.col("orientation").alias("true_orientation"),
        *(F.col(e).alias("t" + e) for e in ("x0", "y0", "x1", "y1")),
    )
    joined = (
        pred.join(paired, ["page", "p"], "left").join(known, ["page", "a"], "left").join(inputs, "page")
    )
    return score_joined(joined)


def score_paired(rows: DataFrame, inputs: DataFrame) -> DataFrame:
    """As :func:`score_predictions`, of rows that hold a prediction, its pair and its truth (``matching.paired_boxes``)."""
    boxes = rows.schema["pred"].dataType.names
    joined = rows.select(
        "page",
        *(F.col("pred")[c].alias(c) for c in boxes),
        *(F.col("pair")[c].alias(c) for c in ("a", "iou", "duplicate")),
        F.col("truth.cells").alias("true_cells"),
        F.col("truth.orientation").alias("true_orientation"),
        *(F.col("truth")[e].alias("t" + e) for e in ("x0", "y0", "x1", "y1")),
    )
    return score_joined(joined.join(inputs, "page"))


def score_joined(joined: DataFrame) -> DataFrame:
    """Records of predictions that stand beside their pair, truth and input."""
    matched = F.col("a").isNotNull()
    given = F.col("oracle")
    facing = F.when(
        matched & (F.col("true_orientation") != "ambiguous"),
        ~F.col("orientation_ambiguous") & (F.col("orientation") == F.col("true_orientation")),
    )
    compared = joined.select(
        "page",
        "p",
        "oracle",
        in_bounds(box(), F.col("width"), F.col("height")).alias("in_image"),
        is_reliable(F.col("min_conf")).alias("reliable"),
        F.col("a").alias("matched_a"),
        (~given & F.coalesce("duplicate", F.lit(False))).alias("duplicate"),
        F.when(~given, F.col("iou")).alias("iou"),
        F.when(~given & matched, grid_error(box(), box("t"))).alias("grid_error"),
        F.when(matched, correct_cells(F.col("cells"), F.col("true_cells"))).alias("correct_squares"),
        facing.alias("orientation_correct"),
        (matched & (F.col("true_orientation") == "ambiguous")).alias("truth_ambiguous"),
        F.col("orientation_ambiguous"),
    )
    wrong = F.col("reliable") & ~F.coalesce(F.col("correct_squares") == 64, F.lit(False))
    return (
        compared.withColumn("exact", F.col("correct_squares") == 64)
        .withColumn("reliable_wrong", wrong)
        .withColumn(
            "reliable_wrong_study",
            wrong | (F.col("reliable") & ~F.coalesce("orientation_correct", F.lit(True))),
        )
    )


def measure_input(
    records: DataFrame, truth: DataFrame, inputs: DataFrame, also: list[Column] | None = None
) -> DataFrame:
    """Counts per input; inputs without predictions keep their misses.

    ``also`` are further aggregates of an input's records, null without any.
    """
    extra = also or []

    def hits(rule: Column, name: str) -> Column:
        return F.count_if(rule).alias(name)

    aligned = F.coalesce("grid_error", F.lit(float("inf"))) <= GRID_ERROR_LIMIT
    seen = records.groupBy("page").agg(
        F.count("*").alias("predictions"),
        hits(F.col("matched_a").isNotNull(), "matched"),
        hits(F.col("duplicate"), "duplicate"),
        hits(F.col("matched_a").isNotNull() & aligned, "aligned"),
        hits(F.col("exact"), "exact"),
        F.sum("correct_squares").alias("correct_squares"),
        hits(F.col("reliable"), "reliable"),
        hits(F.col("reliable") & F.col("exact"), "reliable_exact"),
        hits(F.col("reliable_wrong"), "reliable_wrong"),
        hits(F.col("reliable_wrong_study"), "reliable_wrong_study"),
        hits(F.col("orientation_correct"), "correct_orientations"),
        hits(F.col("orientation_ambiguous"), "ambiguous_predictions"),
        hits(F.col("truth_ambiguous") & F.col("orientation_ambiguous"), "ambiguity_acknowledged"),
        hits(~F.col("in_image"), "out_of_image"),
        *extra,
    )
    known = truth.groupBy("page").agg(
        F.count("*").alias("expected_boards"),
        hits(F.col("orientation") != "ambiguous", "identifiable"),
    )
    both = inputs.select("page", "oracle").join(known, "page", "left").join(seen, "page", "left")
    flags = seen.columns[len(seen.columns) - len(extra) :]
    counted = [c for c in (*known.columns, *seen.columns) if c not in ("page", *flags)]
    full = both.select(
        "page", "oracle", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counted), *flags
    )
    return with_detection(full)


def with_detection(counts: DataFrame) -> DataFrame:
    """Add misses, ratios and null detection fields for inputs given their box."""
    given = F.col("oracle")
    filled = (
        counts.withColumn("unreliable", F.col("predictions") - F.col("reliable"))
        .withColumn("no_board", F.col("predictions") == 0)
        .withColumn("expected_squares", F.col("expected_boards") * 64)
        .withColumn("missed", F.col("expected_boards") - F.col("matched"))
        .withColumn("false_positive", F.col("predictions") - F.col("matched"))
        .withColumn("ambiguous_truth", F.col("expected_boards") - F.col("identifiable"))
    )
    for name in DETECTION:
        filled = filled.withColumn(name, F.when(~given, F.col(name)))
    return (
        filled.withColumn("precision", safe_ratio(F.col("matched"), F.col("predictions")))
        .withColumn("recall", safe_ratio(F.col("matched"), F.col("expected_boards")))
        .withColumn("exact_rate", safe_ratio(F.col("exact"), F.col("expected_boards")))
        .withColumn("square_rate", safe_ratio(F.col("correct_squares"), F.col("expected_squares")))
    )


def summary_aggregates() -> list[Column]:
    """The sums of one group.

    A group that holds inputs both with and without a given box is ``mixed``:
    what it detected is not added up, as half of it was not looked for.
    """
    only_detected = [F.when(~F.bool_or("oracle"), F.coalesce(F.sum(c), F.lit(0))).alias(c) for c in DETECTION]
    return [
        F.count("*").alias("observations"),
        F.bool_and("oracle").alias("oracle"),
        (F.bool_or("oracle") & ~F.bool_and("oracle")).alias("mixed"),
        F.count_if(F.col("predictions") == 0).alias("no_board"),
        *(F.sum(c).alias(c) for c in COUNTS),
        (F.sum("predictions") - F.sum("reliable")).alias("unreliable"),
        *only_detected,
    ]


def with_ratios(summed: DataFrame) -> DataFrame:
    """The ratios of each group; those of detection are null where its sums are."""
    return (
        summed.withColumn("precision", safe_ratio(F.col("matched"), F.col("predictions")))
        .withColumn("recall", safe_ratio(F.col("matched"), F.col("expected_boards")))
        .withColumn("exact_rate", safe_ratio(F.col("exact"), F.col("expected_boards")))
        .withColumn("square_rate", safe_ratio(F.col("correct_squares"), F.col("expected_squares")))
        .withColumn("orientation_rate", safe_ratio(F.col("correct_orientations"), F.col("identifiable")))
    )


def timings(obs: DataFrame, groups: list[str]) -> DataFrame:
    """Distributions of initialisation, first-of-session, warm and all times per group, side by side.

    ``obs`` has ``ms``, ``init_ms`` (null where nothing was initialised) and ``cold``.
    """
    begun = distribution(obs, groups, "init_ms", "init_")
    return join_groups(cold_warm(obs, groups, "ms", "cold"), begun, groups)


def summarise(obs: DataFrame, groups: list[str]) -> DataFrame:
    return with_ratios(obs.groupBy(*groups).agg(*summary_aggregates()))


def summarise_sets(obs: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Several groupings in one pass over the observations.

    ``grouping`` names the set a row belongs to; columns outside it are null.
    """
    names = list(dict.fromkeys(c for group in sets for c in group))
    spec = [[F.col(c) for c in group] for group in sets]
    summed = obs.groupingSets(spec, *(F.col(c) for c in names)).agg(
        *summary_aggregates(), F.grouping_id().alias("_gid")
    )
    label = F.lit(None).cast("string")
    for group in sets:
        gid = sum(1 << (len(names) - 1 - i) for i, c in enumerate(names) if c not in group)
        label = F.when(F.col("_gid") == gid, F.lit("+".join(group))).otherwise(label)
    return with_ratios(summed.withColumn("grouping", label).drop("_gid"))


def summarise_overlapping(obs: DataFrame, groups: list[str], tags: str = "tags") -> DataFrame:
    """By tag: a row counts once in each of its tags, so groups add up to more."""
    return summarise(obs.withColumn("tag", F.explode(tags)), [*groups, "tag"])


def zero_filled(summary: DataFrame, domain: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Declared groups without rows appear with zero counts."""
    joined = domain.join(summary, keys, "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in counts}
    return joined.withColumns(zeros)


def guard_mixed(obs: DataFrame, groups: list[str], column: str = "oracle") -> DataFrame:
    """Groups that hold both kinds of rows, which a summary must not mix."""
    spread = obs.groupBy(*groups).agg(
        F.count_if(F.col(column)).alias("with_box"), F.count_if(~F.col(column)).alias("without_box")
    )
    return spread.where((F.col("with_box") > 0) & (F.col("without_box") > 0))


def failure_reasons() -> Column:
    """Ordered reasons of one measured input; null counts read as zero here."""

    def many(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    return reasons(
        (many("missed") > 0, "missed-board"),
        (many("false_positive") > 0, "false-positive-board"),
        (many("duplicate") > 0, "duplicate-board"),
        (many("aligned") < many("matched"), "grid-misaligned"),
        (F.col("mismatched"), "classification-mismatch"),
        (many("reliable_wrong_study") > 0, "reliable-wrong-study-position"),
        (F.col("misoriented"), "orientation-mismatch"),
        (many("out_of_image") > 0, "out-of-image"),
    )


def record_flags(records: DataFrame | None = None) -> DataFrame | list[Column]:
    """Per input: is any matched board misread, is any turned the wrong way.

    Without ``records`` the aggregates themselves, for a pass that groups records
    by input anyway (``measure_input``).
    """
    flags = [
        F.coalesce(F.bool_or(~F.col("exact")), F.lit(False)).alias("mismatched"),
        F.coalesce(F.bool_or(~F.col("orientation_correct")), F.lit(False)).alias("misoriented"),
    ]
    return flags if records is None else records.groupBy("page").agg(*flags)


def compare(base: DataFrame, cand: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Both summaries side by side; ``side`` tells which one lacks a group."""
    b = base.select(*keys, *(F.col(m).alias(m + "_base") for m in metrics), F.lit(True).alias("_b"))
    c = cand.select(*keys, *(F.col(m).alias(m + "_cand") for m in metrics), F.lit(True).alias("_c"))
    side = F.when(F.col("_c").isNull(), F.lit("base-only")).when(
        F.col("_b").isNull(), F.lit("candidate-only")
    )
    joined = b.join(c, keys, "full")
    return joined.withColumn("side", side.otherwise(F.lit("both"))).drop("_b", "_c")


def delta(compared: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Candidate minus base, one row per group and metric; null if either is null."""
    pairs = F.array(
        *(
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m + "_base").cast("double").alias("base"),
                F.col(m + "_cand").cast("double").alias("cand"),
            )
            for m in metrics
        )
    )
    long = compared.select(*keys, F.explode(pairs).alias("m"))
    return long.select(*keys, "m.metric", "m.base", "m.cand", (F.col("m.cand") - F.col("m.base")).alias("delta"))


def calibration(cells: DataFrame, groups: list[str]) -> DataFrame:
    """Correct over total per confidence bucket; ``cells`` has ``confidence, correct``."""
    c = F.col("confidence")
    bucket = (
        F.when(c < 0.5, F.lit("[0,0.5)"))
        .when(c < 0.7, F.lit("[0.5,0.7)"))
        .when(c < 0.9, F.lit("[0.7,0.9)"))
        .otherwise(F.lit("[0.9,1]"))
    )
    counted = cells.groupBy(*groups, bucket.alias("bucket")).agg(
        F.count_if("correct").alias("correct"), F.count("*").alias("total")
    )
    return counted.withColumn("rate", safe_ratio(F.col("correct"), F.col("total")))
