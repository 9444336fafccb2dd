"""Board operators and the scores of read boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import boards, edits, judged, labelled_boards, page_boxes, pages, table
from boxeval.functions import boards as A
from boxeval.functions.numbers import safe_ratio
from boxeval.operators import matching as J
from boxeval.operators import metrics as M
from boxeval.operators.corrections import apply_corrections, cell_rows, label_values
from boxeval.plans.evaluation import detector_quality, score_pages
from boxeval.queries.registry import query
from boxeval.queries.views import BOARDS, BOXES, JUDGED, MATCH

_RUNS = "c"
for _n in range(8, 0, -1):
    _RUNS = f"replace({_RUNS}, '{'.' * _n}', '{_n}')"
_COMPRESS = f"array_to_string(list_transform(range(0, 8), lambda i: {_RUNS.replace('(c,', '(substr(cells, CAST(i * 8 + 1 AS BIGINT), 8),')}), '/')"


@query("a1_expand_board", f"WITH {BOARDS} SELECT vec_id, cells, 64 AS n FROM boards")
def expand_board(spark: SparkSession, sf: str) -> DataFrame:
    placed = boards(spark, sf).select("vec_id", A.compress_board(F.col("cells")).alias("placement"))
    values = A.expand_board(F.col("placement"))
    return placed.select("vec_id", F.array_join(values, "").alias("cells"), F.size(values).alias("n"))


@query("a2_compress_board", f"WITH {BOARDS} SELECT vec_id, {_COMPRESS} AS placement FROM boards")
def compress_board(spark: SparkSession, sf: str) -> DataFrame:
    return boards(spark, sf).select("vec_id", A.compress_board(F.col("cells")).alias("placement"))


_DAMAGE_SQL = f"""damaged AS (SELECT vec_id, CASE label WHEN 0 THEN placement || '/8' WHEN 1 THEN replace(placement, 'P', 'x') WHEN 2 THEN replace(placement, '2', '11')
  WHEN 3 THEN replace(placement, 'p', 'pp') WHEN 4 THEN NULL WHEN 5 THEN replace(placement, '/', '//') ELSE placement END AS placement
  FROM (SELECT vec_id, label, {_COMPRESS} AS placement FROM boards))"""
_WIDTH = "r"
for _n in range(1, 9):
    _WIDTH = f"replace({_WIDTH}, '{_n}', '{'.' * _n}')"


@query(
    "a3_board_violations",
    f"""WITH {BOARDS}, {_DAMAGE_SQL} SELECT vec_id, concat_ws(',', CASE WHEN placement IS NULL THEN 'missing' END,
      CASE WHEN len(string_split(placement, '/')) <> 8 THEN 'rank-count' END, CASE WHEN regexp_matches(placement, '[^prnbqkPRNBQK1-8/]') THEN 'bad-token' END,
      CASE WHEN len(list_filter(string_split(placement, '/'), lambda r: length({_WIDTH}) <> 8)) > 0 THEN 'rank-width' END,
      CASE WHEN regexp_matches(placement, '[1-8][1-8]') THEN 'adjacent-digits' END,
      CASE WHEN list_contains(string_split(placement, '/'), '') THEN 'empty-rank' END) AS reasons FROM damaged""",
)
def board_violations(spark: SparkSession, sf: str) -> DataFrame:
    whole = boards(spark, sf).select("vec_id", "label", A.compress_board(F.col("cells")).alias("p"))
    damage = (
        F.when(F.col("label") == 0, F.concat("p", F.lit("/8")))
        .when(F.col("label") == 1, F.replace("p", F.lit("P"), F.lit("x")))
        .when(F.col("label") == 2, F.replace("p", F.lit("2"), F.lit("11")))
        .when(F.col("label") == 3, F.replace("p", F.lit("p"), F.lit("pp")))
        .when(F.col("label") == 4, F.lit(None).cast("string"))
        .when(F.col("label") == 5, F.replace("p", F.lit("/"), F.lit("//")))
        .otherwise(F.col("p"))
    )
    reasons = A.board_violations(F.col("placement"))
    return whole.select("vec_id", damage.alias("placement")).select(
        "vec_id", F.array_join(reasons, ",").alias("reasons")
    )


@query("a4_rotate_board", f"WITH {BOARDS} SELECT vec_id, reverse(cells) AS cells FROM boards")
def rotate_board(spark: SparkSession, sf: str) -> DataFrame:
    return boards(spark, sf).select("vec_id", A.rotate_board(F.col("cells")).alias("cells"))


_SAME = "list_filter(range(0, 64), lambda i: substr(cells, i + 1, 1) {op} substr(truth_cells, i + 1, 1))"


@query(
    "a5_diff_boards",
    f"""WITH {BOARDS} SELECT vec_id, array_to_string({_SAME.format(op='<>')}, ',') AS mismatches,
      CAST(len({_SAME.format(op='=')}) AS BIGINT) AS correct, cells = truth_cells AS exact FROM labelled""",
)
def diff_boards(spark: SparkSession, sf: str) -> DataFrame:
    mine, truth = F.col("cells"), F.col("truth_cells")
    return labelled_boards(spark, sf).select(
        "vec_id",
        F.array_join(A.mismatches(mine, truth).cast("array<string>"), ",").alias("mismatches"),
        A.correct_cells(mine, truth).alias("correct"),
        (mine == truth).alias("exact"),
    )


@query(
    "a6_remap_index",
    f"""WITH {BOARDS} SELECT vec_id, CAST(i AS INTEGER) AS square, substr('abcdefgh', CAST(i % 8 + 1 AS BIGINT), 1) || CAST(8 - i // 8 AS VARCHAR) AS name,
      conf[(7 - i // 8) * 8 + i % 8 + 1] AS confidence FROM boards, range(0, 64) t(i)""",
)
def remap_index(spark: SparkSession, sf: str) -> DataFrame:
    ordered = A.board_order(F.col("confidences"))
    rows = boards(spark, sf).select("vec_id", F.posexplode(ordered).alias("square", "confidence"))
    named = rows.withColumn("name", A.square_name(F.col("square")))
    # the two index maps undo each other
    return named.where(A.square_index(F.col("name")) == F.col("square"))


@query(
    "a7_apply_corrections",
    f"""WITH {BOARDS}, edit AS (SELECT CAST(user_id AS BIGINT) AS vec_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 64 AS square,
      arg_max(CASE event_type WHEN 'view' THEN '.' WHEN 'error' THEN 'k' WHEN 'click' THEN 'Q' ELSE 'P' END, (ts, event_id)) AS value FROM events GROUP BY ALL),
    cell AS (SELECT b.vec_id, i, coalesce(e.value, substr(b.cells, i + 1, 1)) AS value FROM boards b CROSS JOIN range(0, 64) t(i)
      LEFT JOIN edit e ON e.vec_id = b.vec_id AND e.square = i)
    SELECT vec_id, string_agg(value, '' ORDER BY i) AS cells, vec_id IN (SELECT vec_id FROM edit) AS corrected,
      vec_id NOT IN (SELECT vec_id FROM edit) AS has_confidences FROM cell GROUP BY vec_id""",
)
def corrections(spark: SparkSession, sf: str) -> DataFrame:
    done = apply_corrections(boards(spark, sf), edits(spark, sf))
    return done.select("vec_id", "cells", "corrected", F.col("confidences").isNotNull().alias("has_confidences"))


@query(
    "a8_confidence_stats",
    f"""WITH {BOARDS} SELECT vec_id, list_min(conf) AS min_conf, list_reduce(list_prepend(0.0::DOUBLE, conf), lambda x, y: x + y) / 64 AS mean_conf,
      list_min(conf) >= 0.7 AS reliable FROM boards""",
)
def confidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    low = F.array_min("confidences")
    return boards(spark, sf).select(
        "vec_id",
        low.alias("min_conf"),
        A.mean_confidence(F.col("confidences")).alias("mean_conf"),
        A.is_reliable(low).alias("reliable"),
    )


@query(
    "a9_low_confidence_squares",
    f"""WITH {BOARDS} SELECT vec_id, array_to_string(list_filter(range(0, 64), lambda i: conf[(7 - i // 8) * 8 + i % 8 + 1] < 0.52::DOUBLE), ',') AS squares FROM boards""",
)
def low_confidence_squares(spark: SparkSession, sf: str) -> DataFrame:
    low = A.low_confidence_squares(F.col("confidences"), 0.52)
    return boards(spark, sf).select("vec_id", F.array_join(low.cast("array<string>"), ",").alias("squares"))


@query(
    "a10_label_values",
    f"""WITH {BOARDS}, cell AS (SELECT label, substr(cells, i + 1, 1) AS value FROM boards, range(0, 64) t(i))
    SELECT label, value, CASE value WHEN 'P' THEN 'white pawn' WHEN 'p' THEN 'black pawn' END AS name, count(*) AS n FROM cell GROUP BY ALL""",
)
def label_values_query(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame(list(A.PIECES.items()), "value string, name string")
    cells = boards(spark, sf).select("label", F.explode(F.split("cells", "")).alias("value"))
    counted = cells.groupBy("label", "value").agg(F.count("*").alias("n"))
    return label_values(counted, names)


@query(
    "a12_argmax_board",
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN CAST(v AS DOUBLE) >= abs(CAST(v AS DOUBLE)) AND CAST(v AS DOUBLE) >= 0.1::DOUBLE THEN 'P'
      WHEN -CAST(v AS DOUBLE) >= 0.1::DOUBLE THEN 'p' ELSE '.' END) AS c, list_transform(embedding, lambda v: greatest(abs(CAST(v AS DOUBLE)), 0.1::DOUBLE)) AS b FROM embeddings)
    SELECT CAST(vec_id AS BIGINT) AS vec_id, array_to_string(c, '') AS cells, list_min(b) AS min_conf, list_max(b) AS max_conf FROM p""",
)
def argmax_board(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.transform(
        "embedding",
        lambda v: A.argmax_cell(
            F.array(v.cast("double"), -v.cast("double"), F.lit(0.1)), "Pp."
        ),
    )
    read = table(spark, sf, "embeddings").select("vec_id", scores.alias("best"))
    return read.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.array_join("best.value", "").alias("cells"),
        F.array_min("best.confidence").alias("min_conf"),
        F.array_max("best.confidence").alias("max_conf"),
    )


@query(
    "m1_score_predictions",
    f"""WITH RECURSIVE {JUDGED} SELECT page, p, oracle, in_image, reliable, matched_a, duplicate, iou, CASE WHEN matched_a IS NOT NULL THEN grid_error END AS grid_error,
      correct_squares, orientation_correct, truth_ambiguous, orientation_ambiguous, exact, reliable_wrong, reliable_wrong_study FROM records""",
)
def score_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return score_pages(*judged(spark, sf), boxes=page_boxes(spark, sf))


_MEASURED = """page, oracle, expected_boards, identifiable, predictions, matched, duplicate, aligned, exact, correct_squares, reliable, reliable_exact,
  reliable_wrong, reliable_wrong_study, correct_orientations, ambiguous_predictions, ambiguity_acknowledged, out_of_image, unreliable, no_board,
  expected_squares, missed, false_positive, ambiguous_truth, precision, recall, exact_rate, square_rate"""


@query("m2_measure_input", f"WITH RECURSIVE {JUDGED} SELECT {_MEASURED} FROM measured")
def measure_input(spark: SparkSession, sf: str) -> DataFrame:
    pred, truth, inputs = judged(spark, sf)
    return M.measure_input(score_pages(pred, truth, inputs, boxes=page_boxes(spark, sf)), truth, inputs)


@query(
    "m8_safe_ratio",
    f"""WITH {BOXES} SELECT o_orderkey AS page, count(DISTINCT p.p) AS predictions, count(DISTINCT t.a) AS truths,
      count(DISTINCT p.p) / nullif(count(DISTINCT t.a), 0) AS ratio
    FROM orders LEFT JOIN pred p ON p.page = o_orderkey LEFT JOIN truth t ON t.page = o_orderkey GROUP BY o_orderkey""",
)
def safe_ratio_query(spark: SparkSession, sf: str) -> DataFrame:
    from boxeval.bindings import predictions, truths

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("page").agg(F.count("*").alias(name))

    joined = (
        pages(spark, sf).select("page")
        .join(counts(predictions(spark, sf), "predictions"), "page", "left")
        .join(counts(truths(spark, sf), "truths"), "page", "left")
        .fillna(0, ["predictions", "truths"])
    )
    return joined.withColumn("ratio", safe_ratio(F.col("predictions"), F.col("truths")))


@query(
    "m11_exact_rate",
    f"WITH {BOARDS} SELECT label, count(*) FILTER (WHERE cells = truth_cells) AS exact, count(*) AS runs, count(*) FILTER (WHERE cells = truth_cells) / count(*) AS rate FROM labelled GROUP BY label",
)
def exact_rate(spark: SparkSession, sf: str) -> DataFrame:
    counted = labelled_boards(spark, sf).groupBy("label").agg(
        F.count_if(F.col("cells") == F.col("truth_cells")).alias("exact"), F.count("*").alias("runs")
    )
    return counted.withColumn("rate", safe_ratio(F.col("exact"), F.col("runs")))


@query(
    "m12_calibration",
    f"""WITH {BOARDS}, cell AS (SELECT label, conf[(7 - i // 8) * 8 + i % 8 + 1] AS c, substr(cells, i + 1, 1) = substr(truth_cells, i + 1, 1) AS ok FROM labelled, range(0, 64) t(i))
    SELECT label, CASE WHEN c < 0.5 THEN '[0,0.5)' WHEN c < 0.7 THEN '[0.5,0.7)' WHEN c < 0.9 THEN '[0.7,0.9)' ELSE '[0.9,1]' END AS bucket,
      count(*) FILTER (WHERE ok) AS correct, count(*) AS total, count(*) FILTER (WHERE ok) / count(*) AS rate FROM cell GROUP BY ALL""",
)
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    return M.calibration(cell_rows(labelled_boards(spark, sf), ["label"]), ["label"])


@query(
    "m15_failure_reasons",
    f"""WITH RECURSIVE {JUDGED}, flags AS (SELECT page, coalesce(bool_or(NOT exact), false) AS mis, coalesce(bool_or(NOT orientation_correct), false) AS turned FROM records GROUP BY page),
    reasons AS (SELECT m.page, concat_ws(',', CASE WHEN missed > 0 THEN 'missed-board' END, CASE WHEN false_positive > 0 THEN 'false-positive-board' END,
      CASE WHEN duplicate > 0 THEN 'duplicate-board' END, CASE WHEN aligned < matched THEN 'grid-misaligned' END, CASE WHEN mis THEN 'classification-mismatch' END,
      CASE WHEN reliable_wrong_study > 0 THEN 'reliable-wrong-study-position' END, CASE WHEN turned THEN 'orientation-mismatch' END,
      CASE WHEN out_of_image > 0 THEN 'out-of-image' END) AS reasons FROM measured m LEFT JOIN flags f ON f.page = m.page)
    SELECT page, reasons FROM reasons WHERE reasons <> ''""",
)
def failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    pred, truth, inputs = judged(spark, sf)
    records = score_pages(pred, truth, inputs, boxes=page_boxes(spark, sf))
    measured = M.measure_input(records, truth, inputs, M.record_flags())
    named = measured.select("page", M.failure_reasons().alias("reasons"))
    return named.where(F.size("reasons") > 0).select("page", F.array_join("reasons", ",").alias("reasons"))


@query(
    "m17_fp_per_negative_page",
    f"""WITH {BOXES}, negative AS (SELECT o_orderkey AS page FROM orders WHERE o_orderkey NOT IN (SELECT page FROM truth))
    SELECT count(DISTINCT n.page) AS pages, count(p.p) AS outputs, count(p.p) / nullif(count(DISTINCT n.page), 0) AS rate FROM negative n LEFT JOIN pred p ON p.page = n.page""",
)
def fp_per_negative_page(spark: SparkSession, sf: str) -> DataFrame:
    from boxeval.bindings import predictions, truths

    counts = predictions(spark, sf).groupBy("page").agg(F.count("*").alias("n"))
    negative = pages(spark, sf).select("page").join(truths(spark, sf), "page", "left_anti")
    summed = negative.join(counts, "page", "left").agg(
        F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("outputs")
    )
    return summed.withColumn("rate", safe_ratio(F.col("outputs"), F.col("pages")))


@query(
    "m18_reliability_table",
    f"""WITH RECURSIVE {JUDGED} SELECT coalesce(exact, false) AS exact, count(*) FILTER (WHERE reliable) AS reliable, count(*) FILTER (WHERE NOT reliable) AS unreliable FROM records GROUP BY 1""",
)
def reliability_table(spark: SparkSession, sf: str) -> DataFrame:
    records = score_pages(*judged(spark, sf), boxes=page_boxes(spark, sf))
    exact = F.coalesce("exact", F.lit(False)).alias("exact")
    return records.groupBy(exact).agg(
        F.count_if("reliable").alias("reliable"), F.count_if(~F.col("reliable")).alias("unreliable")
    )


@query(
    "q5_unsafe_results",
    f"WITH RECURSIVE {JUDGED} SELECT page, reliable_wrong, reliable_wrong_study, predictions FROM measured WHERE reliable_wrong > 0",
)
def unsafe_results(spark: SparkSession, sf: str) -> DataFrame:
    measured = measure_input(spark, sf)
    return measured.where(F.col("reliable_wrong") > 0).select(
        "page", "reliable_wrong", "reliable_wrong_study", "predictions"
    )


@query(
    "p6_oracle_inputs",
    f"""WITH {BOARDS}, {BOXES} SELECT t.page, t.a AS input_id, 1::BIGINT AS expected_boards, 1::BIGINT AS predictions, 1::BIGINT AS exact, CAST(CASE WHEN t.l_returnflag = 'N' THEN 0 ELSE 1 END AS BIGINT) AS correct_orientations,
      1::BIGINT AS reliable_exact, CAST(NULL AS BIGINT) AS matched, CAST(NULL AS DOUBLE) AS precision FROM truth t JOIN boards b ON b.vec_id = t.l_suppkey""",
)
def oracle_inputs(spark: SparkSession, sf: str) -> DataFrame:
    from boxeval.plans.inputs import oracle_predictions

    _, truth, _ = judged(spark, sf)
    # every truth is an input of its own
    alone = truth.withColumn("at", F.col("page")).withColumn(
        "page", F.concat(F.col("page").cast("string"), F.lit(":"), F.col("a"))
    )
    pred = oracle_predictions(alone)
    inputs = alone.select(
        "page", F.col("x1").alias("width"), F.col("y1").alias("height"), F.lit(True).alias("oracle")
    )
    measured = M.measure_input(score_pages(pred, alone, inputs, given=True), alone, inputs)
    key = F.split_part("page", F.lit(":"), F.lit(1)).cast("bigint")
    return measured.select(
        key.alias("page"),
        F.split_part("page", F.lit(":"), F.lit(2)).alias("input_id"),
        "expected_boards",
        "predictions",
        "exact",
        "correct_orientations",
        "reliable_exact",
        "matched",
        "precision",
    )


@query(
    "detector_quality",
    f"""WITH RECURSIVE {MATCH}, per AS (SELECT o.o_orderkey AS page, o.o_orderpriority AS page_group,
      (SELECT count(*) FROM truth t WHERE t.page = o.o_orderkey) AS n_truth, (SELECT count(*) FROM pred p WHERE p.page = o.o_orderkey) AS n_pred,
      (SELECT count(*) FROM matches m WHERE m.page = o.o_orderkey) AS n_match FROM orders o)
    SELECT page_group, count(*) AS pages, CAST(sum(n_truth) AS BIGINT) AS expected_boards, CAST(sum(n_pred) AS BIGINT) AS predictions, CAST(sum(n_match) AS BIGINT) AS matched,
      CAST(sum(n_truth) - sum(n_match) AS BIGINT) AS missed, CAST(sum(n_pred) - sum(n_match) AS BIGINT) AS false_positive,
      sum(n_match)::DOUBLE / nullif(sum(n_pred), 0)::DOUBLE AS precision, sum(n_match)::DOUBLE / nullif(sum(n_truth), 0)::DOUBLE AS recall FROM per GROUP BY page_group""",
)
def detector_quality_query(spark: SparkSession, sf: str) -> DataFrame:
    from boxeval.bindings import predictions, truths

    groups = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("page_group")
    )
    return detector_quality(predictions(spark, sf), truths(spark, sf), groups)
