"""The matching cases a scorer has to get right, on own data."""

import pytest

from boxeval.operators.metrics import failure_reasons, measure_input, record_flags
from boxeval.plans.evaluation import score_pages

KINGS = "....k..." + "." * 48 + "....K..."
BOX = "x0 double, y0 double, x1 double, y1 double"
PRED = f"page int, p string, {BOX}, cells string, min_conf double, orientation string, orientation_ambiguous boolean"
TRUTH = f"page int, a string, {BOX}, cells string, orientation string"
WHOLE = (0.0, 0.0, 400.0, 400.0)
OTHER = (400.0, 400.0, 800.0, 800.0)


def prediction(p="p0", box=WHOLE, cells=KINGS, conf=0.95, facing="white", ambiguous=False):
    return (1, p, *box, cells, conf, facing, ambiguous)


def truth_box(a="a0", box=WHOLE, cells=KINGS, facing="white"):
    return (1, a, *box, cells, facing)


@pytest.fixture
def measure(spark):
    def run(preds, truths, oracle=False):
        pred, truth = spark.createDataFrame(preds, PRED), spark.createDataFrame(truths, TRUTH)
        inputs = spark.createDataFrame([(1, 800.0, 800.0, oracle)], "page int, width double, height double, oracle boolean")
        records = score_pages(pred, truth, inputs, given=oracle)
        return measure_input(records, truth, inputs).first(), records.orderBy("p").collect()

    return run


def test_given_box_is_exact_without_detection(measure):
    m, (r,) = measure([prediction()], [truth_box()], oracle=True)
    assert m.exact == 1 and m.square_rate == 1.0
    assert [m[c] for c in ("matched", "missed", "false_positive", "duplicate", "aligned", "precision", "recall")] == [None] * 7
    assert r.iou is None and r.grid_error is None


def test_missed_truth_stays_in_the_denominator(measure):
    m, _ = measure([prediction()], [truth_box(), truth_box("a1", OTHER)])
    assert (m.matched, m.missed, m.exact_rate, m.square_rate) == (1, 1, 0.5, 0.5)


def test_no_prediction(measure):
    m, _ = measure([], [truth_box(), truth_box("a1", OTHER)])
    assert m.no_board and m.missed == 2 and m.precision is None and m.recall == 0.0


def test_shifted_duplicate_listed_first(measure):
    shifted = prediction("p0", (2.0, 2.0, 402.0, 402.0))
    m, _ = measure([shifted, prediction("p1")], [truth_box()])
    assert (m.matched, m.duplicate, m.false_positive, m.precision) == (1, 1, 1, 0.5)


def test_out_of_image(measure):
    m, _ = measure([prediction(box=(-100.0, 0.0, 300.0, 400.0))], [truth_box()])
    assert (m.out_of_image, m.exact, m.matched) == (1, 0, 0)


def test_misaligned_with_one_wrong_cell(measure):
    wrong = "....q..." + KINGS[8:]
    m, (r,) = measure([prediction(box=(10.0, 0.0, 410.0, 400.0), cells=wrong)], [truth_box()])
    assert (m.matched, m.aligned, m.correct_squares, m.reliable_wrong) == (1, 0, 63, 1)
    assert r.grid_error == pytest.approx(0.2)


def test_prediction_on_a_negative(measure):
    m, _ = measure([prediction()], [])
    assert m.false_positive == 1 and m.exact_rate is None and m.square_rate is None and m.reliable_wrong == 1


@pytest.mark.parametrize("facing, ambiguous", [("black", False), ("white", True)])
def test_wrong_orientation_is_a_wrong_study_position(measure, facing, ambiguous):
    m, _ = measure([prediction(facing=facing, ambiguous=ambiguous)], [truth_box()])
    assert (m.exact, m.correct_orientations, m.reliable_wrong, m.reliable_wrong_study) == (1, 0, 0, 1)


def test_ambiguous_truth(measure):
    m, (r,) = measure([prediction(ambiguous=True)], [truth_box(facing="ambiguous")])
    assert (m.identifiable, m.ambiguous_truth, m.ambiguity_acknowledged) == (0, 1, 1)
    assert r.orientation_correct is None and not r.reliable_wrong_study


@pytest.mark.parametrize("conf, reliable", [(0.699, False), (0.7, True)])
def test_reliability_floor(measure, conf, reliable):
    m, (r,) = measure([prediction(cells="." * 64, conf=conf)], [truth_box()])
    assert r.reliable is reliable and m.reliable_wrong == int(reliable)


def test_reasons_in_order(spark, measure):
    pred = spark.createDataFrame([prediction("p0", (-100.0, 0.0, 300.0, 400.0)), prediction("p1", (10.0, 0.0, 410.0, 400.0), "." * 64)], PRED)
    truth = spark.createDataFrame([truth_box(), truth_box("a1", OTHER)], TRUTH)
    inputs = spark.createDataFrame([(1, 800.0, 800.0, False)], "page int, width double, height double, oracle boolean")
    records = score_pages(pred, truth, inputs)
    measured = measure_input(records, truth, inputs).join(record_flags(records), "page")
    assert measured.select(failure_reasons().alias("r")).first().r == [
        "missed-board", "false-positive-board", "grid-misaligned", "classification-mismatch",
        "reliable-wrong-study-position", "out-of-image",
    ]


def test_records_and_counts_need_one_shuffle_of_the_boxes(spark):
    pred = spark.createDataFrame([prediction("p0"), prediction("p1", (2.0, 0.0, 402.0, 400.0), "." * 64), prediction("p2", OTHER)], PRED)
    truth = spark.createDataFrame([truth_box(), truth_box("a1", (100.0, 400.0, 500.0, 800.0))], TRUTH)
    inputs = spark.createDataFrame([(1, 800.0, 800.0, False)], "page int, width double, height double, oracle boolean")
    records = score_pages(pred, truth, inputs)
    plan = records._jdf.queryExecution().executedPlan().toString()
    # boxes, and the inputs beside them
    assert plan.count("Exchange hashpartitioning") == 2
    flagged = measure_input(records, truth, inputs, record_flags())
    # further: inputs again, and the truths as they are counted
    assert flagged._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    apart = measure_input(records, truth, inputs).join(record_flags(records), "page")
    assert flagged.select(apart.columns).collect() == apart.collect()


def test_pages_with_many_boxes_are_scored_alike(spark):
    side = [(float(i % 20 * 40), float(i // 20 * 40)) for i in range(300)]
    pred = spark.createDataFrame([prediction(f"p{i}", (x, y, x + 30, y + 30)) for i, (x, y) in enumerate(side)] + [prediction("again", (1.0, 0.0, 31.0, 30.0))], PRED)
    truth = spark.createDataFrame([truth_box(f"a{i}", (x, y, x + 30, y + 30)) for i, (x, y) in enumerate(side[:290])], TRUTH)
    inputs = spark.createDataFrame([(1, 800.0, 800.0, False)], "page int, width double, height double, oracle boolean")
    few = spark.createDataFrame([(1,)], "page int")
    by_join, by_page = (score_pages(pred, truth, inputs, boxes=boxes).orderBy("p").collect() for boxes in (None, few))
    assert by_join == by_page and sum(r.matched_a is not None for r in by_join) == 290
