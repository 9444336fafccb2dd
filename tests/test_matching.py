import random

import pytest
from pyspark.sql import functions as F

from boxeval.operators import matching as J

BOX = "x0 double, y0 double, x1 double, y1 double"


def brute_iou(a, b):
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return shared / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared)


def brute_match(preds, truths, at_least=0.9):
    pairs = sorted(
        (-brute_iou(p[1:], a[1:]), p[0], a[0]) for p in preds for a in truths
    )
    used_p, used_a, found = set(), set(), set()
    for worse, p, a in pairs:
        if -worse >= at_least and p not in used_p and a not in used_a:
            used_p.add(p)
            used_a.add(a)
            found.add((p, a))
    return found, used_a


def random_page(rng, size, copies):
    """Boxes on few positions, so that ties and copies are frequent."""
    rows = []
    for i in range(size):
        side = rng.choice([80, 81, 82, 84])
        x, y = rng.choice([0, 1, 2, 3, 200]), rng.choice([0, 1, 2])
        for c in range(copies if rng.random() < 0.3 else 1):
            rows.append((f"{i:03d}-{c}", float(x), float(y), float(x + side), float(y + side)))
    rng.shuffle(rows)
    return [(f"{n:04d}", *row[1:]) for n, row in enumerate(rows)]


@pytest.fixture(scope="module")
def crowded(spark):
    rng = random.Random(5)
    pages = {n: (random_page(rng, rng.randint(0, 9), 5), random_page(rng, rng.randint(0, 7), 4)) for n in range(24)}
    pred = spark.createDataFrame([(n, *p) for n, (ps, _) in pages.items() for p in ps], f"page bigint, p string, {BOX}")
    truth = spark.createDataFrame([(n, *a) for n, (_, ts) in pages.items() for a in ts], f"page bigint, a string, {BOX}")
    return pages, pred.cache(), truth.cache()


def expected_matches(pages):
    return {(n, p, a) for n, (ps, ts) in pages.items() for p, a in brute_match(ps, ts)[0]}


def rows(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def test_fold_and_rounds_equal_a_direct_matcher(crowded):
    pages, pred, truth = crowded
    want = expected_matches(pages)
    assert len(want) > 60
    assert rows(J.greedy_match(pred, truth), "page", "p", "a") == want
    rounds = J.greedy_match_rounds(pred, truth)
    assert rounds.count() == len(want)
    assert rows(rounds, "page", "p", "a") == want


def test_large_pages_take_the_rounds(crowded):
    pages, pred, truth = crowded
    mixed = J.greedy_match(pred, truth, fold_limit=12)
    assert rows(mixed, "page", "p", "a") == expected_matches(pages)


def test_duplicates_in_fold_rounds_and_join(crowded):
    pages, pred, truth = crowded
    want = set()
    for n, (ps, ts) in pages.items():
        found, used = brute_match(ps, ts)
        matched = {p for p, _ in found}
        boxes = {a[0]: a[1:] for a in ts}
        want |= {
            (n, p[0]) for p in ps
            if p[0] not in matched and any(brute_iou(p[1:], boxes[a]) >= 0.9 for a in used)
        }
    assert want
    for limit in (256, 10):
        assert rows(J.pairing(pred, truth, fold_limit=limit).where("duplicate"), "page", "p") == want
    match = J.greedy_match(pred, truth)
    assert rows(J.duplicates(pred, truth, match), "page", "p") == want


def test_nearest_truth_falls_back_to_the_first(crowded):
    pages, pred, truth = crowded
    want = {
        (n, p[0], min(ts, key=lambda a: (-brute_iou(p[1:], a[1:]), a[0]))[0])
        for n, (ps, ts) in pages.items() if ts for p in ps
    }
    assert rows(J.nearest_truth(pred, truth), "page", "p", "a") == want


@pytest.mark.parametrize("at_least", [0.3, 0.5, 0.72, 0.9])
def test_grid_finds_every_close_pair(spark, at_least):
    rng = random.Random(11)
    boxes = []
    for i in range(150):
        x, y = rng.uniform(-50, 90), rng.uniform(-50, 90)
        w, h = rng.uniform(3, 140), rng.uniform(3, 140)
        boxes.append((1, i, x, y, x + w, y + h))
    df = spark.createDataFrame(boxes, f"page int, i int, {BOX}")
    pairs = J.near_pairs(df, df, "page", at_least)
    want = {(a[1], b[1]) for a in boxes for b in boxes if brute_iou(a[2:], b[2:]) >= at_least}
    got = [tuple(r) for r in pairs.select("l_i", "r_i").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    touching = J.touching_pairs(df, df, "page", tile=40.0)
    want = {(a[1], b[1]) for a in boxes for b in boxes if brute_iou(a[2:], b[2:]) > 0}
    got = [tuple(r) for r in touching.select("l_i", "r_i").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_are_listed_once_with_their_number(spark):
    same = (0.0, 0.0, 80.0, 80.0)
    pred = spark.createDataFrame([(1, f"{i:03d}", *same) for i in range(50)], f"page int, p string, {BOX}")
    truth = spark.createDataFrame([(1, f"{i:03d}", *same) for i in range(30)], f"page int, a string, {BOX}")
    (pair,) = J.box_pairs(pred, truth).collect()
    assert (pair.n_pred, pair.n_truth, pair.first_p, pair.first_a) == (50, 30, "000", "000")
    match = J.greedy_match_rounds(pred, truth).collect()
    assert {(m.p, m.a) for m in match} == {(f"{i:03d}", f"{i:03d}") for i in range(30)}


def test_single_or_abstain(spark):
    pred = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "page int, p string")
    inputs = spark.createDataFrame([(1,), (2,), (3,)], "page int")
    got = {r.page: (r.phase, r.p) for r in J.single_or_abstain(pred, inputs).collect()}
    assert got == {1: ("done", "a"), 2: ("no-board", None), 3: ("no-board", None)}


def test_missed_and_false_positive_of_a_pair_below_the_limit(spark):
    pred = spark.createDataFrame([(1, "p", 0.0, 0.0, 100.0, 100.0)], f"page int, p string, {BOX}")
    truth = spark.createDataFrame([(1, "a", 20.0, 0.0, 120.0, 100.0)], f"page int, a string, {BOX}")
    match = J.greedy_match(pred, truth)
    assert match.count() == 0
    assert J.missed(truth, match).count() == 1 and J.false_positives(pred, match).count() == 1
    assert J.greedy_match_rounds(pred.where(F.lit(False)), truth).count() == 0


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_rounds_by_grid_or_by_page_are_the_same(spark, crowded, limit):
    _, pred, truth = crowded
    want = rows(J.greedy_match(pred, truth), "page", "p", "a")
    assert rows(J.greedy_match_rounds(pred, truth, fold_limit=limit), "page", "p", "a") == want


def test_rounds_end_when_an_index_is_null(spark):
    # two predictions contend for a true box that has no index
    pred = spark.createDataFrame([(1, "p0", 0.0, 0.0, 100.0, 100.0), (1, "p1", 1.0, 0.0, 101.0, 100.0)], "page int, p string, x0 double, y0 double, x1 double, y1 double")
    truth = spark.createDataFrame([(1, None, 0.0, 0.0, 100.0, 100.0)], "page int, a string, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r) for r in J.greedy_match_rounds(pred, truth).select("p", "a").collect()] == [("p0", None)]


def test_pairs_nothing_contends_for_need_no_round(spark, monkeypatch):
    box = "x0 double, y0 double, x1 double, y1 double"
    copies = [(1, f"p{i}", 0.0, 0.0, 100.0, 100.0) for i in range(3)]
    pred = spark.createDataFrame([*copies, (1, "q", 500.0, 0.0, 600.0, 100.0)], f"page int, p string, {box}")
    truth = spark.createDataFrame([(1, "a1", 1.0, 0.0, 101.0, 100.0), (1, "a0", 1.0, 0.0, 101.0, 100.0), (1, "b", 500.0, 1.0, 600.0, 101.0)], f"page int, a string, {box}")
    monkeypatch.setattr(J, "_mutual_runs", None)
    assert rows(J.greedy_match_rounds(pred, truth), "p", "a") == {("p0", "a0"), ("p1", "a1"), ("q", "b")}


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_nearest_by_joins_or_by_page_is_the_same(crowded, limit):
    _, pred, truth = crowded
    want = rows(J._nearest_joined(pred, truth), "page", "p", "a")
    assert rows(J.nearest_truth(pred, truth, fold_limit=limit), "page", "p", "a") == want


def test_boxes_of_a_page_meet_in_one_shuffle(crowded):
    _, pred, truth = crowded
    assert shuffles(J.nearest_truth(pred, truth)) == 1
    assert shuffles(J.pairing(pred, truth)) == 1
