import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from boxeval.operators import suppression as K
from boxeval.operators.distribution import cold_warm, distribution
from boxeval.operators.ordered import first_flag, row_numbers, running


@pytest.fixture(scope="module")
def windows(spark):
    rng = random.Random(3)
    pages = {}
    for page in range(30):
        rows = []
        for n in range(rng.randint(1, 40)):
            x, y, side = rng.choice([0, 2, 6, 12, 60]), rng.choice([0, 3, 9]), rng.choice([60, 62, 66])
            score = rng.choice([1.0, 1.2, 1.21, 1.3, 1.5, 1.52, 2.0, 3.0])
            rows.append((f"{n:03d}", (float(x), float(y), float(x + side), float(y + side)), score))
        pages[page] = rows
    flat = [(p, seq, *box, score) for p, rows in pages.items() for seq, box, score in rows]
    schema = "page bigint, seq string, x0 double, y0 double, x1 double, y1 double, score double"
    return pages, spark.createDataFrame(flat, schema).cache()


def by_page(df):
    found = {}
    for r in df.orderBy("page", "rank").collect():
        found.setdefault(r.page, []).append(r.seq)
    return found


def overlap(a, b):
    """Intersection over union of two corner boxes, by counting along each axis."""
    wide = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    high = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    areas = sum((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b))
    return wide * high / (areas - wide * high)


def listed(spark, rows):
    """Windows of one page from (seq, x, y, side, score)."""
    schema = "page bigint, seq string, x0 double, y0 double, x1 double, y1 double, score double"
    flat = [(1, seq, float(x), float(y), float(x + side), float(y + side), float(score)) for seq, x, y, side, score in rows]
    return spark.createDataFrame(flat, schema)


@pytest.mark.parametrize("abstain", [True, False])
def test_suppression_is_the_same_by_fold_rounds_and_mix(windows, abstain):
    _, df = windows
    fold = by_page(K.suppress(df, abstain))
    assert by_page(K.suppress_rounds(df, abstain)) == fold
    assert by_page(K.suppress_rounds(df, abstain, chunk=3, large_page=9)) == fold
    assert by_page(K.suppress(df, abstain, fold_limit=15)) == fold
    assert all(len(seqs) <= 4 for seqs in fold.values())


def test_a_chain_of_overlaps_needs_no_pairs(spark):
    # each window hides the next one only; then a thousand copies of a better one, and a page without a name
    chain = [(1, f"{n:05d}", 10.0 * n, 0.0, 10.0 * n + 64, 64.0, 9.0 - n / 1000) for n in range(2000)]
    copies = [(1, f"c{n:04d}", 0.0, 500.0, 64.0, 564.0, 20.0) for n in range(1000)]
    unnamed = [(None, "a", 0.0, 0.0, 64.0, 64.0, 2.0), (None, "b", 0.0, 0.0, 64.0, 64.0, 2.0)]
    schema = "page bigint, seq string, x0 double, y0 double, x1 double, y1 double, score double"
    df = spark.createDataFrame(chain + copies + unnamed, schema)
    for chunk, large in ((2, 5000), (256, 100)):
        found = K.suppress_rounds(df, abstain=False, chunk=chunk, large_page=large)
        assert by_page(found) == {1: ["c0000", "00000", "00002", "00004"], None: ["a"]}
    assert K.suppress_rounds(df.where("false")).isEmpty()


def test_what_is_suppressed_has_a_better_window_that_is_not(windows):
    pages, df = windows
    kept = by_page(K.suppress(df, abstain=False, limit=1000))
    for page, rows in pages.items():
        found = {seq: (box, score) for seq, box, score in rows}
        chosen = kept.get(page, [])
        rank = {seq: (-found[seq][1], seq) for seq in found}
        assert chosen == sorted(chosen, key=rank.get)
        assert all(overlap(found[a][0], found[b][0]) < 0.72 for a in chosen for b in chosen if a < b)
        for seq, (box, score) in found.items():
            hidden = any(rank[c] < rank[seq] and overlap(found[c][0], box) >= 0.72 for c in chosen)
            assert (seq in chosen) == (score >= 1.15 and not hidden)


@pytest.mark.parametrize(
    ("rows", "clear"),
    [
        ([("a", 0, 0, 64, 2.0), ("b", 300, 0, 64, 1.9)], ["a", "b"]),  # far apart
        ([("a", 0, 0, 64, 2.0), ("b", 4, 0, 64, 1.99)], []),  # nearly as good, four pixels on: nobody knows which
        ([("a", 0, 0, 64, 2.0), ("b", 4, 0, 64, 1.9)], ["a"]),  # clearly worse
        ([("a", 0, 0, 64, 2.0), ("b", 1, 0, 64, 1.99)], ["a"]),  # the same place
        ([("a", 0, 0, 64, 2.0), ("b", 4, 0, 64, 1.99), ("c", 300, 0, 64, 1.5)], ["c"]),
        ([("a", 0, 0, 64, 1.14)], []),  # too weak
        ([("a", 0, 0, 64, 1.16), ("b", 4, 0, 64, 1.13)], []),  # a weak one may still be a rival
    ],
)
def test_rivals_make_a_window_unsure(spark, rows, clear):
    for found in (K.suppress(listed(spark, rows)), K.suppress_rounds(listed(spark, rows))):
        assert by_page(found) == ({1: clear} if clear else {})


@pytest.mark.parametrize(
    ("rows", "k", "kept"),
    [
        ([("1", 0, 0, 64, 1.0), ("2", 2, 0, 64, 2.0)], 3, ["2"]),  # a better one takes its place
        ([("1", 0, 0, 64, 2.0), ("2", 2, 0, 64, 2.0)], 3, ["1"]),  # an equal one doesn't
        ([("1", 0, 0, 64, 1.0), ("2", 200, 0, 64, 3.0), ("3", 400, 0, 64, 2.0)], 2, ["2", "3"]),
        # the third is near the first, which has gone when it comes
        ([("1", 0, 0, 64, 1.0), ("2", 200, 0, 64, 3.0), ("3", 400, 0, 64, 2.0), ("4", 2, 0, 64, 2.5)], 2, ["2", "4"]),
        # it takes the place of one, though it is nearer to another that would have stayed
        ([("1", 0, 0, 64, 2.0), ("2", 12, 0, 64, 1.5), ("3", 6, 0, 64, 3.0)], 3, ["3", "2"]),
    ],
)
def test_a_diverse_list_by_hand(spark, rows, k, kept):
    assert by_page(K.diverse_top_k(listed(spark, rows), k)) == {1: kept}


@pytest.mark.parametrize("k", [2, 5, 48])
def test_diverse_list_whole_and_in_chunks(windows, k):
    pages, df = windows
    whole = by_page(K.diverse_top_k(df, k))
    assert by_page(K.diverse_top_k(df, k, chunk=12)) == whole
    for page, seqs in whole.items():
        found = {seq: (box, score) for seq, box, score in pages[page]}
        scores = [found[seq][1] for seq in seqs]
        assert len(seqs) <= k and scores == sorted(scores, reverse=True)
        assert scores[0] == max(score for _, score in found.values())


def test_top_k_drops_what_is_not_finite(spark):
    rows = [(1, "a", 0.0, 0.0, 1.0, 1.0, s) for s in (math.nan, math.inf, 2.0, 2.0, 1.0)]
    rows = [(r[0], f"{i}", *r[2:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "page int, seq string, x0 double, y0 double, x1 double, y1 double, score double")
    assert [r.seq for r in K.top_k(df, 2).orderBy("rank").collect()] == ["2", "3"]


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_values_of_oversized_groups(spark, how):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), rng.randint(0, 50), i, rng.randint(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v bigint").repartition(5)
    order = [F.col("t"), F.col("i")]
    w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("r", {"sum": F.sum, "max": F.max}[how]("v").over(w))
    got = running(df, ["k"], order, F.col("v"), "r", how, limit=100)
    key = lambda r: r.i
    assert sorted(got.select(*want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_row_numbers_and_first_flag(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "k string, t int")
    got = {(r.k, r.t): r.n for r in row_numbers(df, ["k"], [F.col("t")], "n", limit=2).collect()}
    assert got == {("a", 1): 1, ("a", 2): 2, ("a", 3): 3, ("b", 9): 1}
    cold = {(r.k, r.t) for r in first_flag(df, ["k"], ["t"], "cold").where("cold").collect()}
    assert cold == {("a", 1), ("b", 9)}
    nulls = spark.createDataFrame([(None, 2), (None, 1), (None, 3)], "k string, t int")
    assert {(r.t, r.n) for r in row_numbers(nulls, ["k"], [F.col("t")], "n", limit=2).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_nearest_rank_percentiles(spark):
    rng = random.Random(2)
    groups = {g: [round(rng.uniform(-20, 400), rng.choice([0, 2])) for _ in range(n)] for g, n in enumerate([1, 2, 19, 20, 21, 100, 333])}
    groups[7] = [0.0, 0.0, -1.5]
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(0, None)], "g int, v double")
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for summary in (distribution(df, ["g"], "v"), distribution(counted, ["g"], "v", weight="n")):
        for r in summary.collect():
            vs = sorted(groups[r.g])
            assert (r["count"], r["min"], r["max"]) == (len(vs), vs[0], vs[-1])
            assert r.p50 == vs[max(1, math.ceil(0.5 * len(vs))) - 1]
            assert r.p95 == vs[max(1, math.ceil(0.95 * len(vs))) - 1]


def test_percentiles_of_odd_groups(spark):
    inf, nan = math.inf, math.nan
    rows = [("nulls", None), (None, 1.0), (None, 2.0), ("inf", -inf), ("inf", 3.0), ("inf", inf), ("inf", inf), ("nan", nan), ("nan", 1.0), ("tiny", 5e-324), ("tiny", -5e-324), ("tiny", 0.0)]
    got = {r.g: (r["count"], r.min, r.p50, r.p95, r.max) for r in distribution(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["nulls"] == (0, None, None, None, None)
    assert got[None] == (2, 1.0, 1.0, 2.0, 2.0)
    assert got["inf"] == (4, -inf, 3.0, inf, inf)
    assert got["tiny"] == (3, -5e-324, 0.0, 5e-324, 5e-324)
    assert got["nan"][:3] == (2, 1.0, 1.0) and math.isnan(got["nan"][3]) and math.isnan(got["nan"][4])


def test_null_keys_have_halves_and_a_first_row(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 7.0), ("a", 1, None)], "e string, t int, ms double")
    cold = first_flag(df, ["e"], ["t"], "cold")
    assert {(r.e, r.t): r.cold for r in cold.collect()} == {(None, 1): True, (None, 2): False, ("a", 1): True}
    got = {r.e: r for r in cold_warm(cold, ["e"], "ms", "cold").collect()}
    assert (got[None].cold_p50, got[None].warm_max, got[None].all_count) == (5.0, 7.0, 2)
    assert (got["a"].cold_count, got["a"].all_count, got["a"].all_p95) == (0, 0, None)


def test_cold_and_warm_halves(spark):
    df = spark.createDataFrame([("a", True, 9.0), ("a", False, 1.0), ("a", False, 2.0), ("b", True, 5.0)], "e string, cold boolean, ms double")
    got = {r.e: r for r in cold_warm(df, ["e"], "ms", "cold").collect()}
    assert (got["a"].cold_p50, got["a"].warm_p50, got["a"].warm_max, got["a"].all_count) == (9.0, 1.0, 2.0, 3)
    assert (got["b"].warm_count, got["b"].warm_p50) == (0, None)
