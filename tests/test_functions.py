import math

import pytest
from pyspark.sql import functions as F

from boxeval.functions import boards as A
from boxeval.functions import geometry as G
from boxeval.functions import numbers as N
from boxeval.functions import text as X
from boxeval.functions.register import register_operators


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def rect(*values):
    return G.Rect(*(F.lit(float(v)) for v in values))


def value(spark, r):
    row = spark.range(1).select(*(c.alias(n) for c, n in zip(r, "abcd"))).first()
    return tuple(row)


@pytest.mark.parametrize("x, want", [(2.5, 3), (-2.5, -2), (0.49999, 0), (-0.5, 0), (1.2, 1)])
def test_half_rounds_up(spark, x, want):
    assert one(spark, G.round_half_up(F.lit(x))) == want


@pytest.mark.parametrize(
    "norm, want",
    [((0, 0, 0.5, 0.5), (0, 0, 50, 25)), ((1, 1, 0, 0), (99, 49, 1, 1)), ((0.3, 0.3, 0, 0.2), (30, 15, 1, 10)), ((-1, 0, 3, 2), (0, 0, 100, 50))],
)
def test_pixels_stay_inside_and_never_vanish(spark, norm, want):
    assert value(spark, G.to_pixels(rect(*norm), F.lit(100.0), F.lit(50.0))) == want


def test_clamp_drag_and_empty_display(spark):
    ten = F.lit(10.0)
    assert value(spark, G.clamp_rect(rect(-5, 2, 8, 20), ten, ten)) == (0, 2, 3, 8)
    assert value(spark, G.clamp_rect(rect(20, 20, 5, 5), ten, ten)) == (10, 10, 0, 0)
    assert value(spark, G.normalise(rect(1, 2, 3, 4), F.lit(0.0), ten)) == (0, 0, 0, 0)
    assert value(spark, G.normalise_drag(*(F.lit(v) for v in (9.0, 1.0, 4.0, 6.0)))) == (4, 1, 5, 5)
    assert value(spark, G.pad_outward(rect(1, 1, 5, 5), 0.08, ten, ten)) == (0, 0, 7, 7)


def test_box_validity_and_iou(spark):
    def b(*v):
        return G.Box(*(F.lit(float(x)) for x in v))

    assert one(spark, G.iou(b(0, 0, 2, 2), b(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, G.iou(b(0, 0, 1, 1), b(5, 5, 6, 6))) == 0
    for bad in ((0, 0, 0, 1), (0, 0, math.nan, 1), (0, 0, math.inf, 1), (2, 0, 1, 1)):
        assert one(spark, G.is_valid(b(*bad))) is False
    assert one(spark, G.is_valid(b(0, 0, 1, 1))) is True


@pytest.mark.parametrize(
    "placement, strict, want",
    [
        ("8/8/8/8/8/8/8/8", True, []),
        ("44/8/8/8/8/8/8/8", True, ["adjacent-digits"]),
        ("44/8/8/8/8/8/8/8", False, []),
        ("8/8/8/8/8/8/8", True, ["rank-count"]),
        ("7/8/8/8/8/8/8/8", True, ["rank-width"]),
        ("7x/8/8/8/8/8/8/8", True, ["bad-token"]),
        ("/8/8/8/8/8/8/8", True, ["rank-width", "empty-rank"]),
        (None, True, ["missing"]),
    ],
)
def test_board_reasons(spark, placement, strict, want):
    assert one(spark, A.board_violations(F.lit(placement).cast("string"), strict)) == want


def test_boards_round_trip_and_orders(spark):
    fen = "rnbqkbnr/pppppppp/8/3P4/8/8/PPPP1PPP/RNBQKBNR"
    cells = one(spark, A.cells_of(F.lit(fen)))
    assert len(cells) == 64 and one(spark, A.compress_board(F.lit(cells))) == fen
    assert one(spark, A.rotate_board(F.lit(cells))) == cells[::-1]
    assert one(spark, A.expand_board(F.lit("8/8"))) is None
    assert one(spark, A.mismatches(F.lit("x" + cells[1:]), F.lit(cells))) == [0]
    for i, name in ((0, "a8"), (7, "h8"), (56, "a1"), (63, "h1")):
        assert one(spark, A.square_name(F.lit(i))) == name and one(spark, A.square_index(F.lit(name))) == i
        assert one(spark, A.remap_index(A.remap_index(F.lit(i)))) == i
    assert one(spark, A.remap_index(F.lit(0))) == 56
    low = one(spark, A.low_confidence_squares(F.array(*(F.lit(0.1 if i == 56 else 0.9) for i in range(64))), 0.5))
    assert low == [0]


@pytest.mark.parametrize(
    "text, want",
    [("12.5", 12.5), (" 3 ", 3.0), ("1e3", 1000.0), ("", None), ("0x10", None), ("1d", None), ("NaN", None), ("Infinity", None), ("1e999", None), ("-2", -2.0)],
)
def test_strict_numbers(spark, text, want):
    assert one(spark, N.strict_double(F.lit(text))) == want


def test_durations_booleans_ratios(spark):
    assert one(spark, N.strict_duration(F.lit("-2"))) is None
    assert one(spark, N.strict_boolean(F.lit("true"))) is True and one(spark, N.strict_boolean(F.lit("TRUE"))) is None
    assert one(spark, N.safe_ratio(F.lit(1), F.lit(0))) is None


def test_text_rules(spark):
    safe = {
        "see https://a.b/c?d=1 now\nmore": "see [link] now",
        "file:///etc/x/y gone": "[link] gone",
        "at /srv/app/main.js:3": "at [path]:3",
        "(/srv/app/) and C:\\Users\\me\\x.txt": "([path] and [path]",
        "a/b and 1/2 and /one stay": "a/b and 1/2 and /one stay",
        "": "",
    }
    for text, shown in safe.items():
        assert one(spark, X.redact(F.lit(text))) == shown
    assert one(spark, X.origin(F.lit("http://a.b:80/c?d"))) == "http://a.b:80"
    assert one(spark, X.origin(F.lit("/c/d"))) == ""
    assert one(spark, X.is_iso_date(F.lit("2026-13-99"))) is True
    assert one(spark, X.is_iso_date(F.lit("2026-13-99"), real_day=True)) is False
    assert [one(spark, X.is_kebab_id(F.lit(s))) for s in ("a-b1", "A-b", "a--b")] == [True, False, False]
    assert [one(spark, X.escapes_root(F.lit(s))) for s in ("a/../b", "/a", "a/b..c")] == [True, True, False]


def test_sql_functions(spark):
    register_operators(spark)
    row = spark.sql("SELECT box_iou(0D,0D,2D,2D,1D,0D,3D,2D) a, board_cells('k7/8') b, safe_ratio(1D,0D) c, round_half_up(-2.5D) d").first()
    assert row.a == pytest.approx(1 / 3) and row.b == "k" + "." * 15 and row.c is None and row.d == -2
