"""Geometry, joins and matching on true and predicted boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import couples, predictions, truths
from boxeval.functions import geometry as G
from boxeval.operators import matching as J
from boxeval.queries.registry import query
from boxeval.queries.views import BOXES, MATCH, PAIRS, iou


def _edge() -> Column:
    """Side of the page used by the clipping queries."""
    return F.lit(640.0)


def _rect(prefix: str = "p") -> G.Rect:
    """A rectangle that leaves a 640 px page on every side for some rows."""
    return G.Rect(
        F.col(prefix + "x0") - 60,
        F.col(prefix + "y0") - 30,
        F.col(prefix + "x1") - F.col(prefix + "x0"),
        F.col(prefix + "y1") - F.col(prefix + "y0"),
    )


_RECT_SQL = "px0 - 60 AS rx, py0 - 30 AS ry, px1 - px0 AS rw, py1 - py0 AS rh"


def _named(rect: G.Rect) -> list:
    return [c.alias(n) for c, n in zip(rect, ("x", "y", "width", "height"))]


@query(
    "g1_to_corners",
    f"WITH {BOXES} SELECT page, p, px0 - 10 AS x0, py0 - 20 AS y0, px0 + (px1 - px0) - 10 AS x1, py0 + (py1 - py0) - 20 AS y1 FROM couples",
)
def to_corners(spark: SparkSession, sf: str) -> DataFrame:
    b = G.box("p")
    corners = G.to_corners(G.Rect(b.x0, b.y0, b.width, b.height), F.lit(10), F.lit(20))
    return couples(spark, sf).select(
        "page", "p", *(c.alias(n) for c, n in zip(corners, ("x0", "y0", "x1", "y1")))
    )


@query("g2_iou", f"WITH {BOXES} SELECT page, p, {iou('p', 't')} AS iou FROM couples")
def iou_query(spark: SparkSession, sf: str) -> DataFrame:
    return couples(spark, sf).select("page", "p", G.iou(G.box("p"), G.box("t")).alias("iou"))


@query(
    "g3_grid_error",
    f"""WITH {BOXES} SELECT page, p, greatest(abs(px0 - tx0) * 8 / (tx1 - tx0), abs(px1 - tx1) * 8 / (tx1 - tx0),
    abs(py0 - ty0) * 8 / (ty1 - ty0), abs(py1 - ty1) * 8 / (ty1 - ty0)) AS grid_error FROM couples""",
)
def grid_error(spark: SparkSession, sf: str) -> DataFrame:
    return couples(spark, sf).select(
        "page", "p", G.grid_error(G.box("p"), G.box("t")).alias("grid_error")
    )


@query(
    "g4_clamp_rect",
    f"""WITH {BOXES}, r AS (SELECT page, p, {_RECT_SQL} FROM couples),
    c AS (SELECT page, p, least(greatest(rx, 0.0), 640.0) AS x, least(greatest(ry, 0.0), 640.0) AS y,
      least(greatest(rx + rw, 0.0), 640.0) AS x1, least(greatest(ry + rh, 0.0), 640.0) AS y1 FROM r)
    SELECT page, p, x, y, greatest(0.0, x1 - x) AS width, greatest(0.0, y1 - y) AS height FROM c""",
)
def clamp_rect(spark: SparkSession, sf: str) -> DataFrame:
    return couples(spark, sf).select("page", "p", *_named(G.clamp_rect(_rect(), _edge(), _edge())))


def _shown() -> Column:
    """Display size; some pages have no area."""
    return F.when(F.col("l_quantity") > 48, F.lit(0.0)).otherwise(_edge())


@query(
    "g5_normalise",
    f"""WITH {BOXES}, r AS (SELECT page, p, {_RECT_SQL}, CASE WHEN l_quantity > 48 THEN 0.0 ELSE 640.0 END::DOUBLE AS s FROM couples)
    SELECT page, p, CASE WHEN s <= 0 THEN 0.0 ELSE rx / nullif(s, 0) END AS x, CASE WHEN s <= 0 THEN 0.0 ELSE ry / nullif(s, 0) END AS y,
      CASE WHEN s <= 0 THEN 0.0 ELSE rw / nullif(s, 0) END AS width, CASE WHEN s <= 0 THEN 0.0 ELSE rh / nullif(s, 0) END AS height FROM r""",
)
def normalise(spark: SparkSession, sf: str) -> DataFrame:
    return couples(spark, sf).select("page", "p", *_named(G.normalise(_rect(), _shown(), _shown())))


@query(
    "g5_denormalise",
    f"""WITH {BOXES}, r AS (SELECT page, p, {_RECT_SQL} FROM couples)
    SELECT page, p, rx / 640.0::DOUBLE * 320.0::DOUBLE AS x, ry / 640.0::DOUBLE * 200.0::DOUBLE AS y, rw / 640.0::DOUBLE * 320.0::DOUBLE AS width,
      rh / 640.0::DOUBLE * 200.0::DOUBLE AS height FROM r""",
)
def denormalise(spark: SparkSession, sf: str) -> DataFrame:
    part = G.normalise(_rect(), _edge(), _edge())
    return couples(spark, sf).select(
        "page", "p", *_named(G.denormalise(part, F.lit(320.0), F.lit(200.0)))
    )


@query(
    "g6_to_pixels",
    f"""WITH {BOXES}, r AS (SELECT page, p, rx / 640 AS nx, ry / 640 AS ny, rw / 6400 AS nw, rh / 64000 AS nh
      FROM (SELECT page, p, {_RECT_SQL} FROM couples)),
    c AS (SELECT page, p, least(greatest(floor(nx * 97.0::DOUBLE + 0.5), 0.0), 97.0) AS x0, least(greatest(floor(ny * 61.0::DOUBLE + 0.5), 0.0), 61.0) AS y0,
      least(greatest(floor((nx + nw) * 97.0::DOUBLE + 0.5), 0.0), 97.0) AS x1, least(greatest(floor((ny + nh) * 61.0::DOUBLE + 0.5), 0.0), 61.0) AS y1 FROM r)
    SELECT page, p, CASE WHEN x1 <= x0 AND x0 + 1 > 97 THEN 96.0 ELSE x0 END AS x, CASE WHEN y1 <= y0 AND y0 + 1 > 61 THEN 60.0 ELSE y0 END AS y,
      greatest(1.0, x1 - x0) AS width, greatest(1.0, y1 - y0) AS height FROM c""",
)
def to_pixels(spark: SparkSession, sf: str) -> DataFrame:
    r = _rect()
    part = G.Rect(r.x / 640, r.y / 640, r.width / 6400, r.height / 64000)
    return couples(spark, sf).select(
        "page", "p", *_named(G.to_pixels(part, F.lit(97.0), F.lit(61.0)))
    )


@query(
    "g8_within_tolerance",
    f"""WITH {BOXES} SELECT page, p, abs(px0 - tx0) <= greatest(4.0, (tx1 - tx0) * 0.01::DOUBLE) AND abs(py0 - ty0) <= greatest(4.0, (tx1 - tx0) * 0.01::DOUBLE)
      AND abs((px1 - px0) - (tx1 - tx0)) <= greatest(4.0, (tx1 - tx0) * 0.01::DOUBLE) AND abs((py1 - py0) - (ty1 - ty0)) <= greatest(4.0, (tx1 - tx0) * 0.01::DOUBLE) AS close
    FROM (SELECT page, p, px0 + l_linenumber - 2 AS px0, py0, px1 + l_linenumber - 2 AS px1, py1, tx0, ty0, tx1, ty1 FROM couples)""",
)
def within_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.col("l_linenumber") - 2
    p, t = G.box("p"), G.box("t")
    mine = G.Rect(p.x0 + moved, p.y0, p.width, p.height)
    other = G.Rect(t.x0, t.y0, t.width, t.height)
    return couples(spark, sf).select(
        "page", "p", G.within_tolerance(mine, other, t.width).alias("close")
    )


@query(
    "g9_pad_outward",
    f"""WITH {BOXES}, r AS (SELECT page, p, {_RECT_SQL} FROM couples),
    c AS (SELECT page, p, greatest(0.0, floor(rx - rw * 0.08::DOUBLE)) AS x, greatest(0.0, floor(ry - rw * 0.08::DOUBLE)) AS y,
      least(640.0, ceil(rx + rw + rw * 0.08::DOUBLE)) AS x1, least(640.0, ceil(ry + rh + rw * 0.08::DOUBLE)) AS y1 FROM r)
    SELECT page, p, x, y, x1 - x AS width, y1 - y AS height FROM c""",
)
def pad_outward(spark: SparkSession, sf: str) -> DataFrame:
    return couples(spark, sf).select("page", "p", *_named(G.pad_outward(_rect(), 0.08, _edge(), _edge())))


@query(
    "g10_in_bounds",
    f"""WITH {BOXES} SELECT page, p, px0 - 60 >= 0 AND py0 - 30 >= 0 AND px1 - 60 <= 640 AND py1 - 30 <= 640 AS inside FROM couples""",
)
def in_bounds(spark: SparkSession, sf: str) -> DataFrame:
    b = G.box("p")
    moved = G.Box(b.x0 - 60, b.y0 - 30, b.x1 - 60, b.y1 - 30)
    return couples(spark, sf).select("page", "p", G.in_bounds(moved, _edge(), _edge()).alias("inside"))


@query(
    "g11_normalise_drag",
    f"""WITH {BOXES} SELECT page, p, least(px0 + l_quantity * 6, tx1) AS x, least(py1, ty0) AS y,
      abs(tx1 - (px0 + l_quantity * 6)) AS width, abs(ty0 - py1) AS height FROM couples""",
)
def normalise_drag(spark: SparkSession, sf: str) -> DataFrame:
    p, t = G.box("p"), G.box("t")
    rect = G.normalise_drag(p.x0 + F.col("l_quantity") * 6, p.y1, t.x1, t.y0)
    return couples(spark, sf).select("page", "p", *_named(rect))


@query(
    "g12_flip_y_normalise",
    f"""WITH {BOXES}, r AS (SELECT page, p, {_RECT_SQL} FROM couples)
    SELECT page, p, rx / 640 AS x, (640 - ry - rh) / 640 AS y, rw / 640 AS width, rh / 640 AS height FROM r""",
)
def flip_y_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return couples(spark, sf).select("page", "p", *_named(G.flip_y_normalise(_rect(), _edge(), _edge())))


@query(
    "g13_visible_part",
    f"""WITH {BOXES}, c AS (SELECT page, p, px0 - 60 AS a0, py0 - 30 AS b0, px1 - 60 AS a1, py1 - 30 AS b1 FROM couples)
    SELECT page, p, greatest(0.0, a0) AS x0, greatest(0.0, b0) AS y0, least(640.0, a1) AS x1, least(640.0, b1) AS y1,
      CASE WHEN a0 < 0 OR b0 < 0 OR a1 > 640 OR b1 > 640 THEN 'partial' ELSE 'complete' END AS kind FROM c""",
)
def visible_part(spark: SparkSession, sf: str) -> DataFrame:
    b = G.box("p")
    seen, cut = G.visible_part(G.Box(b.x0 - 60, b.y0 - 30, b.x1 - 60, b.y1 - 30), _edge(), _edge())
    return couples(spark, sf).select(
        "page",
        "p",
        *(c.alias(n) for c, n in zip(seen, ("x0", "y0", "x1", "y1"))),
        F.when(cut, F.lit("partial")).otherwise(F.lit("complete")).alias("kind"),
    )


@query(
    "j1_box_pairs",
    f"""WITH {PAIRS} SELECT page, px0, py0, px1, py1, tx0, ty0, tx1, ty1, iou, min(p) AS first_p, min(a) AS first_a,
      count(DISTINCT p) AS n_pred, count(DISTINCT a) AS n_truth
    FROM pairs WHERE iou > 0 GROUP BY page, px0, py0, px1, py1, tx0, ty0, tx1, ty1, iou""",
)
def box_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return J.box_pairs(predictions(spark, sf), truths(spark, sf), at_least=0)


@query("j2_greedy_match", f"WITH RECURSIVE {MATCH} SELECT page, p, a, iou FROM matches")
def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    return J.greedy_match(predictions(spark, sf), truths(spark, sf))


@query("j3_greedy_match_rounds", f"WITH RECURSIVE {MATCH} SELECT page, p, a, iou FROM matches")
def greedy_match_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return J.greedy_match_rounds(predictions(spark, sf), truths(spark, sf))


@query(
    "j4_missed",
    f"""WITH RECURSIVE {MATCH} SELECT t.page, t.a, t.x0, t.y0, t.x1, t.y1 FROM truth t
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page = t.page AND m.a = t.a)""",
)
def missed(spark: SparkSession, sf: str) -> DataFrame:
    truth = truths(spark, sf)
    return J.missed(truth, J.greedy_match(predictions(spark, sf), truth))


@query(
    "j5_false_positives",
    f"""WITH RECURSIVE {MATCH} SELECT p.page, p.p, p.x0, p.y0, p.x1, p.y1 FROM pred p
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page = p.page AND m.p = p.p)""",
)
def false_positives(spark: SparkSession, sf: str) -> DataFrame:
    pred = predictions(spark, sf)
    return J.false_positives(pred, J.greedy_match(pred, truths(spark, sf)))


@query(
    "j6_duplicates",
    f"""WITH RECURSIVE {MATCH} SELECT DISTINCT q.page, q.p, q.px0 AS x0, q.py0 AS y0, q.px1 AS x1, q.py1 AS y1 FROM pairs q
    JOIN matches m ON m.page = q.page AND m.a = q.a
    WHERE q.iou >= 0.9 AND NOT EXISTS (SELECT 1 FROM matches n WHERE n.page = q.page AND n.p = q.p)""",
)
def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    pred, truth = predictions(spark, sf), truths(spark, sf)
    again = J.pairing(pred, truth).where("duplicate").select("page", "p")
    return pred.join(again, ["page", "p"], "left_semi")


@query(
    "j7_nearest_truth",
    f"""WITH {PAIRS} SELECT page, p, px0 AS x0, py0 AS y0, px1 AS x1, py1 AS y1, a, iou FROM (
      SELECT *, row_number() OVER (PARTITION BY page, p ORDER BY iou DESC, a) AS rn FROM pairs) WHERE rn = 1""",
)
def nearest_truth(spark: SparkSession, sf: str) -> DataFrame:
    return J.nearest_truth(predictions(spark, sf), truths(spark, sf))


@query(
    "a11_single_or_abstain",
    f"""WITH {BOXES} SELECT i.page, count(p.p) AS n_predictions, CASE WHEN count(p.p) = 1 THEN 'done' ELSE 'no-board' END AS phase,
      CASE WHEN count(p.p) = 1 THEN min(p.p) END AS p
    FROM (SELECT o_orderkey AS page FROM orders) i LEFT JOIN pred p ON p.page = i.page GROUP BY i.page""",
)
def single_or_abstain(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("page"))
    return J.single_or_abstain(predictions(spark, sf), pages)
