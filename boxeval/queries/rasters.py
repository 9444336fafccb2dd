"""Pixel tables, window search, batch scoring and SQL functions."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import couples, pixel_sizes, pixels, printed_boards, table
from boxeval.functions.geometry import Box, cell_center, is_dark
from boxeval.functions.register import register_operators
from boxeval.operators import raster as R
from boxeval.operators.scoring import score_batch
from boxeval.operators.suppression import DIVERSE_LIMIT
from boxeval.queries.ranking import diverse_sql, suppress_sql
from boxeval.queries.registry import query
from boxeval.queries.views import BOXES, PIXELS, iou

#: Labels that a batch is compared with at a time, and bytes of a model that is sent to the workers.
LABELS_AT_ONCE, MODEL_BYTES = 1024, 256_000_000


@query(
    "g14_cell_center",
    f"WITH {PIXELS} SELECT img, y, x, 10 + (x + 0.5) * 92 / 8 AS cx, 20 + (y + 0.5) * 92 / 8 AS cy, (x + y) % 2 = 1 AS dark FROM px",
)
def cell_centers(spark: SparkSession, sf: str) -> DataFrame:
    grid = Box(*(F.lit(v) for v in (10.0, 20.0, 102.0, 112.0)))
    cx, cy = cell_center(grid, F.col("y"), F.col("x"))
    return pixels(spark, sf).select(
        "img", "y", "x", cx.alias("cx"), cy.alias("cy"), is_dark(F.col("y"), F.col("x")).alias("dark")
    )


@query("r1_block_mean", f"WITH {PIXELS} SELECT img, y // 3 AS y, x // 3 AS x, sum(v) / 9 AS v FROM px WHERE x < 6 AND y < 6 GROUP BY img, y // 3, x // 3")
def block_mean(spark: SparkSession, sf: str) -> DataFrame:
    return R.block_mean(pixels(spark, sf), pixel_sizes(spark, sf), F.lit(3))


@query(
    "w4_integral",
    f"WITH {PIXELS} SELECT img, y, x, sum(v) OVER (PARTITION BY img, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS v FROM px",
)
def integral(spark: SparkSession, sf: str) -> DataFrame:
    return R.running_rows(pixels(spark, sf))


_SAT = f"{PIXELS}, sat AS (SELECT a.img, a.y, a.x, sum(b.v) AS v FROM px a JOIN px b ON b.img = a.img AND b.x <= a.x AND b.y <= a.y GROUP BY a.img, a.y, a.x)"


@query("r2_summed_area", f"WITH {_SAT} SELECT img, y, x, v FROM sat")
def summed_area(spark: SparkSession, sf: str) -> DataFrame:
    return R.summed_area(pixels(spark, sf))


@query(
    "r3_box_mean",
    f"""WITH {PIXELS}, b AS (SELECT img, box_id, greatest(0, least(8, floor(x0))) AS ax, greatest(0, least(8, floor(y0))) AS ay, x1, y1 FROM (
      SELECT CAST(vec_id AS BIGINT) AS img, label % 5 + k * 2.25 - 1 AS x0, label % 3 + k AS y0, label % 5 + k * 3.5 AS x1, label % 3 + k * 2 - 0.5 AS y1, 'b' || k AS box_id FROM embeddings, range(0, 4) t(k))),
    c AS (SELECT img, box_id, ax, ay, greatest(ax + 1, least(8, ceil(x1))) AS bx, greatest(ay + 1, least(8, ceil(y1))) AS by1 FROM b)
    SELECT c.img, c.box_id, sum(px.v) / ((bx - ax) * (by1 - ay)) AS mean FROM c LEFT JOIN px ON px.img = c.img AND x >= ax AND x < bx AND y >= ay AND y < by1 GROUP BY c.img, c.box_id, ax, ay, bx, by1""",
)
def box_mean(spark: SparkSession, sf: str) -> DataFrame:
    k, label = F.col("k"), F.col("label")
    boxes = (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").cast("bigint").alias("img"), "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
        .select(
            "img",
            F.concat(F.lit("b"), k.cast("string")).alias("box_id"),
            (label % 5 + k * 2.25 - 1).alias("x0"),
            (label % 3 + k).cast("double").alias("y0"),
            (label % 5 + k * 3.5).alias("x1"),
            (label % 3 + k * 2 - 0.5).alias("y1"),
        )
    )
    return R.box_mean(R.summed_area(pixels(spark, sf)), boxes, pixel_sizes(spark, sf))


@query(
    "r4_median4",
    f"""WITH {PIXELS}, q AS (SELECT img, y // 4 AS qy, x // 4 AS qx, sum(v) / 16 AS m FROM px GROUP BY ALL), s AS (SELECT img, list_sort(list(m)) AS m FROM q GROUP BY img)
    SELECT img, (m[2] + m[3]) / 2 AS background FROM s""",
)
def median4(spark: SparkSession, sf: str) -> DataFrame:
    quarters = R.block_mean(pixels(spark, sf), pixel_sizes(spark, sf), F.lit(4))
    # four values per image
    gathered = quarters.groupBy("img").agg(F.collect_list("v").alias("m"))
    return gathered.select("img", R.median4(F.col("m")).alias("background"))


@query(
    "r5_checker_score",
    f"""WITH {PIXELS}, s AS (SELECT *, CASE WHEN (x + y) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM px),
    m AS (SELECT img, sum(v) FILTER (WHERE sign = 1) / 32 AS l, sum(v) FILTER (WHERE sign = -1) / 32 AS d FROM s GROUP BY img),
    r AS (SELECT s.img, count(*) AS rows FROM (SELECT img, y, sum(sign * v) / 4 AS t FROM s GROUP BY img, y) s JOIN m ON m.img = s.img WHERE t >= (l - d) * 0.3::DOUBLE GROUP BY s.img),
    f AS (SELECT s.img, count(*) AS files FROM (SELECT img, x, sum(sign * v) / 4 AS t FROM s GROUP BY img, x) s JOIN m ON m.img = s.img WHERE t >= (l - d) * 0.3::DOUBLE GROUP BY s.img),
    o AS (SELECT s.img, sum((v - CASE WHEN sign = 1 THEN l ELSE d END) * (v - CASE WHEN sign = 1 THEN l ELSE d END)) AS off FROM s JOIN m ON m.img = s.img GROUP BY s.img)
    SELECT m.img, CASE WHEN l - d >= 1 AND rows >= 4 AND files >= 4 THEN (l - d) / (sqrt(off / 64) + 6) * ((rows + files) / 16) END AS score
    FROM m JOIN o ON o.img = m.img LEFT JOIN r ON r.img = m.img LEFT JOIN f ON f.img = m.img""",
)
def checker_score(spark: SparkSession, sf: str) -> DataFrame:
    gray = F.transform(
        "embedding",
        lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((e.cast("double") + 0.5) * 255).cast("double"))),
    )
    score = R.checker_score(F.col("cells"), min_contrast=1.0, min_lines=4)
    return (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").cast("bigint").alias("img"), gray.alias("cells"))
        .select("img", score.alias("score"))
    )


@query(
    "r6_candidate_windows",
    """WITH RECURSIVE ladder AS (
      SELECT DISTINCT least(64 + 40 * label, 64 + 32 * label) AS top, 24::DOUBLE AS side, 24::BIGINT AS whole FROM embeddings
      UNION ALL SELECT top, n, CAST(least(top, floor(n + 0.5)) AS BIGINT) FROM (SELECT top, least(top, greatest(whole + 1, side * 1.1::DOUBLE))::DOUBLE AS n FROM ladder WHERE whole < top)),
    img AS (SELECT CAST(vec_id AS BIGINT) AS img, 64 + 40 * label AS w, 64 + 32 * label AS h FROM embeddings),
    win AS (SELECT img, whole AS side, unnest(range(0, h - whole + 1, CAST(greatest(2, floor(whole / 32 + 0.5)) AS BIGINT))) AS y, w, CAST(greatest(2, floor(whole / 32 + 0.5)) AS BIGINT) AS step FROM img JOIN ladder ON top = least(w, h)),
    win2 AS (SELECT img, side, y, unnest(range(0, w - side + 1, step)) AS x FROM win)
    SELECT img, count(*) AS windows, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(side) AS BIGINT) AS sum_side FROM win2 GROUP BY img""",
)
def candidate_windows(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("img"),
        (F.lit(64) + F.col("label") * 40).cast("bigint").alias("width"),
        (F.lit(64) + F.col("label") * 32).cast("bigint").alias("height"),
    )
    windows = R.candidate_windows(sizes)
    return windows.groupBy("img").agg(
        F.count("*").alias("windows"), *(F.sum(c).alias("sum_" + c) for c in ("x", "y", "side"))
    )


@query(
    "r7_edge_score",
    f"""WITH {PIXELS}, grids AS (SELECT * FROM (VALUES ('whole', 0, 0, 8.0::DOUBLE), ('part', 3, 1, 4.5::DOUBLE)) g(grid, gx, gy, side)),
    lines AS (SELECT grid, gx, gy, side, floor(gx + l * side / 8 + 0.5) AS lx, floor(gy + l * side / 8 + 0.5) AS ly FROM grids, range(1, 8) r(l)),
    d AS (SELECT a.img, grid, abs(a.v - b.v) AS s FROM lines JOIN px a ON a.x = lx AND a.y >= gy AND a.y < floor(gy + side) AND (a.y - gy) % 2 = 0 JOIN px b ON b.img = a.img AND b.y = a.y AND b.x = a.x - 1
      UNION ALL SELECT a.img, grid, abs(a.v - b.v) FROM lines JOIN px a ON a.y = ly AND a.x >= gx AND a.x < floor(gx + side) AND (a.x - gx) % 2 = 0 JOIN px b ON b.img = a.img AND b.x = a.x AND b.y = a.y - 1)
    SELECT img, grid, sum(s) / count(*) AS score FROM d GROUP BY img, grid""",
)
def edge_score(spark: SparkSession, sf: str) -> DataFrame:
    places = [("whole", 0.0, 0.0, 8.0), ("part", 3.0, 1.0, 4.5)]
    grids = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, ("grid", "gx", "gy", "side"), strict=True))) for p in places))
    return R.edge_score(pixels(spark, sf), pixel_sizes(spark, sf).select("img", F.inline(grids)))


@query(
    "r8_degrade",
    f"""WITH {PIXELS} SELECT img, y, x, greatest(0.0, least(255.0, floor(238.0 + (v - 238.0) * 0.6::DOUBLE
      + (((img * 7919 + y * 104729 + x * 1299709 + 7) % 1000003 * 48271 % 2147483647) % 2001 - 1000) / 1000 * 6.5::DOUBLE + 0.5))) AS v FROM px""",
)
def degrade(spark: SparkSession, sf: str) -> DataFrame:
    return R.degrade(pixels(spark, sf), 0.6, 6.5, 7)


#: Scores of all windows of the printed boards: sums over patches come from corners of the summed area, one look-up each.
_PRINTED = """
scored_windows AS (
  WITH axis AS (SELECT unnest(range(0, 80)) AS i),
  inked AS (SELECT CAST(vec_id AS BIGINT) AS img, y.i AS y, x.i AS x, y.i // 8 - 1 AS r, x.i // 8 - 1 AS c, embedding FROM embeddings, axis y, axis x),
  printed AS (SELECT img, y, x, CASE WHEN r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7
      THEN floor(greatest(0, least(255, if((r + c) % 2 = 0, 210, 130) + CAST(embedding[r * 8 + c + 1] AS DOUBLE) * 60))) ELSE 238 END::DOUBLE AS v FROM inked),
  along AS (SELECT img, y, x, sum(v) OVER (PARTITION BY img, y ORDER BY x) AS v FROM printed),
  area AS (SELECT img, y + 1 AS y, x + 1 AS x, sum(v) OVER (PARTITION BY img, x ORDER BY y) AS v FROM along),
  sides AS (SELECT DISTINCT CAST(least(80, floor(64 * pow(1.1::DOUBLE, k) + 0.5)) AS BIGINT) AS side FROM range(0, 4) t(k)),
  starts AS (SELECT side, unnest(range(0, 80 - side + 1, CAST(greatest(2, floor(side / 32 + 0.5)) AS BIGINT))) AS place FROM sides),
  spots AS (SELECT side, place, i AS cell, k, greatest(1.0::DOUBLE, side / 8 * 0.16::DOUBLE) AS patch,
      CASE k WHEN 0 THEN side / 8 * (i + 0.12::DOUBLE) ELSE side / 8 * (i + 1 - 0.12::DOUBLE) - greatest(1.0::DOUBLE, side / 8 * 0.16::DOUBLE) END AS spot
      FROM starts, range(0, 8) t(i), range(0, 2) u(k)),
  lows AS (SELECT *, CAST(greatest(0, least(80, floor(place + spot))) AS BIGINT) AS low FROM spots),
  spans AS (SELECT side, place, cell, k, low, CAST(least(80, greatest(low + 1, ceil(place + spot + patch))) AS BIGINT) AS high FROM lows),
  bands AS (SELECT DISTINCT low, high FROM spans),
  strips AS (SELECT a.img, a.x, low, high, a.v - coalesce(b.v, 0) AS v FROM bands JOIN area a ON a.y = high LEFT JOIN area b ON b.img = a.img AND b.x = a.x AND b.y = low),
  patches AS (SELECT a.img, a.low AS y0, a.high AS y1, s.low AS x0, s.high AS x1, (a.v - coalesce(b.v, 0)) / ((a.high - a.low) * (s.high - s.low)) AS mean
      FROM bands s JOIN strips a ON a.x = s.high LEFT JOIN strips b ON b.img = a.img AND b.low = a.low AND b.high = a.high AND b.x = s.low),
  looks AS (SELECT v.side, v.place AS y, h.place AS x, v.cell * 8 + h.cell AS cell, v.low AS y0, v.high AS y1, h.low AS x0, h.high AS x1 FROM spans v JOIN spans h ON h.side = v.side),
  cells AS (SELECT img, side, y, x, cell, list_sort(list(mean)) AS m FROM looks JOIN patches USING (y0, y1, x0, x1) GROUP BY ALL),
  boards AS (SELECT img, side, y, x, list((m[2] + m[3]) / 2 ORDER BY cell) AS c FROM cells GROUP BY ALL),
  means AS (SELECT *, list_sum(list_transform(range(0, 64), lambda i: if((i // 8 + i % 8) % 2 = 0, c[i + 1], 0))) / 32 AS l,
      list_sum(list_transform(range(0, 64), lambda i: if((i // 8 + i % 8) % 2 = 0, 0, c[i + 1]))) / 32 AS d FROM boards),
  judged AS (SELECT *, list_sum(list_transform(range(0, 64), lambda i: pow(c[i + 1] - if((i // 8 + i % 8) % 2 = 0, l, d), 2))) AS off,
      len(list_filter(range(0, 8), lambda r: list_sum(list_transform(range(0, 8), lambda f: if((r + f) % 2 = 0, 1, -1) * c[r * 8 + f + 1])) / 4 >= (l - d) * 0.3::DOUBLE)) AS rows,
      len(list_filter(range(0, 8), lambda f: list_sum(list_transform(range(0, 8), lambda r: if((r + f) % 2 = 0, 1, -1) * c[r * 8 + f + 1])) / 4 >= (l - d) * 0.3::DOUBLE)) AS files FROM means)
  SELECT img AS page, printf('%05d%05d%05d', side, y, x) AS seq, x::DOUBLE AS x, y::DOUBLE AS y, side::DOUBLE AS side, (l - d) / (sqrt(off / 64) + 6) * ((rows + files) / 16) AS score
  FROM judged WHERE l - d >= 14 AND rows >= 8 AND files >= 8),
wins AS (SELECT * FROM scored_windows)
"""
_LISTED = f"wins AS (SELECT page, seq, x0 AS x, y0 AS y, x1 - x0 AS side, score FROM ({diverse_sql(_PRINTED, DIVERSE_LIMIT)}))"


@query("r9_scan_pages", f"SELECT page AS img, x0, y0, x1, y1, score, rank FROM ({suppress_sql(_LISTED, True)})")
def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return R.scan_pages(*printed_boards(spark, sf))


def _nearest(model: dict[str, np.ndarray], batch: pd.DataFrame) -> pd.DataFrame:
    """The label with the nearest vector, the model taken in blocks; ties go to the smaller label."""
    vectors = np.stack(batch["embedding"].to_numpy()).astype(float)
    best, read = np.full(len(vectors), np.inf), np.zeros(len(vectors), np.int64)
    for start in range(0, len(model["labels"]), LABELS_AT_ONCE):
        some = slice(start, start + LABELS_AT_ONCE)
        # what is the same for all labels is left out of the squared distance
        gaps = model["squares"][some] - 2 * vectors @ model["vectors"][some].T
        near = gaps.argmin(axis=1)
        gap = gaps[np.arange(len(gaps)), near]
        closer = gap < best
        best[closer], read[closer] = gap[closer], model["labels"][some][near[closer]]
    return pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "read": read})


def _build(raw: bytes) -> dict[str, np.ndarray]:
    rows = json.loads(raw)
    vectors = np.array([r[1] for r in rows], dtype=float)
    return {"labels": np.array([r[0] for r in rows]), "vectors": vectors, "squares": (vectors**2).sum(axis=1)}


@query(
    "f1_score_batch",
    """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
    p AS (SELECT label AS read, arg_min(v, vec_id) AS w FROM e GROUP BY label),
    d AS (SELECT vec_id, label, read, list_sum(list_transform(range(1, 65), lambda i: (v[i] - w[i]) * (v[i] - w[i]))) AS gap FROM e, p)
    SELECT vec_id, label, arg_min(read, gap) AS read FROM d GROUP BY vec_id, label""",
)
def score_batch_query(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding"
    )
    proto = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    # the model is one vector per class; it has to fit into each worker, as any model does
    size = proto.agg(F.sum(F.size("v") * 24)).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes is too large for a worker")
    rows = sorted((r.label, [float(x) for x in r.v]) for r in proto.collect())
    raw = json.dumps(rows).encode()
    shared = spark.sparkContext.broadcast(raw)
    pin = hashlib.sha256(raw).hexdigest()
    return score_batch(
        vectors, lambda: shared.value, _build, _nearest, pin, "vec_id bigint, label bigint, read bigint"
    )


@query("f2_register_operators", f"WITH {BOXES} SELECT page, p, {iou('p', 't')} AS iou, floor((px0 - tx0) / 2 + 0.5) AS shift, (px1 - px0) / nullif(py0 - ty0, 0) AS ratio, repeat('.', CAST(page % 8 + 1 AS INTEGER)) || 'k' || repeat('.', 7) AS cells, CASE WHEN page % 8 = 6 THEN repeat('.', 7) || 'k' || repeat('.', 56) END AS board FROM couples")
def register(spark: SparkSession, sf: str) -> DataFrame:
    register_operators(spark)
    couples(spark, sf).createOrReplaceTempView("boxeval_couples")
    return spark.sql(
        """SELECT page, p, box_iou(px0, py0, px1, py1, tx0, ty0, tx1, ty1) AS iou, round_half_up((px0 - tx0) / 2) AS shift,
        safe_ratio(px1 - px0, py0 - ty0) AS ratio,
        board_cells(concat(page % 8 + 1, '/k7')) AS cells,
        board_cells_strict(concat(page % 8 + 1, 'k/8/8/8/8/8/8/8')) AS board FROM boxeval_couples"""
    )
