import hashlib
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxeval.operators import raster as R
from boxeval.operators.corrections import apply_corrections
from boxeval.operators.scoring import score_batch


def table(spark, images):
    rows = [(i, y, x, float(v)) for i, g in images.items() for (y, x), v in np.ndenumerate(g)]
    sizes = [(i, g.shape[1], g.shape[0]) for i, g in images.items()]
    return (
        spark.createDataFrame(rows, "img bigint, y bigint, x bigint, v double"),
        spark.createDataFrame(sizes, "img bigint, width bigint, height bigint"),
    )


def board(width, height, x0, y0, side, light=210.0, dark=120.0):
    gray = np.full((height, width), 238.0)
    ys, xs = np.mgrid[0:side, 0:side] * 8 // side
    gray[y0 : y0 + side, x0 : x0 + side] = np.where((ys + xs) % 2 == 0, light, dark)
    return gray


def test_areas_and_means_equal_numpy(spark):
    gray = np.random.default_rng(0).integers(0, 256, (7, 9)).astype(float)
    px, sizes = table(spark, {3: gray})
    sat = R.summed_area(px)
    got = {(r.y, r.x): r.v for r in sat.collect()}
    assert all(got[at] == v for at, v in np.ndenumerate(gray.cumsum(0).cumsum(1)))
    boxes = spark.createDataFrame(
        [(3, "in", 1.2, 0.5, 4.1, 3.0), (3, "thin", 2.0, 2.0, 2.0, 2.0), (3, "over", -5.0, 3.5, 99.0, 99.0), (3, "out", 20.0, 0.0, 30.0, 5.0)],
        "img bigint, box_id string, x0 double, y0 double, x1 double, y1 double",
    )
    means = {r.box_id: r.mean for r in R.box_mean(sat, boxes, sizes).collect()}
    assert means == {
        "in": pytest.approx(gray[0:3, 1:5].mean()), "thin": gray[2, 2], "over": pytest.approx(gray[3:, :].mean()), "out": None,
    }
    blocks = {(r.y, r.x): r.v for r in R.block_mean(px, sizes, F.lit(2)).collect()}
    assert len(blocks) == 12 and blocks[(2, 3)] == gray[4:6, 6:8].mean()


def test_checker_score_needs_the_right_sign_and_every_line(spark):
    light = [200.0 if (i // 8 + i % 8) % 2 == 0 else 100.0 for i in range(64)]
    flipped = [300.0 - v for v in light]
    holed = [150.0 if i < 8 else v for i, v in enumerate(light)]
    df = spark.createDataFrame([(0, light), (1, flipped), (2, holed), (3, [9.0] * 64)], "i int, c array<double>")
    got = {r.i: r.s for r in df.select("i", R.checker_score(F.col("c")).alias("s")).collect()}
    assert got[0] == pytest.approx(100 / 6) and got[1] is None and got[2] is None and got[3] is None


def test_window_ladder(spark):
    sizes = spark.createDataFrame([(1, 30, 26), (2, 20, 90), (3, 24, 24), (4, 900, 300)], "img bigint, width bigint, height bigint")
    got = {(r.img, r.side, r.y, r.x) for r in R.candidate_windows(sizes).where("img < 4").collect()}
    assert got == {(1, 24, y, x) for y in (0, 2) for x in (0, 2, 4, 6)} | {(1, 26, 0, x) for x in (0, 2, 4)} | {(3, 24, 0, 0)}
    sides = {r.side for r in R.candidate_windows(sizes, 250).where("img = 4").collect()}
    assert sides == {250, 275, 300}


def test_scan_finds_printed_boards_and_skips_text(spark):
    lines = np.full((96, 96), 238.0)
    lines[::6, :] = 30.0
    px, sizes = table(spark, {1: board(96, 96, 16, 8, 64), 2: lines, 3: np.full((40, 40), 9.0)})
    found = R.scan_pages(px, sizes).collect()
    assert {r.img for r in found} == {1}
    best = min(found, key=lambda r: r["rank"])
    assert abs(best.x0 - 16) <= 4 and abs(best.y0 - 8) <= 4 and abs(best.x1 - best.x0 - 64) <= 6


def test_scan_leaves_small_patterns_and_torn_images(spark):
    torn, sizes = table(spark, {1: board(100, 100, 30, 30, 40), 2: board(96, 96, 16, 8, 64)})
    assert R.scan_pages(torn.where("img = 1 or y <> 50 or x <> 50"), sizes).collect() == []


def test_scan_of_a_large_image(spark):
    px, sizes = table(spark, {1: board(560, 300, 60, 30, 240)})
    found = R.scan_pages(px, sizes).collect()
    best = min(found, key=lambda r: r["rank"])
    assert abs(best.x0 - 60) <= 9 and abs(best.y0 - 30) <= 9 and abs(best.x1 - best.x0 - 240) <= 20


def test_degrade_ignores_partitions(spark):
    px, _ = table(spark, {1: board(16, 16, 0, 0, 16)})
    one = R.degrade(px.repartition(1), 0.5, 8.0, 3)
    many = R.degrade(px.repartition(6), 0.5, 8.0, 3)
    assert sorted(one.collect()) == sorted(many.collect())
    assert R.degrade(px, 1.0, 0.0, 3).exceptAll(px).count() == 0


def test_edge_score(spark):
    px, _ = table(spark, {1: board(16, 16, 0, 0, 16, 200.0, 100.0)})
    grids = spark.createDataFrame([(1, "all", 0.0, 0.0, 16.0), (1, "off", 1.0, 1.0, 8.0), (1, "out", 50.0, 50.0, 8.0)], "img bigint, grid string, gx double, gy double, side double")
    # the second grid's lines meet a cell's edge at every other pixel
    got = {r.grid: r.score for r in R.edge_score(px, grids).collect()}
    assert got == {"all": 100.0, "off": pytest.approx(400 / 7), "out": 0.0}


def test_model_must_match_its_pin(spark):
    raw = b"2"
    df = spark.createDataFrame([(1,), (5,)], "n bigint")
    args = (lambda: raw, lambda b: int(b), lambda m, pdf: pd.DataFrame({"n": pdf["n"] * m}))
    assert sorted(r.n for r in score_batch(df, *args, hashlib.sha256(raw).hexdigest(), "n bigint").collect()) == [2, 10]
    with pytest.raises(Exception, match="model hash mismatch"):
        score_batch(df, *args, "0" * 64, "n bigint").collect()


def test_nearest_of_many_labels_in_bounded_memory():
    import tracemalloc

    from boxeval.queries.rasters import _build, _nearest

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20_000, 64))
    model = _build(json.dumps([[i, v.tolist()] for i, v in enumerate(vectors)]).encode())
    asked = rng.integers(0, 20_000, 1000)
    batch = pd.DataFrame({"vec_id": range(1000), "label": asked, "embedding": list(vectors[asked] + 0.01)})
    tracemalloc.start()
    assert (_nearest(model, batch)["read"] == asked).all()
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_latest_correction_wins(spark):
    boards = spark.createDataFrame([(1, "." * 64, [0.9] * 64), (2, "." * 64, [0.9] * 64)], "vec_id int, cells string, confidences array<double>")
    edits = spark.createDataFrame([(1, 0, "K", 1, 1), (1, 0, "Q", 2, 2), (1, 63, "p", 1, 3)], "vec_id int, square int, value string, ts int, edit_id int")
    got = {r.vec_id: r for r in apply_corrections(boards, edits).collect()}
    assert got[1].cells == "Q" + "." * 62 + "p" and got[1].confidences is None and got[1].corrected
    assert got[2].cells == "." * 64 and len(got[2].confidences) == 64


def test_images_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    from boxeval import bindings

    spark.range(40).selectExpr("id AS vec_id", "array_repeat(0.0f, 64) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(bindings, "IMAGES_IN_TASK", 4)
    px, _ = bindings.printed_boards(spark, str(tmp_path))
    assert px.count() == 40 * 6400 and px.rdd.getNumPartitions() == 10
