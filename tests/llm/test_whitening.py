import numpy as np
import pytest
from pyspark.sql import functions as F

import boxeval.llm.whitening as W
from boxeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BOARDS = "board_id string, confidences array<double>, levels int, whitened string, at int"


def boards(spark, vectors):
    return spark.createDataFrame([(f"board-{i}", v, 0, "x", 1) for i, v in enumerate(vectors)], BOARDS)


def run(df, components=32):
    levels = W.confidence_levels(df)
    model = W.fit_whitening(levels, components)
    rows = {r.board_id: (int(r.deviation), np.array(r.whitened)) for r in W.whiten(levels, model).collect()}
    return model, rows, W.identity_error(levels, model)


def brute(vectors, components):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    gaps = x - x.mean(axis=0)
    values, columns = np.linalg.eigh(gaps.T @ gaps / len(x))
    order = np.argsort(-values)[:components]
    values, columns = values[order], columns[:, order]
    whole = [[int(v) for v in row] for row in x]
    n, sums = len(whole), [sum(c) for c in zip(*whole, strict=True)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in whole]
    return values, gaps @ columns / np.sqrt(values), deviation, float(np.trace(gaps.T @ gaps / len(x)))


def agree(model, rows, error, vectors, components):
    values, white, deviation, trace = brute(vectors, components)
    assert np.allclose(model.eigenvalues, values, rtol=1e-9)
    assert np.allclose(model.explained(), values / trace, rtol=1e-9)
    got = np.array([rows[f"board-{i}"][1] for i in range(len(vectors))])
    signs = np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white * signs, atol=1e-6)
    assert [rows[f"board-{i}"][0] for i in range(len(vectors))] == deviation
    assert error < 1e-7


def test_equals_a_whole_decomposition(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(1, 4, 12) @ rng.normal(size=(12, 12))).tolist()
    agree(*run(boards(spark, vectors), 7), vectors, 7)
    agree(*run(boards(spark, vectors)), vectors, 32)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(6)
    good = rng.normal(size=(60, 3)).tolist()
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0]]
    model, rows, error = run(boards(spark, good + odd))
    assert model.n == 60 and set(rows) == {f"board-{i}" for i in range(60)}
    agree(model, rows, error, good, 32)


def test_repeated_rows_and_missing_ids_stay(spark):
    vectors = [[0.0, 0.1], [0.5, 0.9], [0.5, 0.9], [1.0, 0.2]]
    df = spark.createDataFrame([(None, v) for v in vectors] + [("a", vectors[0])], "board_id string, confidences array<float>")
    levels = W.confidence_levels(df)
    model = W.fit_whitening(levels)
    assert model.n == 5 and W.whiten(levels, model).count() == 5


@pytest.mark.parametrize("vectors", [[], [[0.1, 0.2]], [[0.5, 0.5]] * 9])
def test_nothing_to_whiten(spark, vectors):
    model, rows, error = run(boards(spark, vectors))
    assert model.n == len(vectors) and not len(model.eigenvalues) and not rows and error == 0


def test_fewer_components_where_boards_differ_along_fewer(spark):
    vectors = [[float(i), float(i), 3.0, float(i % 2)] for i in range(20)]
    model, rows, error = run(boards(spark, vectors))
    assert len(model.eigenvalues) == 2 and error < 1e-7 and all(len(w) == 2 for _, w in rows.values())


def test_equal_eigenvalues(spark):
    # corners of a cube: all eigenvalues are equal
    vectors = [[float(i >> b & 1) for b in range(4)] for i in range(16)]
    model, rows, error = run(boards(spark, vectors))
    assert np.allclose(model.eigenvalues, 32.0**2) and error < 1e-9
    assert np.allclose(model.vectors @ model.vectors.T, np.eye(4), atol=1e-12)


def test_large_levels_stay_exact(spark):
    vectors = [[1e30, 0.0], [-1e12, 1e9], [0.0, 2.0]]
    levels = W.confidence_levels(boards(spark, vectors))
    stored = {r.board_id: r.levels for r in levels.collect()}
    assert stored["board-0"][0] == 2**63 - 1
    small = boards(spark, vectors[1:] + [[3e10, 5.0]])
    levels = W.confidence_levels(small)
    model = W.fit_whitening(levels)
    whole = [r.levels for r in levels.orderBy("board_id").collect()]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    want = [sum((3 * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in whole]
    assert [int(r.deviation) for r in W.whiten(levels, model).orderBy("board_id").collect()] == want


def test_counts_are_those_of_the_spectrum():
    rng = np.random.default_rng(7)
    for size in (1, 2, 5, 40):
        for _ in range(20):
            matrix = rng.normal(size=(size, size))
            matrix = matrix + matrix.T
            assert W.positive_eigenvalues(matrix) == int((np.linalg.eigvalsh(matrix) > 0).sum())
    assert W.positive_eigenvalues(np.zeros((3, 3))) == 0
    assert W.positive_eigenvalues(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1


def test_close_eigenvalues_keep_their_numbers():
    rng = np.random.default_rng(8)
    turn, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    want = np.sort(np.concatenate([[5, 5 - 1e-9, 5 - 2e-9, 3, 3], rng.uniform(0.1, 1, 25)]))[::-1]
    values, vectors = W.Spectrum((turn * want) @ turn.T).leading(12)
    assert np.allclose(values, want[:12], atol=1e-12)
    assert np.allclose(vectors @ vectors.T, np.eye(12), atol=1e-12)


def test_query(spark):
    df = QUERIES["op11_whitening"](spark, SF)
    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    values, white, deviation, trace = brute([r.embedding for r in given], 32)
    rows = {(r.vec_id, r.component): r for r in df.collect()}
    assert len(rows) == 32 * len(given)
    number = {r.vec_id: i for i, r in enumerate(given)}
    got = np.zeros_like(white)
    for (vec_id, component), r in rows.items():
        at = number[vec_id]
        got[at, component - 1] = r.whitened
        assert r.deviation == deviation[at] and r.n == len(given) and r.identity_error < 1e-7
        assert r.explained == pytest.approx(values[component - 1] / trace, rel=1e-9)
    signs = np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white * signs, atol=1e-6)
    assert df.where(F.col("whitened").isNull()).count() == 0
