import numpy as np
import pytest
from pyspark.sql import functions as F

import boxeval.llm.neighbours as N
from boxeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BOARDS = "board_id bigint, confidences array<double>, rank int, score string, found int"


def boards(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", 1) for r in rows], BOARDS)


def brute(rows, k):
    """Ranks by scores as they are, of (id, vector) pairs that all take part."""
    answers = []
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q)
            answers += [(q, rank, i, -s) for rank, (s, i) in enumerate(near[:k], 1)]
    return sorted(answers)


def found(df, k=20):
    return sorted(map(tuple, N.nearest_boards(df, F.col("board_id") % 20 == 0, k).collect()))


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(50)] + [(100 + i, [2.0, 2.0]) for i in range(40)]
    odd = [
        (200, None), (220, [0.0, 0.0]), (240, [1.0, None]), (260, [float("nan"), 1.0]), (280, [float("inf"), 1.0]), (300, []),
        (320, [9.0]), (None, [5.0, 5.0]), (7, [1.0, 1.0]), (120, [2.0, 2.0]),
    ]
    assert found(boards(spark, rows + odd)) == brute(rows, 20)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(0, [1.0]), (20, [-1.0])], [(1, [1.0]), (2, [2.0])], [(0, [0.0])]])
def test_few_rows(spark, rows):
    usable = [r for r in rows if any(r[1])]
    assert found(boards(spark, rows)) == brute(usable, 20)


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert found(boards(spark, rows)) == [
        (0, 1, 1, 0.5), (0, 1, 1, 1.0), (0, 2, 1, 0.0), (0, 2, 1, 0.5),
    ]


def test_recall_with_many_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "LIST_ROWS", 40)
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 24))
    vectors = (centres[rng.integers(0, 12, 2000)] + 0.6 * rng.normal(size=(2000, 24))) * rng.uniform(0.5, 2, (2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    answers, exact = found(boards(spark, rows)), brute(rows, 20)
    hits = {r[:1] + r[2:3] for r in answers} & {r[:1] + r[2:3] for r in exact}
    assert len(answers) == len(exact)
    assert len(hits) >= 0.9 * len(exact)
    scores = {(q, i): s for q, _, i, s in exact}
    assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q, _, i, s in answers if (q, i) in scores)


def test_many_different_vectors_tie_at_the_cut(spark):
    # all but a few have the same product with each query, and ids do not follow the order of the vectors
    rng = np.random.default_rng(5)
    ids = rng.permutation(300)
    rows = [(int(i), [1.0, float(n % 7 == 0), float(n)]) for n, i in enumerate(ids) if i % 20]
    rows += [(20 * i, [1.0 + i, 1.0, 0.0]) for i in range(3)]
    assert found(boards(spark, rows)) == brute(rows, 20)


def test_groups_have_bounded_numbers_of_queries_and_vectors(spark, monkeypatch):
    look = N._look

    def bounded(asked, there, most):
        assert asked.num_rows <= 80 and there.num_rows <= 160, (asked.num_rows, there.num_rows)
        return look(asked, there, most)

    rng = np.random.default_rng(3)
    rows = [(20 * i + j, v.tolist()) for i in range(400) for j, v in enumerate(rng.normal(size=(2, 8)))]
    whole = found(boards(spark, rows))
    monkeypatch.setattr(N, "BLOCK_ROWS", 64)
    monkeypatch.setattr(N, "QUERY_ROWS", 32)
    monkeypatch.setattr(N, "_look", bounded)
    assert found(boards(spark, rows)) == whole


def test_walks_meet_the_nearest_centroids():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(3000, 16))
    graph = N.fit_lists(points, 600, float(np.sqrt((points**2).sum(1)).max()))
    lifted = graph.lift(points[:200])
    order, distance = graph.walk(lifted)
    exact = np.sqrt(graph._distances(lifted))
    assert (order[:, 0] == exact.argmin(1)).mean() >= 0.99
    assert np.allclose(distance[:, 0], exact[np.arange(200), order[:, 0]], atol=0.05)
    assert graph.shares.max() < 12 / 600


def test_query(spark):
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    rows = QUERIES["op7_nearest"](spark, SF).collect()
    queries = [q for q in table if q % 20 == 0]
    assert len(rows) == 20 * len(queries)
    hits = 0
    for q in queries:
        own = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 21))
        assert all(s == pytest.approx(table[q] @ table[i], abs=1e-12) for _, i, s in own)
        near = sorted((-(table[q] @ v), i) for i, v in table.items() if i != q)[:20]
        hits += len({i for _, i in near} & {i for _, i, _ in own})
    assert hits >= 0.9 * len(rows)


def test_text_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(120, 6)).round(1).tolist())] + [(200 + i, [1.0] * 6) for i in range(30)]
    df = spark.createDataFrame([(f"page-{i:03}", v) for i, v in rows], "board_id string, confidences array<float>")
    stored = {int(r.board_id[5:]): r.confidences for r in df.collect()}
    got = N.nearest_boards(df, F.substring("board_id", 6, 3).cast("int") % 20 == 0)
    found = sorted((int(r.query_id[5:]), r["rank"], int(r.board_id[5:]), round(r.score, 9)) for r in got.collect())
    assert found == [(q, n, i, round(s, 9)) for q, n, i, s in brute(sorted(stored.items()), 20)]


def test_recall_with_more_lists_than_a_walk_meets(spark, monkeypatch):
    # three hundred lists and more, most of which no query looks at
    monkeypatch.setattr(N, "LIST_ROWS", 40)
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(400, 16))[rng.integers(0, 400, 14_000)] + 0.35 * rng.normal(size=(14_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "board_id bigint, confidences array<double>")
    looked = []
    saved = N._query_blocks
    monkeypatch.setattr(N, "_query_blocks", lambda graph, asked, least: looked.append((graph, least)) or saved(graph, asked, least))
    answers = N.nearest_boards(df, F.col("board_id") % 20 == 0).collect()
    graph, least = looked[0]
    assert len(graph.centroids) >= 300
    seen = [len(own) for own in graph.looked_at(vectors[::20].astype(float), least)]
    assert np.mean(seen) < 0.8 * len(graph.centroids)
    queries = np.arange(0, len(vectors), 20)
    scores = vectors[queries] @ vectors.T
    scores[np.arange(len(queries)), queries] = -np.inf
    exact = {(int(q), int(i)) for q, row in zip(queries, np.argsort(-scores, axis=1)[:, :20], strict=True) for i in row}
    assert len({(r.query_id, r.board_id) for r in answers} & exact) >= 0.9 * len(exact)
