"""Boards with the most alike confidences, by balanced posting lists.

Confidence vectors are gathered in lists around centroids, and a vector at a
boundary stands in several of them.  A query walks a graph of the centroids,
which every task holds, and looks through the lists whose centroids are hardly
farther away than the nearest one.  Lists that are large are split into blocks.

Nearness is the largest inner product.  For the index, vectors get one more
component that makes all of them equally long, so that the largest inner
product is the smallest distance.

Copies of a vector are one entry with its smallest board ids: no more of them
can be among the nearest, as ties go to smaller ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxeval.session import cut

#: Different vectors that the centroids are fitted to, about; every vector is indexed.
SAMPLE_ROWS = 20_000
#: Vectors per list, and most lists: centroids and their graph are held by each task.
LIST_ROWS, MOST_LISTS = 1024, 4096
#: Vectors per block of a list, and queries per block of those that look at it, about.
BLOCK_ROWS, QUERY_ROWS = 4096, 4096
#: Queries from which the driver tells how many look at each list, about.
SAMPLE_QUERIES = 512
#: A vector stands in lists at most (1 + REPLICATE) times as far as the nearest; a query looks at those up to (1 + LOOK).
REPLICATE, REPLICAS, LOOK = 0.02, 4, 0.26
#: Centroids that a walk keeps in view, and links of each.
IN_VIEW, LINKS = 256, 24
ROUNDS, BALANCE = 12, 0.05
_RESOLUTION = 1 << 30
_QUERIES_AT_ONCE = 512
_ROWS_AT_ONCE = 8192


class CentroidGraph:
    """Centroids, the links between near ones, and the share of the sample in each list."""

    def __init__(self, centroids: np.ndarray, shares: np.ndarray, radius: float) -> None:
        self.centroids, self.shares, self.radius = centroids.astype(np.float32), shares, radius
        n = len(centroids)
        gaps = self._distances(self.centroids)
        # links go both ways, else a centroid that is near to none would not be met; rows are filled up with the last link
        near = np.zeros((n, n), bool)
        np.put_along_axis(near, np.argsort(gaps, axis=1)[:, : LINKS + 1], True, axis=1)
        own = [np.flatnonzero(row) for row in near | near.T]
        self.links = np.array([np.pad(o, (0, max(map(len, own)) - len(o)), "edge") for o in own])
        self.gaps = np.sqrt(gaps)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def _distances(self, points: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.maximum((points**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * points @ c.T, 0)

    def lift(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the component that makes their length ``radius``; that of a query is 0."""
        vectors = vectors.astype(np.float32)
        rest = np.zeros(len(vectors)) if query else np.maximum(self.radius**2 - (vectors.astype(float) ** 2).sum(1), 0)
        return np.column_stack([vectors, np.sqrt(rest).astype(np.float32)])

    def walk(self, points: np.ndarray, view: int = IN_VIEW) -> tuple[np.ndarray, np.ndarray]:
        """Centroids that the walks from all entries have met, nearest first, and their distances (infinite: not met).

        Each step goes on from the nearest centroid in view that no step went on from.
        """
        n, view = len(self.centroids), min(view, len(self.centroids))
        distance = np.full((len(points), n), np.inf, np.float32)
        squares, lengths = (self.centroids**2).sum(1), (points**2).sum(1)
        done = np.zeros((len(points), n), bool)
        distance[:, self.entries] = np.maximum(
            lengths[:, None] + squares[self.entries] - 2 * points @ self.centroids[self.entries].T, 0
        )
        active = np.arange(len(points))
        while len(active):
            own = distance[active]
            edge = np.partition(own, view - 1, axis=1)[:, view - 1 : view]
            open_ = np.where(done[active] | (own > edge), np.inf, own)
            nearest = open_.argmin(1)
            going = np.isfinite(open_[np.arange(len(active)), nearest])
            active, nearest = active[going], nearest[going]
            if not len(active):
                break
            done[active, nearest] = True
            linked = self.links[nearest]
            dots = np.einsum("bd,bld->bl", points[active], self.centroids[linked])
            distance[active[:, None], linked] = np.maximum(lengths[active][:, None] + squares[linked] - 2 * dots, 0)
        order = np.argsort(distance, axis=1, kind="stable")
        return order, np.sqrt(np.take_along_axis(distance, order, 1))

    def homes(self, vectors: np.ndarray) -> list[list[int]]:
        """Lists of each vector: the nearest, and at a boundary others that no chosen one is nearer to."""
        order, distance = self.walk(self.lift(vectors), 8 * REPLICAS)
        chosen = []
        for lists, gap in zip(order, distance, strict=True):
            own = [int(lists[0])]
            near = gap <= (1 + REPLICATE) * gap[0] + 1e-6
            for candidate, d in zip(lists[1:][near[1:]], gap[1:][near[1:]], strict=True):
                if len(own) == REPLICAS:
                    break
                if all(self.gaps[candidate, other] > d for other in own):
                    own.append(int(candidate))
            chosen.append(own)
        return chosen

    def looked_at(self, vectors: np.ndarray, least: float) -> list[list[int]]:
        """Lists that each query looks through: those near enough, and more until they hold ``least`` of all vectors."""
        order, distance = self.walk(self.lift(vectors, query=True))
        chosen = []
        for lists, gap in zip(order, distance, strict=True):
            near = gap <= (1 + LOOK) * gap[0] + 1e-6
            before = np.cumsum(self.shares[lists]) - self.shares[lists]
            chosen.append([int(x) for x in lists[(near | (before < least)) & np.isfinite(gap)]])
        return chosen


def fit_lists(sample: np.ndarray, lists: int, radius: float) -> CentroidGraph:
    """Centroids by k-means in which large lists count as farther away."""
    graph = CentroidGraph(np.zeros((1, sample.shape[1] + 1)), np.ones(1), radius)
    points = graph.lift(sample)
    rng = np.random.default_rng(7)
    centroids = points[rng.permutation(len(points))[: min(lists, len(points))]].copy()
    penalty = np.zeros(len(centroids))
    for _ in range(ROUNDS):
        nearest = np.concatenate([_nearest(points[i : i + 4096], centroids, penalty) for i in range(0, len(points), 4096)])
        size = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros((len(centroids), points.shape[1]))
        np.add.at(total, nearest, points)
        full = size > 0
        # vectors lie on a sphere, and centroids are put there, else all of them would be near its middle
        length = np.maximum(np.sqrt((total[full] ** 2).sum(1)), 1e-30)
        centroids[full] = total[full] * (radius / length)[:, None]
        spread = ((points - centroids[nearest]) ** 2).sum(1).mean()
        penalty = BALANCE * spread * (size * len(centroids) / len(points) - 1)
    return CentroidGraph(centroids[full], size[full] / len(points), radius)


def _nearest(points: np.ndarray, centroids: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) + penalty - 2 * points @ centroids.T).argmin(1)


def usable(boards: DataFrame) -> DataFrame:
    """``board_id, confidences`` of the boards that take part, confidences as doubles.

    Without: boards without an id, vectors that are null, zero or hold a null or
    a number that is not finite, and vectors that are not as long as most.
    """
    rows = boards.select("board_id", F.col("confidences").cast("array<double>").alias("confidences"))
    finite = F.forall("confidences", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = F.exists("confidences", lambda c: c != 0)
    rows = rows.where(F.col("board_id").isNotNull() & F.coalesce(finite & some, F.lit(False)))
    common = rows.groupBy(F.size("confidences").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("confidences") == (common.n if common else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, without nulls, as rows; no Python list is made of them."""
    numbers = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])])
    return numbers.astype(float, copy=False).reshape(len(column), -1)


def _blocks(graph: CentroidGraph, rows: int) -> np.ndarray:
    return np.maximum(1, np.ceil(graph.shares * rows / BLOCK_ROWS)).astype(int)


def _query_blocks(graph: CentroidGraph, asked: DataFrame, least: float) -> np.ndarray:
    """Blocks for the queries of each list, by the share of a sample of them that look at it."""
    lists, rows = len(graph.centroids), asked.count()
    if rows <= QUERY_ROWS:
        return np.ones(lists, int)
    at = F.pmod(F.xxhash64("confidences", F.lit("sample")), F.lit(_RESOLUTION))
    drawn = asked.where(at < F.lit(min(_RESOLUTION, int(_RESOLUTION * SAMPLE_QUERIES / rows)))).collect()
    looked = graph.looked_at(np.array([row.confidences for row in drawn], float), least) if drawn else []
    # a list that few of the sample or none look at may have some queries nevertheless
    hits = np.bincount([x for own in looked for x in own], minlength=lists) + 3
    return np.ceil(rows * np.minimum(1, hits / max(len(drawn), 1)) / QUERY_ROWS).astype(int)


def nearest_boards(boards: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, board_id, score`` of the ``k`` nearest found boards of each query.

    ``boards`` has ``board_id`` (of any type that has an order) and ``confidences`` (array); ``is_query``
    is a condition on ``board_id``.  Candidates are all boards with another id.
    ``score`` is the inner product in double precision; ranks go from 1, largest
    score first, ties to smaller ids.  Rows with equal id and vector count once;
    an id's different vectors are boards of their own, as queries and as
    candidates.  With few boards every candidate is looked at.  An empty table gives an empty one; other columns
    are not looked at.
    """
    spark = boards.sparkSession
    rows = usable(boards).distinct()
    copies = Window.partitionBy("confidences").orderBy("board_id")
    entries = rows.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1)
    entries = cut(entries.groupBy("confidences").agg(F.array_sort(F.collect_list("board_id")).alias("board_ids")))
    queries = rows.where(is_query)
    asked = cut(queries.select("confidences").distinct())

    length = F.sqrt(F.aggregate("confidences", F.lit(0.0), lambda s, c: s + c * c))
    about = entries.agg(F.count("*").alias("n"), F.max(length).alias("radius")).first()
    at = F.pmod(F.xxhash64("confidences"), F.lit(_RESOLUTION))
    few = entries.where(at < F.lit(min(_RESOLUTION, int(_RESOLUTION * SAMPLE_ROWS / max(about.n, 1)))))
    drawn = few.select("confidences").collect() or entries.select("confidences").limit(1).collect()
    sample = np.array([row.confidences for row in drawn], float)
    lists = max(1, min(MOST_LISTS, about.n // LIST_ROWS))
    graph = fit_lists(sample[np.lexsort(sample.T)], lists, about.radius or 0.0) if len(sample) else None
    shared = spark.sparkContext.broadcast(graph)
    blocks = _blocks(graph, about.n) if graph else np.ones(1, int)
    least = 8 * (k + 1) / max(about.n, 1)
    parts = _query_blocks(graph, asked, least) if graph else np.ones(1, int)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in (large.slice(i, _QUERIES_AT_ONCE) for i in range(0, large.num_rows, _QUERIES_AT_ONCE)):
                vectors = _matrix(batch["confidences"])
                homes = shared.value.homes(vectors)
                at = np.repeat(np.arange(len(homes)), [len(h) for h in homes])
                own = np.array([x for h in homes for x in h])
                # a vector's first bits deal it out, whatever its place in the table
                dealt = np.abs(vectors @ np.cos(np.arange(vectors.shape[1]) + 1.0)) * 1e6
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own), pa.array(dealt.astype(np.int64)[at] % blocks[own]), pa.array(parts[own]),
                        *(batch[c].take(pa.array(at)) for c in ("confidences", "board_ids")),
                    ],
                    names=["list", "block", "parts", "confidences", "board_ids"],
                )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch["confidences"]) if batch.num_rows else ()
            for start in range(0, len(vectors), _QUERIES_AT_ONCE):
                looked = shared.value.looked_at(vectors[start : start + _QUERIES_AT_ONCE], least)
                rows = np.repeat(np.arange(len(looked)) + start, [len(own) for own in looked])
                own = np.array([x for own in looked for x in own], int)
                dealt = batch["dealt"].to_numpy(zero_copy_only=False)
                for i in range(0, len(own), _ROWS_AT_ONCE):
                    some, at = own[i : i + _ROWS_AT_ONCE], rows[i : i + _ROWS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some), pa.array(blocks[some]), pa.array(dealt[at] % parts[some]), batch["confidences"].take(pa.array(at))],
                        names=["list", "blocks", "part", "confidences"],
                    )

    def look(asked: pa.Table, there: pa.Table) -> pa.Table:
        return _look(asked, there, k + 1)

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    # each block of a list meets each block of the list's queries in a group of its own
    kind = rows.schema["board_id"].dataType.simpleString()
    posted = entries.mapInArrow(post, f"list bigint, block bigint, parts bigint, confidences array<double>, board_ids array<{kind}>")
    posted = posted.select("list", "block", numbers("parts").alias("part"), "confidences", "board_ids")
    dealt_out = asked.select("confidences", F.pmod(F.xxhash64("confidences"), F.lit(_RESOLUTION)).alias("dealt"))
    looking = dealt_out.mapInArrow(ask, "list bigint, blocks bigint, part bigint, confidences array<double>")
    looking = looking.select("list", numbers("blocks").alias("block"), "part", "confidences")
    met = ("list", "block", "part")
    found = looking.groupBy(*met).cogroup(posted.groupBy(*met)).applyInArrow(
        look, f"confidences array<double>, found array<struct<less:double,board_id:{kind}>>"
    )
    # a vector in several lists is found several times, with the very same score
    merged = found.groupBy("confidences").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("all"))
    new = F.filter("all", lambda f, i: ~f.eqNullSafe(F.get("all", i - 1)))
    best = merged.select("confidences", new.alias("found"))
    answers = queries.join(best, "confidences").select(
        F.col("board_id").alias("query_id"),
        F.filter("found", lambda f: f["board_id"] != F.col("board_id")).alias("found"),
    )
    ranked = answers.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("rank", "f"))
    return ranked.select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("f.board_id").alias("board_id"), (-F.col("f.less")).alias("score")
    )


def _look(asked: pa.Table, there: pa.Table, most: int) -> pa.Table:
    """The nearest entries of one block for each query, with the negative score first, so that they sort."""
    board = there.schema.field("board_ids").type.value_type
    kind = pa.schema([("confidences", pa.list_(pa.float64())), ("found", pa.list_(pa.struct([("less", pa.float64()), ("board_id", board)])))])
    if not asked.num_rows or not there.num_rows:
        return kind.empty_table()
    queries, vectors = _matrix(asked["confidences"]), _matrix(there["confidences"])
    ids = there["board_ids"].to_pylist()
    found = []
    longest = np.sqrt((vectors**2).sum(1).max())
    for start in range(0, len(queries), _QUERIES_AT_ONCE):
        some = queries[start : start + _QUERIES_AT_ONCE]
        scores = some @ vectors.T
        rest = max(0, scores.shape[1] - most)
        # all that tie with the last one are taken, as the smallest ids count; scores may be off by rounding
        off = 4 * vectors.shape[1] * np.finfo(float).eps * longest * np.sqrt((some**2).sum(1))
        least = np.partition(scores, rest, axis=1)[:, rest] - off
        for query, row, last in zip(some, scores, least, strict=True):
            chosen = np.flatnonzero(~(row < last))
            # summed in one way for a pair, wherever it is met
            exact = (query * vectors[chosen]).sum(axis=1).tolist()
            hits = sorted((-score, board) for score, i in zip(exact, chosen, strict=True) for board in ids[i])[:most]
            found.append([{"less": less, "board_id": board} for less, board in hits])
    return pa.table([asked["confidences"].cast(kind.field("confidences").type), pa.array(found, kind.field("found").type)], schema=kind)
