"""Confidence vectors of boards, whitened along their leading components.

The components are eigenvectors of the covariance.  How many eigenvalues lie
above a number is the count of positive pivots when the covariance, less that
number on its diagonal, is factored as L D L^T.  Such counts cut the spectrum
into slices with one eigenvalue each; Rayleigh quotient iteration finds it, and
counts just above and below it show that it has the number it is given.

Sums over boards are made by Spark; only the covariance, whose size depends on
the length of a vector and not on the number of boards, is factored on the
driver.  A factorisation takes about d^3 steps for vectors of d entries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.llm.common import bounded_batches

#: Components that are sought, at most.
COMPONENTS = 32
# fixed values: confidences as whole numbers of 64ths, moved up by a million
STEPS, OFFSET = 64, 1_000_000
#: Eigenvalues at or below this part of a bound on the largest are none: along them boards do not differ.
LEAST_SHARE = 1e-11
#: Eigenvalues that lie this close together, as a part of that bound, are not told apart by counts.
RESOLUTION = 1e-12
_ALPHA = (1 + math.sqrt(17)) / 8
_ROUNDS = 60
_EXACT = 2**62


def confidence_levels(boards: DataFrame) -> DataFrame:
    """``board_id, levels`` of the boards whose ``confidences`` are all there and finite.

    Levels are whole numbers: 64 times the confidence, rounded down, plus a
    million; beyond the range of a bigint they end at its ends.  Only the length
    that most boards have takes part, of two equally frequent ones the longer.
    Boards without confidences have no length.
    """
    size = F.size("confidences")
    finite = F.forall("confidences", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = boards.select("board_id", F.col("confidences").cast("array<double>").alias("confidences"))
    whole = whole.where(F.col("confidences").isNotNull() & finite)
    lengths = whole.groupBy(size.alias("size")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    levels = F.transform("confidences", lambda c: F.least(F.floor(STEPS * c), F.lit(2**63 - 1 - OFFSET)) + OFFSET)
    return whole.where(size == (most["size"] if most else 0)).select("board_id", levels.alias("levels"))


def positive_eigenvalues(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive, by the pivots of L D L^T.

    The pivot is the largest entry of the diagonal, or a block of two rows around
    the largest entry of all where the diagonal is small against it, so that no
    entry grows much (Bunch and Parlett).
    """
    a = np.array(matrix, float)
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0)
        r, s = divmod(int(off.argmax()), len(a))
        if off[r, s] == 0 and diagonal[p] == 0:
            break
        if diagonal[p] >= _ALPHA * off[r, s]:
            rest = np.delete(np.arange(len(a)), p)
            positive += int(a[p, p] > 0)
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[p, p])
        else:
            # such a block has a negative determinant: one eigenvalue of either sign
            rest = np.delete(np.arange(len(a)), [r, s])
            positive += 1
            block = a[np.ix_([r, s], [r, s])]
            columns = a[np.ix_(rest, [r, s])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        a = (a + a.T) / 2
    return positive


class Spectrum:
    """The leading eigenvalues of a covariance, found slice by slice."""

    def __init__(self, covariance: np.ndarray) -> None:
        self.covariance = (covariance + covariance.T) / 2
        self.identity = np.eye(len(covariance))
        # no eigenvalue is larger than the largest sum of a row
        self.top = float(np.abs(self.covariance).sum(axis=1).max(initial=0)) * (1 + 1e-9)

    def above(self, value: float) -> int:
        """How many eigenvalues are larger than ``value``."""
        return positive_eigenvalues(self.covariance - value * self.identity)

    def slices(self, wanted: int) -> list[tuple[float, float, int]]:
        """``low, high, number`` of slices that hold the ``wanted`` largest eigenvalues, falling.

        A slice holds one eigenvalue, or several that are as good as equal.
        """
        least = self.top * LEAST_SHARE
        found, open_ = [], [(least, self.top, self.above(least), 0)]
        while open_:
            low, high, to_low, to_high = open_.pop()
            if to_low == to_high or to_high >= wanted:
                continue
            if to_low - to_high == 1 or high - low <= RESOLUTION * self.top:
                found.append((low, high, to_low - to_high))
                continue
            middle = (low + high) / 2
            to_middle = self.above(middle)
            open_ += [(low, middle, to_low, to_middle), (middle, high, to_middle, to_high)]
        return found

    def _iterate(self, low: float, high: float, others: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration from the middle of a slice, at right angles to the ``others``."""

        def turned(x: np.ndarray) -> np.ndarray:
            for _ in range(2):
                x = x - others.T @ (others @ x)
            return x / np.linalg.norm(x)

        x = turned(np.random.default_rng(seed).normal(size=len(self.identity)))
        shift, value = (low + high) / 2, math.inf
        for step in range(_ROUNDS):
            try:
                solved = np.linalg.solve(self.covariance - shift * self.identity, x)
            except np.linalg.LinAlgError:
                solved = np.array([math.inf])
            if not np.isfinite(solved).all():  # the shift is an eigenvalue: go on beside it
                shift += RESOLUTION * self.top
                continue
            x = turned(solved)
            before, value = value, float(x @ self.covariance @ x)
            if abs(value - before) <= 4e-16 * self.top:
                break
            # the first steps keep the shift, so that the slice's own vector comes to lead
            if step >= 2:
                shift = value
        return value, x

    def leading(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest eigenvalues, falling, and their unit vectors as rows.

        Raises ``ArithmeticError`` if counts do not bear out the numbering.
        """
        values, vectors = np.zeros(0), np.zeros((0, len(self.identity)))
        slack = RESOLUTION * self.top
        for low, high, number in self.slices(wanted):
            for k in range(number):
                inner_low, inner_high = low, high
                for attempt in range(_ROUNDS):
                    value, x = self._iterate(inner_low, inner_high, vectors, attempt)
                    if low - slack <= value <= high + slack:
                        break
                    # another slice's value was met: halve the slice around its own one and start nearer
                    middle = (inner_low + inner_high) / 2
                    if self.above(middle) > len(values) - k:
                        inner_low = middle
                    else:
                        inner_high = middle
                values, vectors = np.append(values, value), np.vstack([vectors, x])
        order = np.argsort(-values, kind="stable")[:wanted]
        values, vectors = values[order], vectors[order]
        margin = 4 * slack
        for number, value in enumerate(values, 1):
            if not (self.above(value + margin) < number <= self.above(value - margin)):
                raise ArithmeticError(f"component {number}: counts do not bear out the eigenvalue {value}")
        return values, vectors


@dataclass(frozen=True)
class Whitening:
    """Number and sums of the fitted levels, and their leading components.

    ``vectors`` has a unit vector per row, ``eigenvalues`` fall, and ``trace`` is
    the whole variance.
    """

    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    vectors: np.ndarray

    def explained(self) -> list[float]:
        """The part of the whole variance along each component."""
        return [float(e) / self.trace for e in self.eigenvalues]


def _levels(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("levels").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1).astype(np.int64, copy=False)


def _largest(whole: np.ndarray) -> int:
    return max(int(whole.max(initial=0)), -int(whole.min(initial=0)))


def _from_mean(levels: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n`` times each level, less its dimension's sum: whole numbers, exact whatever their size."""
    largest = max(_largest(levels) * n, *map(abs, sums), 0)
    kind = np.int64 if largest < _EXACT // 2 else object
    return levels.astype(kind) * n - np.array(sums, kind)


def _squares(gaps: np.ndarray) -> list[int]:
    if _largest(gaps)**2 * max(gaps.shape[1], 1) >= _EXACT:
        gaps = gaps.astype(object)
    return [int(s) for s in (gaps * gaps).sum(axis=1)]


class Moments:
    """Number, mean and centred products of rows; parts are joined without losing digits."""

    def __init__(self, size: int) -> None:
        self.n, self.mean, self.products = 0, np.zeros(size), np.zeros((size, size))

    def add(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        if n:
            gap, both = mean - self.mean, self.n + n
            self.products = self.products + products + np.outer(gap, gap) * (self.n * n / both)
            self.mean, self.n = self.mean + gap * (n / both), both

    def add_rows(self, rows: np.ndarray) -> None:
        if len(rows):
            mean = rows.mean(axis=0)
            self.add(len(rows), mean, (rows - mean).T @ (rows - mean))

    def cells(self, task: int) -> pa.RecordBatch:
        """One row per line of the products, with the number and mean of all rows."""
        size = len(self.mean)
        return pa.RecordBatch.from_pydict(
            {"task": [task] * size, "at": list(range(size)), "n": [self.n] * size, "mean": self.mean.tolist(), "products": self.products.tolist()},
            schema=pa.schema([("task", pa.int64()), ("at", pa.int32()), ("n", pa.int64()), ("mean", pa.float64()), ("products", pa.list_(pa.float64()))]),
        )


def _whole_moments(rows: DataFrame, size: int, of) -> Moments:
    """Moments of ``of(batch)`` over all rows: tasks add up their own, then a few tasks add up those of many."""
    from pyspark import TaskContext

    kind = "task bigint, at int, n bigint, mean double, products array<double>"

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = Moments(size)
        for batch in batches:
            moments.add_rows(of(batch))
        if moments.n:
            yield moments.cells(TaskContext.get().partitionId())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, parts = Moments(size), {}
        for batch in batches:
            for row in batch.to_pylist():
                part = parts.setdefault(row["task"], [])
                part.append(row)
                if len(part) == size:
                    part = sorted(parts.pop(row["task"]), key=lambda r: r["at"])
                    moments.add(part[0]["n"], np.array([r["mean"] for r in part]), np.array([r["products"] for r in part]))
        if moments.n:
            yield moments.cells(TaskContext.get().partitionId())

    parts = rows.mapInArrow(own, kind)
    fewer = parts.repartition(_FAN_IN, F.pmod("task", F.lit(_FAN_IN))).mapInArrow(joined, kind)
    found = {}
    for row in fewer.collect():
        found.setdefault(row["task"], {})[row["at"]] = row
    moments = Moments(size)
    for part in found.values():
        lines = [part[at] for at in range(size)]
        moments.add(lines[0]["n"], np.array([r["mean"] for r in lines]), np.array([r["products"] for r in lines]))
    return moments


#: Tasks that add up the moments of all others; the driver adds up theirs.
_FAN_IN = 16


def fit_whitening(levels: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The leading components of ``levels`` (``board_id``, ``levels``), over all rows.

    ``levels`` are bigint arrays of one length without nulls, as
    :func:`confidence_levels` gives.  Sums are exact; the covariance is that of
    levels less their means, with the number of rows as divisor.  There are
    fewer components than asked for if there are fewer dimensions or boards
    differ along fewer, and none for an empty table or equal boards.
    """
    sums = levels.select(F.posexplode("levels").alias("at", "x")).groupBy("at").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")
    )
    bounded_batches(levels.sparkSession)
    own = {row["at"]: row for row in sums.collect()}
    n, size = (own[0]["n"] if own else 0), len(own)
    totals = tuple(int(own[at]["s"]) for at in range(size))
    nothing = Whitening(n, totals, 0.0, np.zeros(0), np.zeros((0, size)))
    if not n:
        return nothing
    moments = _whole_moments(levels, size, lambda batch: (_from_mean(_levels(batch), n, totals) / n).astype(float))
    spectrum = Spectrum(moments.products / n)
    if not spectrum.top:
        return nothing
    values, vectors = spectrum.leading(min(components, size))
    return Whitening(n, totals, float(np.trace(spectrum.covariance)), values, vectors)


def _whitened(gaps: np.ndarray, model: Whitening) -> np.ndarray:
    return (gaps / model.n).astype(float) @ (model.vectors / np.sqrt(model.eigenvalues)[:, None]).T


def whiten(levels: DataFrame, model: Whitening) -> DataFrame:
    """``board_id, deviation, whitened`` for every row of ``levels``; no rows if the model has no components.

    ``whitened`` has an entry per component, with mean 0 and variance 1 over the
    fitted rows and no covariance; ``deviation`` is the exact sum over dimensions
    of (n * level - sum)^2.  Repeated ids, and rows without one, stay rows.
    """
    if not len(model.eigenvalues):
        return levels.sparkSession.createDataFrame([], f"board_id {levels.schema['board_id'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")

    def project(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            gaps = _from_mean(_levels(pa.RecordBatch.from_arrays([batch], ["levels"])), model.n, model.sums)
            white = pa.array(_whitened(gaps, model).tolist(), pa.list_(pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(map(str, _squares(gaps)), pa.string()), white], ["deviation", "whitened"])

    project.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    projected = F.arrow_udf(project, "deviation string, whitened array<double>")(F.col("levels"))
    rows = levels.select("board_id", projected.alias("w"))
    return rows.select("board_id", F.col("w.deviation").cast("decimal(38,0)").alias("deviation"), "w.whitened")


def identity_error(levels: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened levels is from the identity, in its worst entry."""
    size = len(model.eigenvalues)
    if not size:
        return 0.0
    moments = _whole_moments(levels, size, lambda batch: _whitened(_from_mean(_levels(batch), model.n, model.sums), model))
    return float(np.abs(moments.products / moments.n - np.eye(size)).max())
