"""Quality of fixture contents by a regularised quadratic discriminant.

Each content becomes a vector of transformed statistics (logarithms of lengths
of words, logits of shares).  How long a content is says nothing of its
quality and is not among them.  Each class has a mean and a covariance, shrunk towards the
pooled one and towards its own diagonal; their Cholesky factors are computed
once.  The score is the logistic of the difference of the two log-densities
plus the log of the classes' odds.

Verdicts are the project's own 1 (usable) and 0 (not).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.llm.common import bounded_batches, training_sample

#: Judged contents that the fit looks at, about; all if there are fewer.
TRAINING_ROWS = 40_000
#: Weight of the pooled covariance in that of a class, and of the diagonal in the result.
POOLED, DIAGONAL = 0.3, 0.05
#: Variance that every statistic has at least.
LEAST_VARIANCE = 1e-3

#: Different words that every content is taken to have besides its own, so that a few words are not yet a repetition.
PLAIN = 20

_LETTERS_ONLY = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.compile(r"[^\w\s]+")
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_DIGITS = re.compile(r"\d")

STATISTICS = (
    "word_length", "longest_word", "letters", "upper", "digits", "symbols", "symbol_runs", "longest_symbol_run",
    "blanks", "distinct_words", "commonest_word", "distinct_pairs", "distinct_lines",
)


def _logit(share: float) -> float:
    return math.log((share + 0.002) / (1.002 - share))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one content; an empty one has those of no words."""
    n = len(text)
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    lengths = list(map(len, words)) or [0]
    seen: dict[str, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    runs = _SYMBOLS.findall(text)
    letters = sum(map(len, _LETTERS_ONLY.findall(text)))
    lowered = text.lower()
    upper = sum(map(str.__ne__, text, lowered)) if len(lowered) == n else len(_UPPER.findall(text))
    pairs = len(set(zip(words, words[1:], strict=False)))
    size = n + 10 * PLAIN
    count = len(words) + PLAIN
    return [
        math.log1p((sum(lengths) + 5 * PLAIN) / count),
        math.log1p(max(lengths)),
        _logit((letters + 8 * PLAIN) / size),
        _logit((upper + 0.3 * PLAIN) / size),
        _logit(len(_DIGITS.findall(text)) / size),
        _logit((sum(map(len, runs)) + 0.3 * PLAIN) / size),
        _logit(min(1.0, (len(runs) + 0.15 * PLAIN) / count)),
        math.log1p(max(map(len, runs), default=0)),
        _logit((n - sum(lengths) + 1.7 * PLAIN) / size),
        _logit((len(seen) + PLAIN) / (len(words) + PLAIN)),
        _logit(max(seen.values(), default=0) / (len(words) + PLAIN)),
        _logit((pairs + PLAIN) / (max(len(words) - 1, 0) + PLAIN)),
        _logit((len(set(lines)) + PLAIN / 10) / (len(lines) + PLAIN / 10)),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log-determinants of the two classes, and the log of their odds."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1, higher where verdict 1 is likelier."""
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets, strict=True):
            white = np.linalg.solve(factor, (rows - mean).T)
            density.append(-0.5 * ((white**2).sum(axis=0) + log_det))
        gap = np.clip(density[1] - density[0] + self.log_odds, -500, 500)
        return 1 / (1 + np.exp(-gap))


def _sums(contents: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per verdict: number, sum and sum of products of the statistics of one task's rows."""
    k = len(STATISTICS)
    n, total, square = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for batch in contents:
        verdicts = np.asarray(batch.column("verdict").to_pylist())
        rows = np.array([statistics(text or "") for text in batch.column("content").to_pylist()]).reshape(-1, k)
        for verdict in (0, 1):
            own = rows[verdicts == verdict]
            n[verdict] += len(own)
            total[verdict] += own.sum(axis=0)
            square[verdict] += own.T @ own
    for verdict in (0, 1):
        sums = np.concatenate([[n[verdict]], total[verdict], square[verdict].ravel()])
        yield pa.RecordBatch.from_pydict(
            {"verdict": [verdict] * len(sums), "at": list(range(len(sums))), "x": sums.tolist()},
            schema=pa.schema([("verdict", pa.int32()), ("at", pa.int32()), ("x", pa.float64())]),
        )


def fit_quality(contents: DataFrame, verdicts: DataFrame, rows: int = TRAINING_ROWS) -> Discriminant:
    """Fit on about ``rows`` of the contents (``id, content``) that ``verdicts`` (``id, verdict``) judges.

    Tasks add up their own rows; the driver gets the two classes' sums.  A class
    without rows takes the other's covariance and mean, so all scores are then
    the same; with no verdicts at all they are 0.5.
    """
    spark = contents.sparkSession
    bounded_batches(spark)
    k = len(STATISTICS)
    sample = training_sample(contents, verdicts, rows).select("content", "verdict")
    parts = sample.mapInArrow(_sums, "verdict int, at int, x double")
    sums = np.zeros((2, 1 + k + k * k))
    for verdict, at, x in parts.groupBy("verdict", "at").agg(F.sum("x").alias("x")).collect():
        sums[verdict, at] = x
    n, total, square = sums[:, 0], sums[:, 1 : k + 1], sums[:, k + 1 :].reshape(2, k, k)
    both = max(n.sum(), 1)
    overall = total.sum(axis=0) / both
    means = np.array([total[c] / n[c] if n[c] else overall for c in (0, 1)])
    scatter = np.array([square[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = scatter.sum(axis=0) / both
    factors, log_dets = [], []
    for c in (0, 1):
        own = scatter[c] / n[c] if n[c] else pooled
        weight = max(POOLED, k / (n[c] + k))
        mixed = (1 - weight) * own + weight * pooled
        mixed = (1 - DIAGONAL) * mixed + DIAGONAL * np.diag(np.diag(mixed))
        factor = np.linalg.cholesky(mixed + LEAST_VARIANCE * np.eye(k))
        factors.append(factor)
        log_dets.append(2 * np.log(np.diag(factor)).sum())
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    return Discriminant(means, np.array(factors), np.array(log_dets), log_odds)


def quality_score(content: Column, model: Discriminant) -> Column:
    """Score from 0 to 1 of each content; a null content is scored as an empty one."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.array([statistics(text or "") for text in batch.to_pylist()]).reshape(-1, len(STATISTICS))
            yield pa.array(model.score(rows), pa.float64())

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scores, "double")(content)


def score_quality(contents: DataFrame, model: Discriminant) -> DataFrame:
    """``id, score`` for every row of ``contents`` (``id``, ``content``), without a shuffle.

    Repeated rows give repeated results, an empty table an empty one; other
    columns are not looked at.
    """
    bounded_batches(contents.sparkSession)
    return contents.select("id", quality_score(F.col("content"), model).alias("score"))
