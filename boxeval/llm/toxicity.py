"""Toxic passages in fixture contents, learned from verdicts on whole contents.

Multiple-instance learning: a content is a bag of sentences.  Every sentence
has a probability, the logistic of the weights of its words, and a content is
toxic if any sentence is (noisy-or).  Weights are fitted to verdicts on
contents; the sentences' own probabilities then tell where the passage is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxeval.llm.common import bounded_batches, training_sample

#: Judged contents that the fit looks at, about; all if there are fewer.  One task holds their words.
TRAINING_ROWS = 8_000
#: Bytes of those contents, at most; what is too much of them is left out whole.
TRAINING_BYTES = 64_000_000
#: Words and stems must occur in so many of those contents to have a weight.
LEAST_CONTENTS = 4
#: Lengths of the word starts that count as stems.
STEMS = (3, 4, 5, 6)
ROUNDS, RATE, DECAY, START = 120, 0.4, 1e-5, -6.0
#: Weights below this have no say and are not kept.
LEAST_WEIGHT = 0.02
#: Probability from which a sentence is reported.
OFFENDING = 0.5

_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
_WORD = re.compile(r"[^\W\d_]+")


def parts(text: str) -> set[str]:
    """The words of a text in lower case, and their starts with a mark."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in STEMS:
        found.update([w[:n] + "-" for w in words if len(w) > n])
    return found


@dataclass(frozen=True)
class SentenceModel:
    """Weights of words and stems, and of the empty sentence."""

    weights: dict[str, float]
    bias: float

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and log-odds of each sentence that has a word with a weight."""
        weights = self.weights
        for sentence in _SENTENCE.finditer(text):
            found = parts(sentence[0]) & weights.keys()
            if found:
                yield sentence.start(), sentence.end(), self.bias + sum(weights[w] for w in sorted(found))

    def judge(self, text: str) -> tuple[float, list[dict]]:
        """Noisy-or over the sentences, and the offending ones; plain sentences share one small chance."""
        total = float(np.logaddexp(0, self.bias))
        spans = []
        for start, end, log_odds in self.sentences(text):
            total += float(np.logaddexp(0, log_odds))
            p = 1 / (1 + np.exp(-log_odds))
            if p >= OFFENDING:
                spans.append({"start": start, "end": end, "score": float(p)})
        return float(-np.expm1(-total)), spans


def telling(toxic: Counter, other: Counter, n_toxic: int, n_other: int) -> list[str]:
    """Words and stems that occur in the one kind of contents clearly more often than in the other.

    Their log-odds must be so many standard deviations from 0, more of them
    the more toxic contents there are: few can't prove much, and among many
    words some stand out by chance.
    """
    least = 1 + 0.8 * np.log10(max(n_toxic, 1))
    names = []
    for name in toxic.keys() | other.keys():
        a, b = toxic[name], other[name]
        if a + b >= LEAST_CONTENTS:
            odds = np.log((a + 0.5) / (n_toxic - a + 0.5)) - np.log((b + 0.5) / (n_other - b + 0.5))
            spread = np.sqrt(1 / (a + 0.5) + 1 / (n_toxic - a + 0.5) + 1 / (b + 0.5) + 1 / (n_other - b + 0.5))
            if abs(odds) >= least * spread:
                names.append(name)
    return sorted(names)


def learn(texts: list[str], verdicts: np.ndarray) -> SentenceModel:
    """Fit weights to the verdicts by full gradients with a step per weight."""
    toxic = np.asarray(verdicts) == 1
    counts = Counter(), Counter()
    for text, verdict in zip(texts, toxic, strict=True):
        counts[int(verdict)].update(parts(text))
    names = telling(counts[1], counts[0], int(toxic.sum()), int((~toxic).sum()))
    index = {w: i for i, w in enumerate(names)}
    words, sizes, owners = [], [], []
    for owner, text in enumerate(texts):
        for sentence in _SENTENCE.finditer(text):
            own = sorted(index[w] for w in parts(sentence[0]) & index.keys())
            if own:
                words.append(np.array(own, np.int32))
                sizes.append(len(own))
                owners.append(owner)
    if not words:
        share = float(np.mean(verdicts)) if len(verdicts) else 0.0
        return SentenceModel({}, float(np.log(np.expm1(-np.log1p(-min(max(share, 1e-6), 1 - 1e-6))))))
    flat, size, owner = np.concatenate(words), np.array(sizes), np.array(owners)
    del words, sizes, owners
    at = np.repeat(np.arange(len(size)), size)
    w, b = np.zeros(len(names)), START
    seen_w, seen_b = np.full(len(names), 1e-8), 1e-8
    for _ in range(ROUNDS):
        log_odds = np.bincount(at, w[flat], len(size)) + b
        soft = np.logaddexp(0, log_odds)
        # every content has one sentence more, without words, so that none is certain
        total = np.bincount(owner, soft, len(texts)) + np.logaddexp(0, b)
        slope = np.where(toxic, -1 / np.expm1(np.maximum(total, 1e-12)), 1.0)
        per_sentence = slope[owner] / (1 + np.exp(-log_odds))
        grad = np.bincount(flat, per_sentence[at], len(names)) / len(texts) + DECAY * w
        grad_b = per_sentence.sum() / len(texts) + slope.mean() / (1 + np.exp(-b))
        seen_w += grad**2
        seen_b += grad_b**2
        w -= RATE * grad / np.sqrt(seen_w)
        b -= RATE * grad_b / np.sqrt(seen_b)
    kept = np.flatnonzero(np.abs(w) >= LEAST_WEIGHT)
    return SentenceModel({names[i]: float(w[i]) for i in kept}, float(b))


def bounded_sample(sample: DataFrame, most_bytes: int) -> DataFrame:
    """One row per id of ``id, content, verdict``, and of those as many as have ``most_bytes`` together.

    Of several contents of an id the one with the smallest hash is taken; ids
    are taken in the order of theirs.  The driver sees their sizes only.
    """
    one = sample.groupBy("id").agg(F.min_by("content", F.xxhash64("content")).alias("content"), F.max("verdict").alias("verdict"))
    sizes = one.select("id", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), F.xxhash64("id").alias("at")).collect()
    if sum(row["size"] for row in sizes) <= most_bytes:
        return one
    taken, left = [], most_bytes
    for row in sorted(sizes, key=lambda row: (row["at"], row["id"])):
        if row["size"] <= left:
            taken.append((row["id"],))
            left -= row["size"]
    ids = sample.sparkSession.createDataFrame(taken, StructType([sample.schema["id"]]))
    return one.join(F.broadcast(ids), "id", "left_semi")


def fit_toxicity(
    contents: DataFrame, verdicts: DataFrame, rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES
) -> SentenceModel:
    """Fit on about ``rows`` of the contents (``id, content``) that ``verdicts`` (``id, verdict``) judges.

    The sample has one row per id and is bounded by ``rows`` and ``most_bytes``,
    whatever repeats and however long contents are, so one task may learn from
    all of it; if its executor is lost, another repeats it.  Without verdicts
    nothing is known to be toxic, and every content's score is about 0.
    """
    bounded_batches(contents.sparkSession)
    sample = bounded_sample(training_sample(contents, verdicts, rows), most_bytes)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            row
            for batch in batches
            for row in zip(batch["id"].to_pylist(), batch["content"].to_pylist(), batch["verdict"].to_pylist(), strict=True)
        ]
        rows.sort(key=lambda row: (row[0], row[1] or ""))  # the order in which rows arrive must not matter
        model = learn([row[1] or "" for row in rows], np.array([row[2] for row in rows]))
        yield pa.RecordBatch.from_pydict(
            {"word": ["", *model.weights], "weight": [model.bias, *model.weights.values()]},
            schema=pa.schema([("word", pa.string()), ("weight", pa.float64())]),
        )

    # dealt anew rather than coalesced: many tasks read the table, one gets the sample
    learned = sample.repartition(1).mapInArrow(train, "word string, weight double").collect()
    weights = {row.word: row.weight for row in learned}
    bias = weights.pop("", learn([], np.zeros(0)).bias)
    return SentenceModel(weights, bias)


def toxicity(content: Column, model: SentenceModel) -> Column:
    """``struct<score, passages>`` of each content; a null content is judged as an empty one."""
    kind = pa.struct(
        [
            ("score", pa.float64()),
            ("passages", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
        ]
    )

    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            results = [model.judge(text or "") for text in batch.to_pylist()]
            yield pa.array([{"score": score, "passages": spans} for score, spans in results], kind)

    judged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(judged, "score double, passages array<struct<start:int,end:int,score:double>>")(content)


def score_toxicity(contents: DataFrame, model: SentenceModel) -> DataFrame:
    """``id, score, passages`` for every row of ``contents`` (``id``, ``content``), without a shuffle.

    ``passages`` are the offending sentences with their places in code points,
    end exclusive.  A content is judged sentence by sentence, however long it
    is, and may be one sentence.  Repeated rows give repeated results, an empty table an empty
    one; other columns are not looked at.
    """
    bounded_batches(contents.sparkSession)
    return contents.select("id", toxicity(F.col("content"), model).alias("t")).select("id", "t.score", "t.passages")
