"""Lempel-Ziv fingerprints of fixture contents.

A content is parsed into dictionary phrases: the longest phrase met before plus
one more code point makes the next phrase.  The set of phrases is hashed and
kept as minima: bits of each hash choose one of ``BINS`` bins, and a bin keeps
bits of its smallest hash.  Contents that would compress well together share
many phrases and so many minima.

Equal contents have equal fingerprints.  An empty content has no phrase: all
its bins are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from boxeval.llm.common import bounded_batches, join_facts
from boxeval.operators.ordered import row_numbers
from boxeval.session import cut

BINS = 128
EMPTY = 0xFFFF
#: Neighbouring rows that are taken together, about.
PART_ROWS = 4000
#: Bounds between parts are held by the driver and every task; beyond this, parts grow instead.
MOST_PARTS = 20_000

_CODE_BITS = 21
_FACTOR, _SEED, _MASK = 0x9E3779B97F4A7C15, 0x243F6A8885A308D3, (1 << 64) - 1


class Phrases:
    """The phrases of a text that is read piece by piece."""

    def __init__(self) -> None:
        self.next_phrase: dict[int, int] = {}
        self.hashes = [_SEED]
        self.phrase = 0

    def fork(self) -> Phrases:
        other = Phrases()
        other.next_phrase, other.hashes, other.phrase = self.next_phrase.copy(), self.hashes.copy(), self.phrase
        return other

    def read(self, text: str) -> Phrases:
        longer, hashes, phrase = self.next_phrase, self.hashes, self.phrase
        get = longer.get
        for code in np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).tolist():
            key = phrase | code
            known = get(key)
            if known is None:
                longer[key] = len(hashes) << _CODE_BITS
                hashes.append((hashes[phrase >> _CODE_BITS] * _FACTOR + code + 1) & _MASK)
                phrase = 0
            else:
                phrase = known
        self.phrase = phrase
        return self

    def minima(self) -> np.ndarray:
        """Bits of the smallest phrase hash in each bin."""
        h = np.array(self.hashes[1:], np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h.sort()
        found = np.full(BINS, EMPTY, np.uint16)
        if len(h):
            bins = (h >> np.uint64(57)).astype(np.int64)
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            found[bins[first]] = np.minimum(h[first] & np.uint64(0xFFFF), EMPTY - 1)
        return found


def fingerprint(text: str) -> np.ndarray:
    return Phrases().read(text).minima()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bins used by either in which both have the same minimum; 1 if none is used."""
    used = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & used).sum() / used.sum()) if used.any() else 1.0


def _hex(minima: np.ndarray) -> str:
    return minima.astype(">u2").tobytes().hex()


def _part_bounds(contents: DataFrame) -> tuple[list[int], dict[int | None, list[int]]]:
    """Lower bounds of ranges of ids, and for the largest id of a range the ranges that it comes after."""
    ids = contents.select("id")
    rows = ids.count()
    parts = max(1, min(rows // PART_ROWS, MOST_PARTS))
    shares = [i / parts for i in range(1, parts)]
    bounds: list[int] = []
    if shares:
        found = ids.agg(F.percentile_approx("id", shares, 10 * parts).alias("b")).first().b or []
        bounds = sorted(set(found))
    tops = ids.select("id", _part_of(F.col("id"), bounds).alias("part")).groupBy("part").agg(F.max("id").alias("top")).collect()
    tops.sort(key=lambda row: row.part)
    # what follows the lowest row of a part is the top of the part below; what follows the last row of all is the first
    follows = {above.part: below for below, above in zip([tops[-1], *tops], tops, strict=False)} if tops else {}
    asked: dict[int | None, list[int]] = {}
    for part, below in follows.items():
        asked.setdefault(below.top, []).append(part)
    return bounds, asked


def _part_of(fixture_id: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the id; a null id is below all."""
    edges = np.array(bounds, np.int64)

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.array(np.searchsorted(edges, values, side="right").astype(np.int64))

    place.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(place, "bigint")(fixture_id)


def fingerprint_neighbours(contents: DataFrame) -> DataFrame:
    """Fingerprints of every content and of its edited text, and how like they are.

    Rows are taken by falling ``id`` (nulls last, rows of one id by content), and the first row follows the last.  The edited text of a content
    has its last floor(n_chars / 2) code points replaced by as many first ones
    of the next row's content, or by all of it.  Returns ``id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Ranges of ids are dealt out once, each with a copy of the row that follows
    its last one; no task sees more than its ranges.  A null content counts as
    empty, repeated rows are rows of their own, an empty table gives an empty
    one, and other columns are not looked at.
    """
    if not isinstance(contents.schema["id"].dataType, IntegralType):
        return _by_number(contents)
    bounded_batches(contents.sparkSession)
    texts = contents.select(F.col("id").cast("bigint").alias("id"), F.coalesce("content", F.lit("")).alias("content"))
    bounds, asked = _part_bounds(texts)
    edges = np.array(bounds, np.int64)

    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = batch.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            own = np.searchsorted(edges, values, side="right").tolist()
            yield pa.array(
                [
                    [{"part": part, "copy": False}, *({"part": other, "copy": True} for other in asked.get(fixture, ()))]
                    for part, fixture in zip(own, batch.to_pylist(), strict=True)
                ],
                pa.list_(pa.struct([("part", pa.int64()), ("copy", pa.bool_())])),
            )

    places.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    place = F.arrow_udf(places, "array<struct<part:bigint,copy:boolean>>")(F.col("id"))
    dealt = (
        texts.withColumn("at", F.explode(place))
        .select("at.part", "at.copy", "id", "content")
        .repartition(max(1, len(bounds) + 1), "part")
        .sortWithinPartitions("part", "copy", F.col("id").desc_nulls_last(), "content")
    )
    return dealt.mapInArrow(
        _compare,
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _by_number(contents: DataFrame) -> DataFrame:
    """As :func:`fingerprint_neighbours`, by the places of ids among all ids where these are no integers."""
    ids = contents.where(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("rows"))
    numbers = cut(row_numbers(ids.withColumn("all", F.lit(0)), ["all"], [F.col("id")], "number").select("id", "rows", "number"))
    named = join_facts(contents.where(F.col("id").isNotNull()).select("id", "content"), numbers, "id", "rows")
    others = contents.where(F.col("id").isNull()).select(F.lit(None).cast("bigint").alias("number"), "content")
    texts = named.select("number", "content").unionByName(others).withColumnRenamed("number", "id")
    found = cut(fingerprint_neighbours(texts).withColumnRenamed("id", "number"))
    columns = ["id", *found.columns[1:]]
    back = join_facts(found.where(F.col("number").isNotNull()), numbers, "number", "rows").select(*columns)
    none = F.lit(None).cast(numbers.schema["id"].dataType).alias("id")
    return back.unionByName(found.where(F.col("number").isNull()).select(none, *found.columns[1:]))


_RESULT = pa.schema(
    [
        ("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; each is told when the next one of its part is known."""
    before = None  # part, id, text, phrases of the half that stays, minima
    for batch in batches:
        told = []
        columns = (batch[name].to_pylist() for name in ("part", "copy", "id", "content"))
        for part, copy, fixture, text in zip(*columns, strict=True):
            open_row = before is not None and before[0] == part
            if copy and not open_row:
                continue  # of several rows with the id that follows, the first counts
            half = len(text) // 2
            kept = Phrases().read(text[: len(text) - half])
            whole = (kept.fork() if half else kept).read(text[len(text) - half :])
            minima = whole.minima()
            if open_row:
                told.append(_pair(before, text, minima))
            before = None if copy else (part, fixture, text, kept, minima)
        yield pa.RecordBatch.from_pylist(told, schema=_RESULT)


def _pair(row: tuple, next_text: str, next_minima: np.ndarray) -> dict:
    _, fixture, text, kept, minima = row
    half = len(text) // 2
    if half:
        tail = next_text[:half]
        edited, edited_minima = text[: len(text) - half] + tail, kept.read(tail).minima()
    else:
        edited, edited_minima = text, minima
    return {
        "id": fixture,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": _hex(minima),
        "edited_fingerprint": _hex(edited_minima),
        "near_edited": likeness(minima, edited_minima),
        "near_next": likeness(minima, next_minima),
    }
