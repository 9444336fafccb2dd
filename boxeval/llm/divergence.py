"""How the sources of fixtures differ in the terms they use, language by language.

Each task folds whole contents into stripes: a term with the number of contents
that have it and its occurrences per source.  Stripes leave the task when there
are many of them, and are merged by language and term; even the most frequent
term has one row per task then, or a few.  Divergences come straight from merged
stripes: a stripe says how often each source uses its term, and all others use
it as often as a source that never does.

All numbers are whole and exact.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxeval.llm.common import bounded_batches
from boxeval.session import cut

#: Contents of a language that a term must be in.
LEAST_CONTENTS = 3
#: Terms of a source that are listed.
LISTED_TERMS = 200
# fixed value: shares are whole numbers of thousand millionths
PARTS = 1_000_000_000
#: A task hands on its stripes when it has this many counters, or this many bytes of terms.
STRIPE_CELLS, STRIPE_BYTES = 400_000, 32_000_000
#: A text is taken apart in runs of this many bytes, to its next gap between terms.
_RUN = 1 << 22
#: Entries of a matrix of terms by sources, or of sources by sources, that a task holds.
_ENTRIES = 1 << 21
_STRIPE = "language string, term binary, contents bigint, sources array<string>, counts array<bigint>"
_STRIPE_ARROW = pa.schema(
    [
        ("language", pa.string()), ("term", pa.binary()), ("contents", pa.int64()),
        ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())),
    ]
)
# fixed values: what terms are made of are letters A to Z in either case, lowered, and all that is not ASCII
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(content: bytes) -> Counter:
    """Occurrences of each term of an UTF-8 text."""
    found, start = Counter(), 0
    while start < len(content):
        run = content[start : start + _RUN].translate(_FOLD)
        end = start + len(run)
        if end < len(content) and b" " not in run:
            gap = content[start:].translate(_FOLD).find(b" ")
            end = len(content) if gap < 0 else start + gap
            run = content[start:end].translate(_FOLD)
        elif end < len(content):
            end = start + run.rindex(b" ") + 1
            run = run[: end - start]
        found.update(run.split())
        start = end
    return found


def _handed_on(language: str, terms: dict, at_once: int = 8192) -> Iterator[pa.RecordBatch]:
    items = iter(terms.items())
    while some := list(itertools.islice(items, at_once)):
        contents, sources, counts, ends = [], [], [], [0]
        for _, stripe in some:
            if type(stripe) is str:
                contents.append(1)
                sources.append(stripe)
                counts.append(1)
            else:
                contents.append(stripe[0])
                sources.extend(stripe[1])
                counts.extend(stripe[1].values())
            ends.append(len(sources))
        yield _batch([language] * len(some), [term for term, _ in some], contents, ends, sources, counts)


def _batch(languages, terms, contents, ends, sources, counts) -> pa.RecordBatch:
    ends = pa.array(ends, pa.int32())
    columns = [
        pa.array(languages, pa.string()), pa.array(terms, pa.binary()), pa.array(contents, pa.int64()),
        pa.ListArray.from_arrays(ends, pa.array(sources, pa.string())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_STRIPE_ARROW)


def _stripes(contents: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of one task's contents; a term has one each time they are handed on.

    A stripe is ``[contents, {source: count}]``, or just the source as long as
    the term occurred once.
    """
    held: dict[str, dict[bytes, list | str]] = {}
    cells = size = 0
    for batch in contents:
        texts = batch.column("content").cast(pa.binary())
        rows = zip(texts, batch.column("language").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for text, language, source in rows:
            terms = held.setdefault(language, {})
            for term, n in term_counts(text.as_py()).items():
                stripe = terms.get(term)
                if stripe is None:
                    terms[term] = source if n == 1 else [1, {source: n}]
                    size += len(term)
                    cells += 1
                    continue
                if type(stripe) is str:
                    terms[term] = stripe = [1, {stripe: 1}]
                stripe[0] += 1
                before = stripe[1].get(source)
                if before is None:
                    stripe[1][source] = n
                    cells += 1
                else:
                    stripe[1][source] = before + n
            if cells >= STRIPE_CELLS or size >= STRIPE_BYTES:
                for name, terms in held.items():
                    yield from _handed_on(name, terms)
                held, cells, size = {}, 0, 0
    for name, terms in held.items():
        yield from _handed_on(name, terms)


def _runs_merged(rows: pa.Table) -> pa.Table:
    """Rows that follow each other with one language and term as one row."""
    same = np.ones(max(rows.num_rows - 1, 0), bool)
    for name in ("language", "term"):
        column = rows.column(name).combine_chunks()
        same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    if not same.any():
        return rows
    starts = np.flatnonzero(np.concatenate([[True], ~same]))
    run = np.cumsum(np.concatenate([[0], ~same]))
    sources = rows.column("sources").combine_chunks()
    lengths = sources.value_lengths().to_numpy()
    coded = sources.flatten().dictionary_encode()
    key = np.repeat(run, lengths) * len(coded.dictionary) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.add.reduceat(rows.column("counts").combine_chunks().flatten().to_numpy()[order], first)
    ends = np.searchsorted(key[first] // len(coded.dictionary), np.arange(len(starts) + 1))
    kept = rows.select(["language", "term"]).take(pa.array(starts)).combine_chunks()
    contents = np.add.reduceat(rows.column("contents").to_numpy(), starts)
    names = coded.dictionary.take(pa.array(key[first] % len(coded.dictionary)))
    columns = (c.combine_chunks() for c in kept.columns)
    return pa.Table.from_batches([_batch(*columns, contents, ends, names, counts)])


def _merged(least: int):
    """One stripe per run of rows with one language and term, where it has at least so many contents."""

    def enough(rows: pa.Table) -> list[pa.RecordBatch]:
        return rows.filter(pc.greater_equal(rows.column("contents"), least)).to_batches()

    def run(stripes: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _STRIPE_ARROW.empty_table()
        for batch in stripes:
            # a run may go on in the next batch
            rows = _runs_merged(pa.concat_tables([last, pa.Table.from_batches([batch]).cast(_STRIPE_ARROW)]))
            yield from enough(rows.slice(0, max(rows.num_rows - 1, 0)))
            last = rows.slice(max(rows.num_rows - 1, 0))
        yield from enough(last)

    return run


def term_stripes(contents: DataFrame, least_contents: int = 1) -> DataFrame:
    """``language, term, contents, sources, counts``: one stripe per language and term of at least so many contents.

    ``contents`` has ``content``, ``language`` and ``source``; a null is an empty
    text.  A term is as many letters (A to Z, lowered) and characters beyond
    ASCII as stand together, and is given as UTF-8 bytes.  Each row is a content
    of its own, repeated ones too.  A task holds at most ``STRIPE_CELLS`` counters
    or ``STRIPE_BYTES`` of terms and those of one content, however long it is.
    """
    bounded_batches(contents.sparkSession)
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("content", "language", "source")]
    own = contents.select(*columns).mapInArrow(_stripes, _STRIPE)
    # the term comes first, as most stripes have the same few languages
    dealt = own.repartition("term", "language").sortWithinPartitions("term", "language")
    return dealt.mapInArrow(_merged(least_contents), _STRIPE)


@dataclass(frozen=True)
class Language:
    """What all stripes of a language have in common: its sources, their sizes, the number of terms."""

    sources: tuple[str, ...]
    sizes: tuple[int, ...]
    terms: int


def shares(counts: np.ndarray, size: int, terms: int) -> np.ndarray:
    """1 and how many thousand millionths ``count + 1`` is of ``size + terms``, rounded down; without overflow."""
    whole = size + terms
    if whole >= 2**63 // 1000:
        return np.array([1 + PARTS * (int(c) + 1) // whole for c in counts], np.int64)
    rest = counts.astype(np.int64) + 1
    found, rest = rest // whole, rest % whole
    for _ in range(3):
        found = found * 1000 + rest * 1000 // whole
        rest = rest * 1000 % whole
    return found + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    # a square is at most 10^18
    return (p - q) * (p - q) // q


def _counts(batch: pa.RecordBatch, languages: dict[str, Language]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Terms and their counts per source, a language and some thousands of entries at a time."""
    names = np.array(batch.column("language").to_pylist(), object)
    for name in dict.fromkeys(names):
        own = languages[name]
        number = {source: at for at, source in enumerate(own.sources)}
        rows = np.flatnonzero(names == name)
        step = max(1, _ENTRIES // len(own.sources))
        for start in range(0, len(rows), step):
            some = batch.take(pa.array(rows[start : start + step]))
            at = np.array([number[s] for s in some.column("sources").flatten().to_pylist()], np.int64)
            row = np.repeat(np.arange(some.num_rows), some.column("sources").value_lengths().to_numpy())
            table = np.zeros((some.num_rows, len(own.sources)), np.int64)
            table[row, at] = some.column("counts").flatten().to_numpy()
            yield name, some.column("term").to_pylist(), table


def _table_shares(table: np.ndarray, own: Language) -> np.ndarray:
    return np.column_stack([shares(table[:, i], size, own.terms) for i, size in enumerate(own.sizes)])


def _pair_sums(languages: dict[str, Language]):
    """Per ordered pair of a language's sources, the sum of gaps over a task's terms."""

    def rows(name: str, first: int, sums: np.ndarray) -> pa.RecordBatch:
        sources = languages[name].sources
        return pa.RecordBatch.from_pydict(
            {
                "language": [name] * sums.size,
                "source": [s for s in sources[first : first + len(sums)] for _ in sources],
                "item": list(sources) * len(sums),
                "value": sums.ravel().tolist(),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, _, table in _counts(batch, languages):
                own = languages[name]
                p = _table_shares(table, own)
                together = len(own.sources) ** 2 <= _ENTRIES
                if together and name not in held:
                    # tasks hold one language at a time, as their rows are sorted by it
                    for other, sums in held.items():
                        yield rows(other, 0, sums)
                    held = {name: np.zeros((len(own.sources),) * 2, np.int64)}
                for i in range(len(own.sources)):
                    sums = _gap(p[:, i : i + 1], p).sum(axis=0)
                    if together:
                        held[name][i] += sums
                    else:
                        yield rows(name, i, sums[None])
        for name, sums in held.items():
            yield rows(name, 0, sums)

    return run


def _term_gaps(languages: dict[str, Language]):
    """Per source and term that it uses more than its language does, the gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, terms, table in _counts(batch, languages):
                own = languages[name]
                p = _table_shares(table, own)
                q = shares(table.sum(axis=1), sum(own.sizes), own.terms)[:, None]
                row, at = np.nonzero((table > 0) & (p > q))
                if len(row):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "language": [name] * len(row),
                            "source": [own.sources[i] for i in at],
                            "item": [terms[i] for i in row],
                            "value": _gap(p, q)[row, at].tolist(),
                        }
                    )

    return run


def source_divergences(
    contents: DataFrame, least_contents: int = LEAST_CONTENTS, listed: int = LISTED_TERMS
) -> DataFrame:
    """``language, source, part, item, value, rank`` of all sources of ``contents``.

    ``contents`` has ``content``, ``language`` and ``source`` (of a fixture; those
    of the project have no language, and are then one language, '').  A null is
    an empty text in each of them.  Repeated rows count as often as they occur;
    an empty table has no rows; other columns are not looked at.

    A language keeps the terms of at least ``least_contents`` contents.  With N
    the occurrences of kept terms in a source and V their number, a term with c
    occurrences has the share p = 1 + floor(10^9 (c + 1) / (N + V)), whether or
    not the source uses it; a language's shares are those of all its sources
    together.  The gap of two shares is floor((p - q)^2 / q).

    * ``pair``: ``item`` is another source of the language, ``value`` the sum of
      the gaps from its shares over all kept terms, 0 without any;
    * ``term``: ``item`` is a term that the source uses, with a larger share than
      its language, ``value`` the gap between them; ``listed`` terms at most.

    Ranks begin at 1 per source and part, by falling value and then by item in
    the order of UTF-8.  Sources, their sizes and the pairs of a language's
    sources are held by each task: as many as the answer has rows for one term.
    """
    kept = cut(term_stripes(contents, least_contents))
    groups = contents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("language", "source"))).distinct()
    used = kept.select("language", F.explode(F.arrays_zip("sources", "counts")).alias("u"))
    used = used.groupBy("language", F.col("u.sources").alias("source")).agg(F.sum("u.counts").alias("n"))
    terms = {row["language"]: row["n"] for row in kept.groupBy("language").agg(F.count("*").alias("n")).collect()}
    sized = groups.join(used, ["language", "source"], "left").select("language", "source", F.coalesce("n", F.lit(0)).alias("n"))
    found: dict[str, list] = {}
    for language, source, n in sorted(map(tuple, sized.collect())):
        found.setdefault(language, []).append((source, n))
    languages = {
        name: Language(tuple(s for s, _ in own), tuple(n for _, n in own), terms.get(name, 0)) for name, own in found.items()
    }
    by_name = kept.sortWithinPartitions("language")
    schema = "language string, source string, item {}, value bigint"
    sums = by_name.mapInArrow(_pair_sums(languages), schema.format("string"))
    # a pair whose language has no kept term has no sum from any task
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "language").select("language", "source", "item")
    pairs = pairs.where(F.col("source") != F.col("item")).withColumn("value", F.lit(0).cast("bigint"))
    pairs = pairs.unionByName(sums.where(F.col("source") != F.col("item")))
    pairs = pairs.groupBy("language", "source", "item").agg(F.sum("value").alias("value"))
    gaps = by_name.mapInArrow(_term_gaps(languages), schema.format("binary"))
    return _ranked(pairs, "pair").unionByName(_ranked(gaps.withColumn("item", F.col("item").cast("string")), "term", listed))


def _ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("language", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("language", "source", F.lit(part).alias("part"), "item", "value", "rank")
