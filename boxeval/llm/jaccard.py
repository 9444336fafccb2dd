"""Fixture contents that share most of their word 5-grams, with candidates pruned as in BayesLSH.

Contents of equal words are one class, and only classes are compared.  MinHash
values in bands deal classes into buckets.  Pairs of a bucket are compared a
few values at a time, and a pair is dropped as soon as the posterior chance
that its similarity reaches the threshold falls below a tolerance.  What is
left hangs together in small groups.  Within each group pairs are compared in
the same way, and those that stay are verified on their whole sets of 5-grams.

Buckets and groups are cut into blocks and each pair of blocks is one piece of
work, whose result is a few numbers per class: a group of thousands of near
copies never becomes rows for all of its pairs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from boxeval.llm.common import bounded_batches, join_facts
from boxeval.llm.components import components
from boxeval.session import cut

WORDS = 5
THRESHOLD = 0.8
#: Chance of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-4
#: At the threshold all bands of a pair differ with a chance of (1 - 0.8^5)^28, one in 60,000.
BANDS, BAND_VALUES = 28, 5
VALUES = BANDS * BAND_VALUES
#: MinHash values that are compared before pairs are dropped again.
STEP = 20
#: Classes in a block of a bucket or group, about.
BLOCK_ROWS = 256
#: Cells of a table of classes by 5-grams that are held at a time.
CELLS = 8_000_000

_ROUNDS = np.random.default_rng(20)
_FACTORS = _ROUNDS.integers(0, 1 << 32, VALUES, np.uint32) | np.uint32(1)
_SHIFTS = _ROUNDS.integers(0, 1 << 32, VALUES, np.uint32)
_BAND_FACTORS = _ROUNDS.integers(0, 1 << 63, BAND_VALUES, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as far as a text has needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            steps = np.full((2, size), 1, np.uint64)
            steps[0, 1:], steps[1, 1:] = _BASE, _INVERSE
            self.up, self.down = np.multiply.accumulate(steps, axis=1)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str) -> bytes:
    """The words in lower case with one blank between them."""
    return " ".join(text.lower().split()).encode("utf-8", "surrogatepass")


def shingles(words: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the different 5-grams of words; of fewer words, of all of them together."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.frombuffer(words, np.uint8)
    up, down = _powers.get(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    blanks = np.flatnonzero(codes == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(codes)]])
    if len(starts) > WORDS:
        starts, ends = starts[: 1 - WORDS], ends[WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(_mixed((sums[ends] - sums[starts]) * down[starts]))


def min_values(grams: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that is not empty."""
    h = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(h), 512):
        some = h[start : start + 512, None]
        np.minimum(least, ((some ^ _SHIFTS) * _FACTORS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, BAND_VALUES).astype(np.uint64) + np.uint64(1)
    return _mixed((rows * _BAND_FACTORS).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).astype(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Per number of compared values, the fewest equal ones with which a pair stays.

    The prior is even.  One byte of a value is compared, so that different
    values are equal once in 256 times.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    chance = grid + (1 - grid) / 256
    fewest = {}
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(chance) + (n - m) * np.log1p(-chance)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                fewest[n] = m
                break
    return fewest


def surviving_pairs(
    i: np.ndarray, j: np.ndarray, values: np.ndarray, sizes: np.ndarray, fewest: dict[int, int], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that are not dropped on the way through all MinHash values."""
    stays = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
    i, j = i[stays], j[stays]
    equal = np.zeros(len(i), np.int64)
    for n, least in fewest.items():
        if not len(i):
            break
        part = slice(n - STEP, n)
        equal = equal + (values[i, part] == values[j, part]).sum(axis=1)
        stays = equal >= least
        i, j, equal = i[stays], j[stays], equal[stays]
    return i, j


def _pairs(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a block (no ``first`` of two), or all between the first and the second of two, some at a time."""
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    for start in range(0, len(a), 64):
        own = a[start : start + 64]
        if len(b):
            i, j = np.repeat(own, len(b)), np.tile(b, len(own))
        else:
            i, j = np.repeat(own, len(a)), np.tile(a, len(own))
            later = j > i
            i, j = i[later], j[later]
        yield i, j


def _roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each of ``n`` rows hangs together with."""
    root = ids.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            break
        root = new
    return root


def common_grams(sets: list[np.ndarray]) -> np.ndarray:
    """Number of 5-grams that each two of the sets have in common."""
    m = len(sets)
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times > 1  # what only one set has is in common with none
    place = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m))
    width = max(1, CELLS // m)
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        table = np.zeros((m, width), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        common += table @ table.T
    return common


def _key(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _keyed(contents: DataFrame) -> DataFrame:
    """``node, words_key, content`` of each content with an id."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(words_of(text or "")) for text in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(keys, pa.binary()), batch["content"]], names=["node", "words_key", "content"])

    rows = contents.where(F.col("id").isNotNull()).select(_number(contents).alias("node"), "content")
    return rows.mapInArrow(key, "node bigint, words_key binary, content string")


def _is_numbered(contents: DataFrame) -> bool:
    return isinstance(contents.schema["id"].dataType, IntegralType)


def _number(contents: DataFrame) -> Column:
    """Ids as numbers: themselves, or a hash of 64 bits."""
    return F.col("id").cast("bigint") if _is_numbered(contents) else F.xxhash64("id")


def _signed(contents: DataFrame) -> DataFrame:
    """``name, id, words_key, n, least, bands`` of each content with an id: what it is compared by; ``name`` is the id as given."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, least, bands = [], [], [], []
            for text in batch["content"].to_pylist():
                words = words_of(text or "")
                grams = shingles(words)
                keys.append(_key(words))
                sizes.append(len(grams))
                values = min_values(grams) if len(grams) else None
                least.append(b"" if values is None else (values & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append([] if values is None else band_keys(values).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch["name"], batch["id"], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(least, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["name", "id", "words_key", "n", "least", "bands"],
            )

    name = F.col("id").cast("bigint") if _is_numbered(contents) else F.col("id")
    rows = contents.where(F.col("id").isNotNull()).select(name.alias("name"), _number(contents).alias("id"), "content")
    kind = rows.schema["name"].dataType.simpleString()
    return rows.mapInArrow(sign, f"name {kind}, id bigint, words_key binary, n bigint, least binary, bands array<bigint>")


def block_pairs(members: DataFrame, key: str, node: str, sizes: DataFrame) -> DataFrame:
    """``members`` for each pair of blocks of their key: ``_low`` and ``_high`` block, and whether a row is of the low one.

    ``sizes`` has the ``key`` and its ``_size``.  A block has about
    ``BLOCK_ROWS`` rows; a key that fits into one has one pair, of the block
    with itself.
    """
    blocks = F.ceil(F.col("_size") / BLOCK_ROWS)
    rows = members.join(sizes, key).withColumn("_own", F.pmod(F.xxhash64(node), blocks))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    return rows.select(
        *members.columns,
        F.least("_own", "_other").alias("_low"),
        F.greatest("_own", "_other").alias("_high"),
        (F.col("_own") <= F.col("_other")).alias("_first"),
    )


def _by_pair(rows: DataFrame, key: str, work: Callable, schema: str) -> DataFrame:
    """Call ``work`` with the columns of each pair of blocks, one after the other in a task."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        for _, run in itertools.groupby(each(), key=lambda r: (r[key], r["_low"], r["_high"])):
            found = work(list(run))
            if found is not None and found.num_rows:
                yield found

    # few bytes can be much work: tasks are not to be merged by size
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, key, "_low", "_high").sortWithinPartitions(key, "_low", "_high")
    return dealt.mapInArrow(runs, schema)


def _compared(rows: list[dict], fewest: dict[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are left after their MinHash values have been compared."""
    values = np.frombuffer(b"".join(r["least"] for r in rows), np.uint8).reshape(len(rows), VALUES)
    sizes = np.array([r["n"] for r in rows])
    first = np.array([r["_first"] for r in rows])
    kept = [surviving_pairs(i, j, values, sizes, fewest, threshold) for i, j in _pairs(first)]
    return np.concatenate([i for i, _ in kept] or [np.zeros(0, int)]), np.concatenate([j for _, j in kept] or [np.zeros(0, int)])


def near_duplicates(contents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``id, class_id, n_links`` for every row of ``contents`` (``id``, ``content``).

    Two contents are linked if the Jaccard similarity of their sets of word
    5-grams is at least ``threshold``; words are in lower case and parted by
    white space, and fewer than five make one gram.  Contents of equal words,
    also of none, are linked.  ``n_links`` is the number of other rows that a
    row is linked to, and ``class_id`` the smallest id of all that hang
    together by links; if ids are not integers, that with the smallest hash, and
    two of n ids are taken for one with a chance of n^2 / 2^65.  Null contents count as empty.  Rows without an id take
    no part: no class, no links.  Rows with one id are one document: what any
    of them is linked to, its class is linked to.
    """
    bounded_batches(contents.sparkSession)
    fewest = least_matches(threshold, tolerance)
    signed = cut(_signed(contents))
    classes = signed.groupBy("words_key").agg(
        F.min("id").alias("node"), F.min_by("name", "id").alias("named"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("bands").alias("bands")
    )
    classes = cut(classes)

    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("_size")).where(F.col("_size") > 1)
    members = banded.join(shared, "band").select("band", "node", "_size")
    sketches = classes.where(F.col("n") > 0).select("node", "n", "least")
    buckets = block_pairs(members.join(sketches, "node").drop("_size"), "band", "node", shared)

    def hang(rows: list[dict]) -> pa.RecordBatch | None:
        i, j = _compared(rows, fewest, threshold)
        if not len(i):
            return None
        nodes = np.array([r["node"] for r in rows])
        root = _roots(len(rows), i, j, nodes)
        apart = root != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(root[apart])], names=["a", "b"])

    groups = components(_by_pair(buckets, "band", hang, "a bigint, b bigint"))
    roots = groups.select("root").distinct()
    grouped = cut(groups.unionByName(roots.select(F.col("root").alias("node"), "root")))

    # repeated rows bring one text, and each class of an id with several texts its own
    texts = _keyed(contents).groupBy("node", "words_key").agg(F.first("content").alias("content"))
    compared = grouped.join(classes.select("node", "copies", "n", "least", "words_key"), "node").join(texts, ["node", "words_key"])
    sizes = grouped.groupBy("root").agg(F.count("*").alias("_size"))

    def verify(rows: list[dict]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        sets = [shingles(words_of(r["content"] or "")) for r in rows]
        i, j = _compared(rows, fewest, threshold)
        if not len(i):
            return None
        n = np.array([len(s) for s in sets])
        common = common_grams(sets)[i, j]
        linked = common >= threshold * (n[i] + n[j] - common) - 1e-9
        i, j = i[linked], j[linked]
        nodes, copies = np.array([r["node"] for r in rows]), np.array([r["copies"] for r in rows])
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        root = _roots(len(rows), i, j, nodes)
        some = links > 0
        keys = pa.array([r["words_key"] for r, s in zip(rows, some, strict=True) if s], pa.binary())
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(nodes[some]), pa.array(root[some]), pa.array(links[some].astype(np.int64))], names=["words_key", "a", "b", "links"]
        )

    pairs = block_pairs(compared, "root", "node", sizes)
    found = cut(_by_pair(pairs, "root", verify, "words_key binary, a bigint, b bigint, links bigint"))
    final = components(found.select("a", "b"))
    links = found.groupBy("words_key").agg(F.sum("links").alias("links"))
    known = classes.select("words_key", "node", "named", "copies").join(links, "words_key", "left").join(final, "node", "left")
    known = known.select(
        "words_key",
        "named",
        "copies",
        F.coalesce("root", "node").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    if not _is_numbered(contents):
        known = cut(known)
        sizes = known.groupBy("class_id").agg(F.count("*").alias("_size"))
        roots = classes.select(F.col("node").alias("class_id"), F.col("named").alias("_root")).join(sizes, "class_id")
        # an id with several texts names several classes
        roots = roots.groupBy("class_id").agg(F.min("_root").alias("_root"), F.max("_size").alias("_size"))
        known = join_facts(known, roots, "class_id", "_size").drop("class_id").withColumnRenamed("_root", "class_id")
    known = cut(known.select("words_key", "class_id", "n_links", "copies"))
    found = join_facts(signed.select(F.col("name").alias("id"), "words_key"), known, "words_key", "copies")
    kind = signed.schema["name"].dataType
    rest = contents.where(F.col("id").isNull()).select(
        F.lit(None).cast(kind).alias("id"), F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("bigint").alias("n_links")
    )
    return found.select("id", "class_id", "n_links").unionByName(rest)
