from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

import boxeval.llm.jaccard as J
from boxeval.llm.components import components
from boxeval.llm.jaccard import near_duplicates
from boxeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, threshold=0.8):
    """``(id, class, links)`` of rows with different ids, by all pairs that share a gram or have none."""
    sets = {i: grams(t) for i, t in rows}
    holders = defaultdict(list)
    for i, own in sets.items():
        for g in own or {"none"}:
            holders[g].append(i)
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        common = defaultdict(int)
        for g in own or {"none"}:
            for j in holders[g]:
                if j > i:
                    common[j] += 1
        for j, n in common.items():
            if not own or n >= threshold * (len(own) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted((i, find(i), links[i]) for i in sets)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, content string, bands string, n int")


def found(df):
    return sorted(map(tuple, J.near_duplicates(df).collect()), key=str)


@pytest.mark.parametrize("block_rows", [3, 256])
def test_groups_of_copies_chains_and_blocks(spark, monkeypatch, block_rows):
    monkeypatch.setattr(J, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(8)

    def text(n):
        return [f"w{x}" for x in rng.integers(0, 400, n)]

    base, rows = text(120), []
    for _ in range(25):  # many near copies of one text
        own = list(base)
        own[rng.integers(0, 120)] = "other"
        rows.append(own)
    for n in (6, 12, 25, 60, 200):  # pairs below and above the threshold
        own = text(n)
        for cut in range(0, n // 2, max(1, n // 10)):
            rows.append([*own[cut:], *text(cut)])
    chain = text(100)
    rows += [chain[i:] + [f"c{x}" for x in range(i)] for i in range(0, 30, 3)]
    rows += [text(40) for _ in range(20)]
    texts = [" ".join(r) for r in rows]
    texts += [texts[0], texts[0].upper(), "  ".join(rows[-1]), "one two", "one two", "One  Two", "one", "", None, " \n", "z " * 30_000, "z " * 20_000]
    rows = list(zip(rng.permutation(len(texts)).tolist(), texts, strict=True))
    assert found(frame(spark, rows)) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, "a b c"), (None, None)])) == [(None, None, 0)] * 2
    assert found(frame(spark, [(4, ""), (2, None)])) == [(2, 2, 1), (4, 2, 1)]
    repeated = found(frame(spark, [(3, "same words here"), (3, "same words here"), (1, "other")]))
    assert repeated == [(1, 1, 0), (3, 3, 1), (3, 3, 1)]
    assert {r[1] for r in found(frame(spark, [(5, "a b c d e f"), (5, "g h i j k l"), (6, "g h i j k l")]))} == {5}


def test_posterior_keeps_pairs_at_the_threshold():
    fewest = J.least_matches()
    assert list(fewest) == list(range(J.STEP, J.VALUES + 1, J.STEP))
    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, (4000, J.VALUES), np.uint8)
    other = values.copy()
    other[2000:] = rng.integers(0, 256, (2000, J.VALUES), np.uint8)
    change = rng.random((2000, J.VALUES)) < 0.2
    other[:2000][change] += 1
    both = np.concatenate([values, other])
    i = np.arange(4000)
    kept, _ = J.surviving_pairs(i, i + 4000, both, np.full(8000, 50), fewest, 0.8)
    assert (kept < 2000).sum() >= 1990
    assert (kept >= 2000).sum() == 0


def test_common_grams_in_small_tables(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in (1, 5, 40, 40, 100)]
    monkeypatch.setattr(J, "CELLS", 20)
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    common = J.common_grams(sets)
    assert all(common[i, j] == expected[i][j] for i in range(5) for j in range(5) if i != j)


def test_shingle_hashes_are_those_of_the_words():
    text = "the cat sat on the mat and the cat sat on the mat and left"
    assert len(J.shingles(J.words_of(text))) == len(grams(text))
    assert (J.shingles(b"x y the cat sat on the z")[:, None] == J.shingles(b"the cat sat on the")).sum() == 1
    long = "ab " * 40_000
    assert len(J.shingles(J.words_of(long))) == 1


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(100, 140)] + rng.integers(0, 60, (40, 2)).tolist() + [[5, 5], [None, 3], [7, 200], [200, 7]]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(int(a) if a is not None else None, int(b)) for a, b in edges], "a bigint, b bigint")
    rows = {r.node: r.root for r in components(df).collect()}
    assert rows == {i: find(i) for i in root if find(i) != i}
    assert components(df.limit(0)).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    result = QUERIES["op9_ngram_jaccard"](spark, SF).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in result) == brute(rows)


def test_repeated_rows_bring_one_text_to_a_pair_of_blocks(spark, monkeypatch):
    by_pair, sizes = J._by_pair, {}

    def counting(rows, key, work, schema):
        sizes[key] = rows.count()
        return by_pair(rows, key, work, schema)

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 500 + [(2, text + " more"), (1, "another text of the same id")]
    monkeypatch.setattr(J, "_by_pair", counting)
    assert set(found(frame(spark, rows))) == {(1, 1, 500), (1, 1, 0), (2, 1, 500)}
    assert sizes["root"] == 3  # the two classes of id 1 and that of id 2


def test_loss_at_the_threshold_is_what_readme_says():
    # chance that a pair of similarity 0.8 is dropped at one of the looks
    equal, values, lost = 0.8 + 0.2 / 256, np.ones(1), 0.0
    for least in J.least_matches().values():
        for _ in range(J.STEP):
            values = np.convolve(values, [1 - equal, equal])
        lost += values[:least].sum()
        values[:least] = 0
    assert round(lost, 5) == 4.7e-4
    assert "4.7e-4" in (Path(__file__).parents[2] / "README.md").read_text()


def test_text_ids_and_common_texts(spark):
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    texts = [base] * 40 + [" ".join([*words[:-1], f"other{i}"]) for i in range(5)] + ["", None, "something else entirely here now", "something else entirely here now"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base)]
    numbers = near_duplicates(spark.createDataFrame(rows, "id bigint, content string")).collect()
    named = spark.createDataFrame([(None if i is None else f"page-{i}", t, "x", 1, 2) for i, t in rows], "id string, content string, name string, node int, copies int")
    found = near_duplicates(named).collect()

    def classes(rows, number):
        groups = defaultdict(set)
        for r in rows:
            if r.id is not None:
                groups[r.class_id].add((number(r.id), r.n_links))
        for name, members in groups.items():
            assert number(name) in {m for m, _ in members}
        return sorted(map(sorted, groups.values()))

    assert classes(found, lambda i: int(i[5:])) == classes(numbers, int)
    assert [(r.class_id, r.n_links) for r in found if r.id is None] == [(None, 0)]
    assert near_duplicates(named.limit(0)).collect() == []
