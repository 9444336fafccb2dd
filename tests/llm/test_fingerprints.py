import hashlib

import numpy as np
import pytest

import boxeval.llm.fingerprints as L
from boxeval.llm.fingerprints import fingerprint_neighbours
from boxeval.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Id and edited text of each row, in order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    found = []
    for i, (fixture, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        found.append((fixture, text, text[: len(text) - half] + after[:half], after))
    return found


def lz_phrases(text):
    phrases, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in phrases:
            phrases.add(phrase)
            phrase = ""
    return phrases


def expected(rows):
    return sorted(
        (
            f is not None, f or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), L._hex(L.fingerprint(text)),
            L._hex(L.fingerprint(edited)), L.likeness(L.fingerprint(text), L.fingerprint(edited)),
            L.likeness(L.fingerprint(text), L.fingerprint(after)),
        )
        for f, text, edited, after in brute(rows)
    )


def found(df):
    return sorted(
        (r[0] is not None, r[0] or 0, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
        for r in df.collect()
    )


def test_phrases_are_those_of_the_dictionary():
    for text in ("", "a", "abababababab", "mississippi river", "é😀é😀é😀"):
        assert len(L.Phrases().read(text).hashes) - 1 == len(lz_phrases(text))
        assert (L.Phrases().read(text[:4]).fork().read(text[4:]).minima() == L.fingerprint(text)).all()


def test_likeness_follows_the_overlap_of_phrases():
    rng = np.random.default_rng(5)
    a = "".join(rng.choice(list("abcdefghij "), 20_000))
    b = a[:10_000] + "".join(rng.choice(list("abcdefghij "), 10_000))
    pa, pb = lz_phrases(a), lz_phrases(b)
    assert L.likeness(L.fingerprint(a), L.fingerprint(b)) == pytest.approx(len(pa & pb) / len(pa | pb), abs=0.15)
    assert L.likeness(L.fingerprint(a), L.fingerprint(a)) == 1
    assert L.likeness(L.fingerprint(""), L.fingerprint("")) == 1
    assert L.likeness(L.fingerprint(""), L.fingerprint(a)) == 0


@pytest.mark.parametrize("part_rows", [1, 3, 4000])
def test_neighbours_across_parts(spark, monkeypatch, part_rows):
    monkeypatch.setattr(L, "PART_ROWS", part_rows)
    rows = [(i * 7 % 31, f"text {i} " * (i % 5)) for i in range(20)]
    rows += [(3, "again"), (3, "again"), (3, None), (None, "no id"), (None, "other"), (-5, "x" * 70_000), (2**62, "é")]
    df = spark.createDataFrame([(*r, "p", True) for r in rows], "id bigint, content string, part string, copy boolean")
    assert found(L.fingerprint_neighbours(df)) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only one here")], [(None, "a b c d")], [(1, "same"), (1, "same")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, content string")
    assert found(L.fingerprint_neighbours(df)) == expected(rows)


def test_query(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_ROWS", 40)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(QUERIES["op4_lz_fingerprints"](spark, SF)) == expected(rows)


def test_text_ids(spark):
    texts = ["The board has eight files and eight ranks.", "", None, "x" * 300, "The board has eight files.", "same", "same"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "nobody", "x", 1), (3, "again", "x", 1)]
    extra = "content string, number string, rows int"
    numbers = fingerprint_neighbours(spark.createDataFrame(rows, f"id bigint, {extra}")).collect()
    named = [(None if i is None else f"page-{i}", *rest) for i, *rest in rows]
    found = fingerprint_neighbours(spark.createDataFrame(named, f"id string, {extra}")).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == sorted(("None" if r[0] is None else f"page-{r[0]}", *r[1:]) for r in numbers)
    assert fingerprint_neighbours(spark.createDataFrame([], f"id string, {extra}")).collect() == []
