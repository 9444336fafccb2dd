import re
from collections import Counter

import duckdb
import pytest

import boxeval.llm.divergence as D
from boxeval.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
CONTENTS = "content string, language string, source string, term int, item string, rank int"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def contents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONTENTS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=3, listed=200):
    rows = [tuple(v or "" for v in row) for row in rows]
    found = []
    for language in {r[1] for r in rows}:
        own = [(Counter(TERM.findall(lowered(t))), s) for t, lang, s in rows if lang == language]
        df = Counter(term for counts, _ in own for term in counts)
        kept = sorted(t for t, n in df.items() if n >= least)
        used = {}
        for counts, s in own:
            used.setdefault(s, Counter()).update({t: counts[t] for t in kept if t in counts})
        whole = sum(used.values(), Counter())

        def share(counts, term, kept=kept):
            return 1 + 10**9 * (counts[term] + 1) // (sum(counts.values()) + len(kept))

        def gap(a, b, term):
            p, q = share(a, term), share(b, term)
            return (p - q) ** 2 // q

        for s, counts in used.items():
            pairs = [(-sum(gap(counts, used[o], t) for t in kept), o.encode()) for o in used if o != s]
            terms = [(-gap(counts, whole, t), t.encode()) for t in kept if counts[t] and share(counts, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, listed)):
                found += [(language, s, part, i.decode(), -v, n) for n, (v, i) in enumerate(sorted(items)[:most], 1)]
    return sorted(found)


def run(df, *args):
    rows = D.source_divergences(df, *args).select("language", "source", "part", "item", "value", "rank")
    return sorted(map(tuple, rows.collect()))


WORDS = "Board bOARD rook's e4 Größe straße 棋盘 ÉTÉ été a\x00b x_y z-1".split(" ")


def rows(n):
    return [(" ".join(WORDS[(i * j) % len(WORDS)] for j in range(1 + i % 7)), "de" if i % 3 else "en", f"s{i % 4}") for i in range(n)]


def test_equals_brute_force(spark):
    assert run(contents(spark, rows(60))) == brute(rows(60))
    assert run(contents(spark, rows(60)), 1, 2) == brute(rows(60), 1, 2)


def test_nulls_and_empties_are_empty_texts(spark):
    odd = [(None, None, None), ("", "", ""), ("board", None, "s1"), ("Board board", "", "s1"), ("BOARD", None, None), (None, "fr", "s9"), ("x", "fr", None)]
    assert run(contents(spark, odd * 2)) == brute(odd * 2)


def test_languages_without_kept_terms_have_pairs_of_zero(spark):
    few = [("a", "en", "s1"), ("b", "en", "s2"), ("c", "en", "s3")]
    got = run(contents(spark, few))
    assert got == brute(few) and {r[4] for r in got} == {0} and len(got) == 6


def test_empty_table(spark):
    assert run(contents(spark, [])) == []


def test_ties_go_by_utf8(spark):
    tied = [("zebra éclair apple 棋", "en", s) for s in ("a", "b", "b")] + [("other", "en", "c")] * 3
    assert run(contents(spark, tied)) == brute(tied)


def test_hot_source_with_repeated_rows(spark):
    hot = [("the board the rook", "en", "hot")] * 200 + rows(30)
    assert run(contents(spark, hot)) == brute(hot)


def test_small_stripes_and_tables_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "STRIPE_CELLS", 5)
    monkeypatch.setattr(D, "_ENTRIES", 7)
    assert run(contents(spark, rows(60)).repartition(4)) == brute(rows(60))


@pytest.mark.parametrize("run_bytes", [1, 5, 64])
def test_texts_are_taken_apart_at_gaps(monkeypatch, run_bytes):
    monkeypatch.setattr(D, "_RUN", run_bytes)
    for text in ("", " ", "ab", "The board, the  ROOK; größe 棋盘棋盘棋盘 " * 9, "x" * 200, "漢" * 99 + " a"):
        want = Counter(t.encode() for t in TERM.findall(lowered(text)))
        assert D.term_counts(text.encode()) == want


def test_very_long_texts(spark):
    long = [("board " * 1_000_000 + "rook", "en", "s1"), ("漢" * 2_000_000, "en", "s1"), ("rook board", "en", "s2"), ("rook board", "en", "s3")]
    assert run(contents(spark, long)) == brute(long)


def test_shares_do_not_overflow():
    import numpy as np

    for n in (0, 7, 10**6, 10**12, 10**15 - 5):
        for size in (n + 1, 10**15, 10**17):
            want = 1 + 10**9 * (n + 1) // (size + 3)
            assert D.shares(np.array([n]), size, 3).tolist() == [want]


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cursor = con.execute(ORACLES["op13_source_divergence"])
    names = [d[0] for d in cursor.description]
    df = QUERIES["op13_source_divergence"](spark, SF).select(*names)
    assert Counter(map(tuple, df.collect())) == Counter(cursor.fetchall())
