import base64
import bz2
import gzip
import hashlib
import json
import lzma
import re
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import boxeval.llm.secrets as S
from boxeval.llm.queries import QUERIES
from boxeval.llm.secrets import Layer, _mask, _unread_spans, find_secrets, masked, read_layers, scan_secrets

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain(text):
    """The base spans, by the patterns as agreed and a filter on what they match."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def spans(text):
    return [(s["kind"], text[s["start"] : s["end"]], s["layer"]) for s in find_secrets(text)[0]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PASSWD", "api_key", "token", "secret", ":", "=", " ", '"', "'", "abc", "AKIA", "AKIAAKIA", "0123456789", "ABCDEFGHIJ", "deadbeef", ".", "é", "\n"]), max_size=30).map("".join))
def test_base_spans(text):
    base = [f"{s['kind']}:{s['start']}:{s['end']}" for s in find_secrets(text)[0] if s["layer"] == ""]
    assert base == plain(text)


def test_layers_are_unwrapped_and_mapped():
    secret = "password=hunter2hunter2"
    assert spans("x " + secret.replace("=", "%3D") + " y") == [("assign", "password%3Dhunter2hunter2", "url")]
    assert spans("a " + secret.replace("=", "\\u003d")) == [("assign", "password\\u003dhunter2hunter2", "unicode")]
    assert spans("a ｐassword=hunter2hunter2")[0][:2] == ("assign", "ｐassword=hunter2hunter2")
    coded = base64.b64encode(secret.encode()).decode()
    assert ("assign", coded, "base64") in spans(f"see {coded} there")
    twice = base64.b64encode(coded.encode()).decode()
    assert ("assign", twice, "base64>base64") in spans(f"see {twice} there")
    packed = base64.b64encode(gzip.compress(secret.encode(), mtime=0)).decode()
    assert ("assign", packed, "base64>gzip") in spans(f"({packed})")
    deep = base64.b64encode(zlib.compress(zlib.compress(secret.replace("=", "%3D").encode()))).decode()
    assert ("assign", deep, "base64>zlib>zlib>url") in spans(f"({deep})")
    percent = "".join(f"%{b:02X}" for b in coded.encode())
    assert ("assign", percent, "url>base64") in spans(f"see {percent} there")


def test_base_spans_stay_and_worklists_end():
    text = "token: abcdefghijklmn %3D and %253D%2525 \\u005cu003d"
    found, complete = find_secrets(text)
    assert complete
    assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in found if s["layer"] == ""] == plain(text)
    assert find_secrets("%" * 5000 + "25" * 5000)[1]


def test_a_bomb_is_reported_as_not_complete(monkeypatch):
    monkeypatch.setattr("boxeval.llm.secrets.MOST_DECODED", 1000)
    bomb = base64.b64encode(gzip.compress(b"a " * 5000, mtime=0)).decode()
    assert find_secrets(f"token=abcdefghijkl {bomb}") == ([{"kind": "assign", "start": 0, "end": 18, "layer": ""}], False)


def test_a_bomb_takes_nothing_from_other_layers(monkeypatch):
    monkeypatch.setattr("boxeval.llm.secrets.MOST_DECODED", 20_000)
    inside = b"a " * 20_000 + b"password=hunter2hunter2 " + b"a " * 20_000
    bomb = base64.b64encode(gzip.compress(inside, mtime=0)).decode()
    coded = base64.b64encode(b"token=abcdefghijkl").decode()
    rows, complete = find_secrets(f"{bomb} {coded} api_key%3Dabcdefghijkl")
    places = [(r["layer"], r["start"], r["end"]) for r in rows]
    at = len(bomb) + 1
    assert places == [("base64>gzip", 0, len(bomb)), ("base64", at, at + len(coded)), ("url", at + len(coded) + 1, at + len(coded) + 23)]
    assert not complete


def test_layers_of_a_large_text_are_all_taken(monkeypatch):
    monkeypatch.setattr("boxeval.llm.secrets.MOST_DECODED", 1000)
    text = "word " * 100 + "%41 \\u0041 " * 20 + "token%253Dabcdefghijkl " + base64.b64encode(b"token=abcdefghijkl").decode()
    rows, complete = find_secrets(text)
    assert complete and sorted(text[r["start"] : r["end"]][:8] for r in rows) == ["dG9rZW49", "token%25"]


def test_runs_that_were_not_read_are_masked(monkeypatch):
    bomb = base64.b64encode(gzip.compress(b"a " * 5000, mtime=0)).decode()
    monkeypatch.setattr("boxeval.llm.secrets.MOST_DECODED", 1000)
    rows, unread = read_layers(f"x {bomb} y")
    assert (rows, unread) == ([], [(2, 2 + len(bomb))])
    assert _mask(f"x {bomb} y", _unread_spans(unread)) == "x [unread] y"


def test_encoded_runs_are_found_behind_and_before_other_characters():
    secret = b"password=abcdefghijklmnop"
    for coded in (base64.b64encode(secret).decode(), base64.b64encode(secret).decode().rstrip("="), base64.urlsafe_b64encode(gzip.compress(secret * 9)).decode()):
        for before in ("", "/", "x/", "https://h.io/cb/", "data_", "a-b_c/", "key"):
            for behind in ("", "\n", "/next", "-x"):
                text = f"see {before}{coded}{behind} end"
                at = text.index(coded)
                assert any(s["start"] <= at and at + len(coded) - 2 <= s["end"] <= len(text) - 4 for s in find_secrets(text)[0]), text
    line = base64.b64encode(b"the user's password=abcdefghijklmnop is for all of it").decode().rstrip("=")
    assert 60 <= len(line) <= 76
    for more in ("The end", "and more", "In this", "x"):
        (row,) = find_secrets(f"{line}\n{more} of it")[0]
        assert (row["start"], row["layer"]) == (0, "base64") and row["end"] >= len(line) - 2
    lines = base64.encodebytes(b"some words " * 30 + secret + b" more " * 9).decode()
    assert {r["layer"] for r in find_secrets("ab/" + lines)[0]} == {"base64"}


SECRET = b"some text and password=hunter2hunter2 behind it, " * 3


def urlquoted(raw, plus=False):
    from urllib.parse import quote_from_bytes

    quoted = quote_from_bytes(raw, safe="")
    return quoted.replace("%20", "+") if plus else quoted


@pytest.mark.parametrize("compress", [lambda b: gzip.compress(b, mtime=0), zlib.compress, bz2.compress, lzma.compress, lambda b: zstandard.ZstdCompressor().compress(b)])
@pytest.mark.parametrize(
    "written",
    [urlquoted, lambda raw: urlquoted(raw, True), lambda raw: "".join(f"%{b:02x}" for b in raw), lambda raw: "".join(f"\\x{b:02x}" for b in raw), lambda raw: repr(raw)[2:-1], lambda raw: json.dumps(raw.decode("latin-1"))[1:-1]],
)
def test_compressed_bytes_below_escapes(compress, written):
    run = written(compress(SECRET))
    for before, behind in (("see ", " there"), ("q=", "&r=1 x"), ("", "")):
        text = before + run + behind
        rows, complete = find_secrets(text)
        inside = [r for r in rows if ">" in r["layer"]]
        assert complete and inside, text
        for r in inside:
            assert text.startswith(run, r["start"]) or r["start"] < len(before) + 4
            assert len(before) + len(run) <= r["end"]
        assert "hunter2" not in _mask(text, rows) and run not in _mask(text, rows)


@pytest.mark.parametrize("width", [8, 20, 33, 59, 64, 76, 77, 120])
@pytest.mark.parametrize("indent, end", [("", "\n"), ("  ", "\n"), ("", "\r\n")])
def test_base64_wrapped_at_any_width(width, indent, end):
    coded = base64.b64encode(b"x" * 30 + SECRET).decode()
    lines = end.join(indent + coded[i : i + width] for i in range(0, len(coded), width))
    text = f"data:\n{lines}\nthe end"
    rows = [r for r in find_secrets(text)[0] if r["layer"] == "base64"]
    assert rows and all(text.index(lines) <= r["start"] < r["end"] <= text.index(lines) + len(lines) for r in rows)
    assert any(base64.b64decode(re.sub(r"\s", "", text[r["start"] : r["end"]]) + "===", validate=False) for r in rows)


def test_places_of_escapes_are_exact():
    text = "é" * 50 + "%41%42 \\u0041 " + "tok%65n%3D" + "abc%2564" * 4 + " end \\u0074oken=abcdefghijkl%20x"
    found = {text[s["start"] : s["end"]] for s in find_secrets(text)[0]}
    assert {"tok%65n%3D" + "abc%2564" * 4, "\\u0074oken=abcdefghijkl"} <= found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "%41", "%C3%A9", "\\u0041", "\\u00e9", "%25", "%5Cu0041", "é", " ", "%FF%FE", "\\x41"]), max_size=25), st.data())
def test_stretches_are_the_places_of_each_code_point(parts, data):
    text = "".join(parts)
    # by lists with an entry per code point
    layer = Layer(text, ())
    where = [(i, i + 1) for i in range(len(text))]
    for name in ("url", "unicode", "url"):
        made = [m for m in (S._percent if name == "url" else S._unicode)(layer) if m.whole is None]
        if not made:
            continue
        pieces = []
        saved, S._replaced = S._replaced, lambda layer, name, p: pieces.extend(p) or saved(layer, name, p)
        try:
            list((S._percent if name == "url" else S._unicode)(layer))
        finally:
            S._replaced = saved
        new, at = [], 0
        for start, end, decoded in pieces:
            new += where[at:start] + [(where[start][0], where[end - 1][1])] * len(decoded)
            at = end
        where, layer = new + where[at:], made[0]
        assert len(where) == len(layer.text)
        if where:
            a = data.draw(st.integers(0, len(where) - 1))
            b = data.draw(st.integers(a + 1, len(where)))
            assert layer.span(a, b) == (where[a][0], where[b - 1][1])


def test_a_very_long_text_needs_little_memory():
    code = """if True:
        import resource, sys
        from boxeval.llm.secrets import find_secrets
        text = "some words " * 4_500_000 + "%41 token%3Dabcdefghijkl"
        rows, complete = find_secrets(text)
        assert complete and rows == [{"kind": "assign", "start": len(text) - 20, "end": len(text), "layer": "url"}], rows
        print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
    """
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[2], timeout=300)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout) < 1_000_000  # kilobytes


def test_rows_of_a_table(spark):
    texts = [None, "", "token=abcdefghijkl", "token=abcdefghijkl", "word " * 50_000 + "token=abcdefghijkl"]
    df = spark.createDataFrame([(i, t, "s", True) for i, t in enumerate(texts)], "id bigint, content string, spans string, complete boolean")
    rows = {r.id: r for r in scan_secrets(df).collect()}
    assert [len(rows[i].spans) for i in range(5)] == [0, 0, 1, 1, 1]
    assert rows[4].spans[0].start == 250_000
    assert scan_secrets(df.limit(0)).collect() == []
    found = scan_secrets(df).withColumnRenamed("id", "_id")
    clean = df.select("id", "content").join(found, F.col("id") == F.col("_id")).select("id", masked(F.col("content"), F.col("spans")))
    assert {r[0]: r[1] for r in clean.collect()} == {0: None, 1: "", 2: "[assign]", 3: "[assign]", 4: "word " * 50_000 + "[assign]"}


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        assert set(base) <= set(filter(None, r.spans.split(",")))
