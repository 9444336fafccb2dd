import base64
import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import boxeval.llm.bpe as B
from boxeval.llm.bpe import tokenize_contents, vocabulary

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


PIECES = ["a", "It's", "'re", "'", "s", " ", "  ", "\n", "\t", "42", "é", "ß", "…", "!!", "漢字", "。", "😀", "\x85", "\x1c", "　", "re", "I'll"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 9))
def test_any_leaf_size_gives_the_ids_of_the_whole_text(whole, pieces, leaf):
    text = "".join(pieces)
    words = vocabulary(PATH, P.PATTERN)
    ids = words.encode(text, leaf)
    assert ids == whole(text)
    assert words.decode(ids, leaf) == text.encode()


@pytest.mark.parametrize("text", ["x" * 50_000, "ab " * 30_000, " " * 20_000 + "end", "don't" * 5_000, "\n" * 9_000, "漢" * 5_000])
def test_long_texts(whole, text):
    words = vocabulary(PATH, P.PATTERN)
    assert words.encode(text) == whole(text)


def merged(data, ranks):
    """Ids of one match: all pairs of the lowest rank become one token, left to right, as long as there are pairs."""
    words = dict(map(reversed, ranks.items()))
    ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)[np.frombuffer(data, np.uint8)]
    while len(ids) > 1:
        codes = ids[:-1] << 32 | ids[1:]
        known = {int(c): ranks.get(words[int(c) >> 32] + words[int(c) & 0xFFFFFFFF]) for c in np.unique(codes)}
        known = {c: r for c, r in known.items() if r is not None}
        if not known:
            break
        code = min(known, key=known.get)
        at = np.flatnonzero(codes == code)
        if code >> 32 == code & 0xFFFFFFFF:
            # of pairs that overlap every second one
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            at = np.concatenate([run[::2] for run in runs])
        ids[at] = known[code]
        ids = np.delete(ids, at + 1)
    return ids.tolist()


MATCHES = {
    "blanks": (" " * 2_999_999, " end"), "line ends": ("\n" * 2_999_999, "\nend"), "mixed": (" \t\n\u3000" * 5000 + "\t", " end"),
    "letters": ("x" * 3_000_000, ""), "signs": ("漢" * 1_000_000, ""), "at the end": ("\n" * 1_000_000, ""),
}


@pytest.mark.parametrize("name", MATCHES)
@pytest.mark.parametrize("path", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_very_long_runs_equal_an_own_merge(whole, name, path):
    run, rest = MATCHES[name]
    words = vocabulary(P.path(path), P.PATTERN)
    want = merged(run.encode(), words.ranks) + (words.library.encode_ordinary(rest) if rest else [])
    assert words.encode_part(run + rest) == want
    # a leaf of this size makes halves that end and begin within the run
    ids = words.encode(run + rest, 400_000)
    assert ids == want and words.decode(ids) == (run + rest).encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "          ", "\n" * 7, " \t", "<|end|>"]), max_size=40), st.integers(2, 6))
def test_runs_are_cut_out_where_the_pattern_cuts(whole, pieces, long):
    text = "".join(pieces)
    saved = B.LONG_RUN, B._LONG
    B.LONG_RUN, B._LONG = long, re.compile(f"[{B._BLANKS}]{{{long},}}")
    try:
        words = vocabulary(PATH, P.PATTERN)
        assert words.encode_part(text) == whole(text)
        special = tiktoken.Encoding("s", pat_str=P.PATTERN, mergeable_ranks=words.ranks, special_tokens={"<|end|>": 60_000})
        own = B.encode_around_runs(text, lambda t: special.encode(t, allowed_special="all"), special._encode_single_piece, ("<|end|>",))
        assert own == special.encode(text, allowed_special="all")
    finally:
        B.LONG_RUN, B._LONG = saved


def test_rows_of_a_table(spark, whole):
    texts = [None, "", "Same.", "Same.", "Über den Zaun " * 900]
    df = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "id bigint, content string, token_ids string, decoded int")
    rows = tokenize_contents(df, PATH, P.PATTERN).collect()
    assert sorted((r.id, list(r.token_ids), bytes(r.decoded)) for r in rows) == sorted(
        (i // 2, whole(t or ""), (t or "").encode()) for i, t in enumerate(texts)
    )
    assert tokenize_contents(df.limit(0), PATH, P.PATTERN).collect() == []


def test_query_equals_the_library(spark, whole):
    from boxeval.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_byte_bpe"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = whole(texts[r.doc_id])
        joined = ",".join(map(str, ids)).encode()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(joined).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
