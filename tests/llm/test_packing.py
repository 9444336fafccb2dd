import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import boxeval.llm.packing as K
from boxeval.llm.queries import END_ID, QUERIES, SPECIALS

SF = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def check_places(rows, capacity):
    """(sequence, offset, length) leave no gap and no sequence is too long."""
    sequences = defaultdict(list)
    for sequence, offset, length in rows:
        sequences[sequence].append((offset, length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def slow_place(lengths, capacity):
    """By the words of the rule: try every open sequence with room and add up all squares."""
    levels, sequences = [], []

    def squares(levels):
        count = defaultdict(int)
        for level in levels:
            if level < capacity:
                count[capacity - level] += 1
        return sum(n * n for n in count.values())

    for length in lengths:
        tries = []
        for i, level in enumerate(levels):
            if level + length <= capacity:
                tries.append((squares([*levels[:i], level + length, *levels[i + 1 :]]), capacity - level, i))
        if tries:
            _, gap, _ = min(tries)
            i = max(i for _, g, i in tries if g == gap)
        else:
            i = len(levels)
            levels.append(0)
        levels[i] += length
        sequences.append(capacity - levels[i])
    return len(levels), sequences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25), st.integers(12, 15))
def test_sums_of_squares(lengths, capacity):
    lengths.sort(reverse=True)
    sequences, offsets = K.place(lengths, capacity)
    made, gaps = slow_place(lengths, capacity)
    assert [capacity - o - n for o, n in zip(offsets, lengths, strict=True)] == gaps
    assert check_places(zip(sequences, offsets, lengths, strict=True), capacity) == made


def test_few_sequences():
    lengths = sorted(np.random.default_rng(1).integers(20, 1024, 5000).tolist(), reverse=True)
    sequences, _ = K.place(lengths, 1024)
    assert max(sequences) + 1 <= 1.01 * sum(lengths) / 1024 + 1


def test_pieces_equal_the_library(spark, library):
    texts = [None, "", "a<|endoftext|>b", "word " * 5000, "ab" * 40_000, "é😀", "same", "same"]
    df = spark.createDataFrame([(min(i, 6), t, 1, 2) for i, t in enumerate(texts)], "id bigint, content string, piece int, length int")
    rows = K.cut_contents(df, PATH, P.PATTERN, SPECIALS, END_ID, 64).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.id].append(r)
    for i, text in enumerate(texts[:6]):
        ids, own = library(text or ""), sorted(by_id[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert np.frombuffer(b"".join(r.token_ids for r in own), "<u4").tolist() == ids
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert all(r.length == 64 for r in own[1:])
    assert len(by_id[6]) == 2


@pytest.mark.parametrize("text", [" " * 3_000_000 + "end", "\n" * 1_000_000 + "end", " " * 1_000_000 + "<|endoftext|>" + "\n" * 20_000, "x" * 3_000_000, "漢" * 1_000_000])
def test_very_long_runs_equal_the_library(spark, library, text):
    df = spark.createDataFrame([(1, text)], "id bigint, content string")
    rows = sorted(K.cut_contents(df, PATH, P.PATTERN, SPECIALS, END_ID, 1 << 22).collect(), key=lambda r: r.piece)
    assert np.frombuffer(b"".join(r.token_ids for r in rows), "<u4").tolist() == library(text)


def test_rows_without_an_id_are_dealt_into_blocks(spark):
    df = spark.range(120_000).select(F.lit(None).cast("string").alias("id"), F.lit(0).alias("piece"), F.lit(700).cast("bigint").alias("length"))
    packed = K.pack_pieces(df.withColumns({"_block": F.lit("b"), "block": F.lit("c"), "_new": F.lit(1), "_old": F.lit(2), "_base": F.lit(3), "_level": F.lit(4)}))
    assert packed.where("_block = 'b' and block = 'c' and _new = 1 and _old = 2 and _base = 3 and _level = 4").count() == 120_000
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    # each block opens its own sequences: the numbers of the first round have the block's number in them
    placed = K._place_blocks(K.cut(df), "length", ["id", "piece"], 1024, 0)
    sizes = [r["count"] for r in placed.groupBy(F.shiftright("sequence_id", K._BLOCK_BITS)).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 45_000


@pytest.mark.parametrize("block_rows", [7, 50_000])
def test_blocks_are_packed_together(spark, monkeypatch, block_rows):
    monkeypatch.setattr(K, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(2)
    rows = [(i // 2, 0, int(n), "s", 5, -1) for i, n in enumerate(rng.integers(1, 101, 60))] + [(None, None, 100, None, None, None)] * 2
    df = spark.createDataFrame(rows, "id bigint, piece int, length bigint, source string, sequence_id int, offset int")
    packed = K.pack_pieces(df, 100).collect()
    assert sorted((r.id is None, r.id, r.length, r.source) for r in packed) == sorted((r[0] is None, r[0], r[2], r[3]) for r in rows)
    made = check_places([(r.sequence_id, r.offset, r.length) for r in packed], 100)
    bound = -(-sum(r[2] for r in rows) // 100)
    assert made <= bound + (2 if block_rows > 60 else 8)
    assert K.pack_pieces(df.limit(0), 100).collect() == []


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_packing"](spark, SF).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = library(text), 0
        for r in sorted(by_id[doc], key=lambda r: r.piece):
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    made = check_places([(r.sequence_id, r.offset, r.length) for r in rows], 1024)
    assert made <= 1.03 * sum(r.length for r in rows) / 1024 + 1
