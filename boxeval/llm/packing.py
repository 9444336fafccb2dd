"""Packing fixture contents into token sequences of one length by sums of squares.

A content's tokens are cut into pieces no longer than a sequence.  Pieces are
dealt into blocks by a hash, and each block places its pieces, longest first:
a piece goes where the sum, over all gaps, of the squared number of open
sequences with that gap becomes smallest, among those with room for it.  What is still open in the blocks is
then placed into each other in the same way, sequence by sequence, so that a
block's last sequences don't stay half empty.

Contents (``id``, ``content``) are those that the project's manifests pin; it
has no token sequences of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxeval.llm.bpe import encode_around_runs
from boxeval.llm.common import bounded_batches, new_name
from boxeval.session import cut

CAPACITY = 1024
#: Pieces that one task places, about.
BLOCK_ROWS = 50_000
_BLOCK_BITS, _ROUND_BITS = 32, 56


@lru_cache(maxsize=2)
def _tokenizer(ranks_path: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


def cut_contents(
    contents: DataFrame, ranks_path: str, pattern: str, specials: dict[str, int], end_id: int, capacity: int = CAPACITY
) -> DataFrame:
    """``id, piece, start, length, token_ids`` for every content of ``contents`` (``id``, ``content``).

    A content's ids are those of its text (``specials`` are found in texts, as
    the vocabulary's own library does), and ``end_id``.  Only contents with more
    than ``capacity`` ids are cut; all pieces but the first are ``capacity``
    long.  ``token_ids`` are little-endian unsigned 32-bit numbers.  A null
    content counts as empty: one piece that holds ``end_id``.  Repeated rows
    give repeated pieces; other columns are not looked at.  A content may be as
    long as a row can be, also if it is one run of blanks or letters.
    """
    bounded_batches(contents.sparkSession)
    kind = contents.schema["id"].dataType.simpleString()
    named = tuple(sorted(specials.items()))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _tokenizer(ranks_path, pattern, named)
        found = tuple(specials)

        def encode(text: str) -> list[int]:
            # a text without its long runs is encoded piece by piece; specials have no blanks
            return encode_around_runs(text, lambda part: library.encode(part, allowed_special="all"), library._encode_single_piece, found)

        for batch in batches:
            at, numbers, starts, lengths, ids = [], [], [], [], []
            for row, text in enumerate(batch["content"].to_pylist()):
                own = np.array([*encode(text or ""), end_id], "<u4")
                start, number = 0, 0
                size = (len(own) - 1) % capacity + 1
                while start < len(own):
                    at.append(row)
                    numbers.append(number)
                    starts.append(start)
                    lengths.append(size)
                    ids.append(own[start : start + size].tobytes())
                    start, number, size = start + size, number + 1, capacity
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["id", "piece", "start", "length", "token_ids"],
            )

    return contents.select("id", "content").mapInArrow(
        pieces, f"id {kind}, piece int, start bigint, length bigint, token_ids binary"
    )


def place(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, taken in the given order.

    A new sequence is opened only if no open one has room: longest first, that
    needs the fewest sequences.  Of equal sums of squares the one with the
    smallest gap is taken, and of sequences with that gap the youngest.
    """
    # open sequences per gap; the entry of gap 0 makes a full sequence count for nothing
    number = np.zeros(capacity + 1)
    number[0] = -0.5
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequences, offsets, made = [], [], 0
    for length in lengths:
        old = number[length:capacity]
        if old.any():
            change = number[: capacity - length] - old  # half of what the sum of squares changes by, less 1
            change[old == 0] = np.inf
            gap = int(change.argmin()) + length
            sequence = waiting[gap].pop()
            number[gap] -= 1
        else:
            gap = capacity
            sequence, made = made, made + 1
        sequences.append(sequence)
        offsets.append(capacity - gap)
        if gap > length:
            waiting[gap - length].append(sequence)
            number[gap - length] += 1
    return sequences, offsets


def _place_blocks(items: DataFrame, length: str, order: list[str], capacity: int, round_: int) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``, placed block by block."""
    rows = items.count()
    blocks = max(1, math.ceil(rows / BLOCK_ROWS))
    # items that are alike in all their columns are dealt one by one, so that no id fills a block; the rows come
    # from a checkpoint, whose partitions stay what they are
    block = new_name("block", items.columns)
    turn = F.when(F.lit(blocks == 1), F.lit(0)).otherwise(F.monotonically_increasing_id())
    dealt = items.withColumn(block, F.pmod(F.xxhash64(*order, turn), F.lit(blocks)))
    keys = [(length, "descending"), *((name, "ascending") for name in order)]

    def place_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(keys)
        number = rows[block][0].as_py()
        sequences, offsets = place(rows[length].to_pylist(), capacity)
        first = (round_ << _ROUND_BITS) + (number << _BLOCK_BITS)
        return (
            rows.drop_columns([block])
            .append_column("sequence_id", pa.array(np.array(sequences, np.int64) + first))
            .append_column("offset", pa.array(np.array(offsets, np.int64)))
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return dealt.groupBy(block).applyInArrow(place_block, f"{schema}, sequence_id bigint, offset bigint")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``id``, ``piece``, ``length`` and any others) with ``sequence_id`` and ``offset``.

    Lengths are from 1 to ``capacity``.  Offsets in a sequence start at 0 and
    leave no gap.  Pieces with equal id and number are pieces of their own,
    null ids are ids like others, an empty table gives an empty one.  Columns
    called ``sequence_id`` and ``offset`` are replaced, others may have any name.
    Which of equally long pieces goes where depends on how the rows are dealt.
    """
    pieces = cut(pieces.drop("sequence_id", "offset"))
    placed = cut(_place_blocks(pieces, "length", ["id", "piece"], capacity, 0))
    open_ = placed.groupBy("sequence_id").agg(F.sum("length").alias("_level")).where(F.col("_level") < capacity)
    open_ = cut(open_.withColumnRenamed("sequence_id", "_old"))
    moved = _place_blocks(open_, "_level", ["_old"], capacity, 1).select(
        "_old", F.col("sequence_id").alias("_new"), F.col("offset").alias("_base")
    )
    joined = placed.join(moved, placed["sequence_id"] == moved["_old"], "left")
    return joined.select(
        *(placed[c] for c in pieces.columns),
        F.coalesce(moved["_new"], placed["sequence_id"]).alias("sequence_id"),
        (placed["offset"] + F.coalesce(moved["_base"], F.lit(0))).alias("offset"),
    )
