"""Byte-level BPE over fixture contents as a tree reduction.

A content is halved until its parts are short.  Parts are encoded on their own
and neighbours are joined: only the text around the seam is encoded again, from
the last place left of it to the first place right of it at which every parse
of the surrounding text must begin a new match of the pattern.  Tokens outside
that window can't change, so the joined ids are those of the whole content.
Decoding concatenates the bytes of halves.

The project's own records hold no token ids; contents are those that its
manifests pin (``id``, ``content``).
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.llm.common import bounded_batches

LEAF_CHARS = 1024
FIRST_WINDOW = 32

# A match of the pattern never goes on from a visible character to a blank, nor from one of these old letters or
# digits to punctuation, and what follows then starts a match of its own.
_SEAM = re.compile(
    "\\S(?=[ \\t\\n\\r])"
    "|[A-Za-z0-9ぁ-ゖァ-ヺ一-龥가-힣](?=[!-/:-@\\[-`{-~、。，])"
)
# fixed values: what the pattern takes for blanks
_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of this many blanks are kept from the library's regular expressions, which fail on a million.
LONG_RUN = 10_000
_LONG = re.compile(f"[{_BLANKS}]{{{LONG_RUN},}}")


def encode_around_runs(
    text: str, encode: Callable[[str], list[int]], encode_match: Callable[[bytes], list[int]], specials: tuple[str, ...] = ()
) -> list[int]:
    """``encode(text)``, with each long run of blanks cut out and given to ``encode_match`` as one match.

    The pattern takes all blanks of a run but the last one for a match, as long
    as something visible follows; the last one begins what comes next.  At the
    end of the text, or where one of the ``specials`` follows, it takes them all.
    """
    if len(text) < LONG_RUN:
        return encode(text)
    ids, at = [], 0
    for run in _LONG.finditer(text):
        start, end = run.span()
        stop = end if end == len(text) or text.startswith(specials, end) else end - 1
        ids += encode(text[at:start])
        ids += encode_match(text[start:stop].encode())
        at = stop
    return ids + encode(text[at:])


class Vocabulary:
    """Ranks of a byte-level vocabulary and the pattern that cuts texts into matches."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("fixtures", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}

    def encode_part(self, text: str) -> list[int]:
        """Ids of a text in one go."""
        return encode_around_runs(text, self.library.encode_ordinary, self.library._encode_single_piece)

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> list[int]:
        """Ids of ``text``, the same as if it were encoded in one piece."""
        return self._encode(text, 0, len(text), max(leaf, 1))

    def _encode(self, text: str, start: int, end: int, leaf: int) -> list[int]:
        if end - start <= leaf:
            return self.encode_part(text[start:end])
        middle = (start + end) // 2
        left = self._encode(text, start, middle, leaf)
        right = self._encode(text, middle, end, leaf)
        return self.join(left, right, text[start:middle], text[middle:end])

    def join(self, left: list[int], right: list[int], left_text: str, right_text: str) -> list[int]:
        """Ids of two neighbouring texts together, from the ids that each has on its own."""
        begin, stop = last_seam(left_text), first_seam(right_text)
        tail, head = left_text[begin:], right_text[:stop]
        keep = len(left)
        size = len(tail.encode())
        while size > 0:
            keep -= 1
            size -= self.sizes[left[keep]]
        skip = 0
        rest = len(head.encode())
        while rest > 0:
            rest -= self.sizes[right[skip]]
            skip += 1
        if size or rest:
            raise ValueError("the pattern has a match across a place that should part matches")
        return left[:keep] + self.encode_part(tail + head) + right[skip:]

    def decode(self, ids: list[int], leaf: int = LEAF_CHARS) -> bytes:
        """Bytes of the ids: those of the first half, then those of the second."""
        if len(ids) <= max(leaf, 1):
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


def last_seam(text: str) -> int:
    """The last sure start of a match in ``text``; its own start if there is none."""
    width = FIRST_WINDOW
    while True:
        begin = max(0, len(text) - width)
        found = 0
        for seam in _SEAM.finditer(text, begin):
            found = seam.end()
        if found or not begin:
            return found
        width *= 4


def first_seam(text: str) -> int:
    """The first sure start of a match behind the start of ``text``; its end if there is none."""
    seam = _SEAM.search(text)
    return seam.end() if seam else len(text)


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str, pattern: str) -> Vocabulary:
    """Read once per Python worker."""
    return Vocabulary(ranks_path, pattern)


def encode(content: Column, ranks_path: str, pattern: str) -> Column:
    """Token ids of each content as array<int>; a null content has the ids of an empty one, none."""

    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(ranks_path, pattern)
        for batch in batches:
            yield pa.array([words.encode(text or "") for text in batch.to_pylist()], pa.list_(pa.int32()))

    ids_of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(ids_of, "array<int>")(content)


def decode(token_ids: Column, ranks_path: str, pattern: str) -> Column:
    """Bytes of each array of token ids; null ids give null."""

    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = vocabulary(ranks_path, pattern)
        for batch in batches:
            yield pa.array([None if ids is None else words.decode(ids) for ids in batch.to_pylist()], pa.binary())

    bytes_of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(bytes_of, "binary")(token_ids)


def tokenize_contents(contents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``id, token_ids, decoded`` for every row of ``contents`` (``id``, ``content``).

    Nothing is shuffled.  Repeated rows give repeated results, an empty table an
    empty one, null and empty contents no ids and no bytes; other columns are
    not looked at.  A content may be as long as a row can be, and so may a run of
    blanks, letters or anything else in it; a run without a seam is merged in n
    log n steps, once for each halving.  ``ranks_path`` is a file that every
    worker can open.
    """
    bounded_batches(contents.sparkSession)
    encoded = contents.select("id", encode(F.col("content"), ranks_path, pattern).alias("token_ids"))
    return encoded.withColumn("decoded", decode(F.col("token_ids"), ranks_path, pattern))
