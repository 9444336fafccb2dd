"""Secrets in fixture contents, also below layers of encoding.

Every content starts a worklist.  A layer is scanned for secrets; each part of
it that can be decoded (percent escapes, Unicode escapes and full-width forms,
base64, and compressed bytes inside any of these) makes another layer, until nothing
new comes up.  A layer that was there before at the same place is not taken
again.  Every layer knows where its code points come from, so that all spans
are places in the content itself: exact for escapes, the whole encoded run for
base64.

Decoded layers carry on the rule that evidence and reports hold no secrets.
"""

from __future__ import annotations

import binascii
import bz2
import io
import lzma
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxeval.llm.common import bounded_batches

# The kinds of secrets with their patterns and least lengths, as agreed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ASSIGN_VALUE = 12
# a run that is long enough, from its start to its end, is the same as a run that is then found long enough
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|([！-～])")
_ESCAPED = re.compile(r"\\[uUx]|&#|[！-～]")
_BASE64 = re.compile(r"(?:[A-Za-z0-9+/_-]{60,76}\r?\n)+[A-Za-z0-9+/_-]+={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_FULL_LINE = re.compile(r"^[ \t]*([A-Za-z0-9+/_-]{4,}={0,2})[ \t]*\r?(?:\n|\Z)", re.M)
_LINE_TAIL = re.compile(r"[A-Za-z0-9+/_-]+\r?\Z")
_VARIANT = str.maketrans("-_", "+/", " \t\r\n")
# bytes that are no plain text, written as escapes among characters that stand for themselves
_BINARY_URL = re.compile("%(?:[0189A-Fa-f][0-9A-Fa-f]|7[Ff])")
_URL_RUN = re.compile("(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
_URL_STEP = re.compile("%([0-9A-Fa-f]{2})()()|[!-$&-~]")
_BINARY_BACKSLASH = re.compile(r"\\(?:x|u00)(?:[0189A-Fa-f][0-9A-Fa-f]|7[Ff])")
_BACKSLASH_RUN = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[abfnrtv0'\"\\/]|[ -\[\]-~])+")
_BACKSLASH_STEP = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\(.)|[ -\[\]-~]")
_SHORT = {"a": b"\x07", "b": b"\x08", "t": b"\t", "n": b"\n", "v": b"\x0b", "f": b"\x0c", "r": b"\r", "0": b"\x00"}
_UNPRINTABLE = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
# no secret is shorter than 16 code points, encoded or not, so shorter stretches hold none
_STRETCH = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ud800-\udfff]{16,}")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00|[\x01-\x5e]\xff){16,}")
_MARK = re.compile(rb"\x1f\x8b|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|[\x08\x18\x28\x38\x48\x58\x68\x78]")

#: Code points that are held of inflated bytes; more are looked at in windows that overlap, and reported as not complete.
MOST_DECODED = 64_000_000
#: Inflated bytes of one encoded run from which no further window is made: such bytes can inflate without end.
MOST_INFLATED = 64 * MOST_DECODED
#: Layers of escapes below each other that are always taken; there are more if they have ``MOST_DECODED`` code points together.
LEAST_DEPTH = 64
_PART, _GZIP_BITS = 1 << 16, 31
_ZSTD = b"\x28\xb5\x2f\xfd"
_CONTINUATION = bytes(range(0x80, 0xC0))


class Layer:
    """A text and where its code points come from: stretches of the content, or one run for all.

    ``places`` are stretches of this text by their start, with what they begin
    with in the content; of one that was decoded also the end, as all of it
    comes from the whole run, and -1 of one that was copied.
    """

    __slots__ = ("only", "path", "places", "spent", "text", "whole")

    def __init__(self, text: str, path: tuple[str, ...], places=None, whole=None, only=True) -> None:
        self.text, self.path, self.places, self.whole = text, path, places, whole
        # is it all of what was decoded, or a window of it; and code points of the layers above
        self.only, self.spent = only, 0

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Place in the content of a part of this layer that is not empty."""
        if self.whole:
            return self.whole
        if self.places is None:
            return start, end
        at, low, high = self.places
        first, last = bisect_right(at, start) - 1, bisect_right(at, end - 1) - 1
        begin = low[first] + (start - at[first] if high[first] < 0 else 0)
        return begin, low[last] + end - at[last] if high[last] < 0 else high[last]

    def key(self) -> tuple:
        places = None if self.places is None else hash(tuple(p.tobytes() for p in self.places))
        return hash(self.text), len(self.text), self.whole, places


def base_matches(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, start and end of the secrets that are in plain sight."""
    lowered = text.lower()
    if any(word in lowered for word in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= _ASSIGN_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _replaced(layer: Layer, name: str, pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer with some runs decoded; what a run becomes comes from all of that run."""
    path = (*layer.path, name)
    text, done = [], 0
    at, low, high = places = array("q"), array("q"), array("q")
    size = 0

    def add(place: int, begin: int, end: int) -> None:
        at.append(place)
        low.append(begin)
        high.append(end)

    for start, end, new in [*pieces, (len(layer.text), len(layer.text), "")]:
        text.append(layer.text[done:start])
        if layer.whole is None:
            if start > done and layer.places is None:
                add(size, done, -1)
            elif start > done:
                of, begin, stop = layer.places
                for k in range(bisect_right(of, done) - 1, bisect_left(of, start)):
                    moved = max(done - of[k], 0)
                    add(size + max(of[k] - done, 0), begin[k] + (moved if stop[k] < 0 else 0), stop[k])
            size += start - done
            if new:
                add(size, *layer.span(start, end))
                size += len(new)
        text.append(new)
        done = end
    return Layer("".join(text), path, whole=layer.whole) if layer.whole else Layer("".join(text), path, places)


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.text:
        return
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        raw = bytes.fromhex(m[0].replace("%", ""))
        try:
            decoded = raw.decode()
        except UnicodeDecodeError:
            decoded = raw.decode("latin-1")
        if len(decoded) * 3 == len(m[0]):  # one escape for each code point: places stay exact
            pieces += [(m.start() + 3 * i, m.start() + 3 * i + 3, c) for i, c in enumerate(decoded)]
        else:
            pieces.append((m.start(), m.end(), decoded))
    if pieces:
        yield _replaced(layer, "url", pieces)
    if _BINARY_URL.search(layer.text):
        for run in _URL_RUN.finditer(layer.text):
            if _BINARY_URL.search(run[0]):
                yield from _escaped_bytes(layer, run, _URL_STEP, "url")
                # forms write a blank as a plus
                if "+" in run[0]:
                    yield from _escaped_bytes(layer, run, _URL_STEP, "url", plus=b" ")


def _escaped_bytes(layer: Layer, run: re.Match, step: re.Pattern, name: str, plus: bytes = b"+") -> Iterator[Layer]:
    """Layers of compressed bytes that are written with escapes, where they can't be written plainly."""
    raw, places = bytearray(), array("q")
    for m in step.finditer(run[0]):
        code = m[1] or m[2]
        new = bytes.fromhex(code) if code else _SHORT.get(m[3], m[3].encode()) if m[3] else plus if m[0] == "+" else m[0].encode()
        raw += new
        places.append(m.start())
    raw = bytes(raw)
    for start, text, path, only in _inflated(raw, (*layer.path, name)):
        yield Layer(text, path, whole=layer.span(run.start() + places[start], run.end()), only=only)


def _unicode(layer: Layer) -> Iterator[Layer]:
    if not _ESCAPED.search(layer.text):
        return
    pieces = []
    for m in _UNICODE.finditer(layer.text):
        if m[7]:
            code = ord(m[7]) - 0xFEE0
        else:
            code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        if code <= 0x10FFFF:
            low = pieces[-1] if pieces else None
            if 0xDC00 <= code < 0xE000 and low and low[1] == m.start() and "\ud800" <= low[2] < "\udc00":
                pair = 0x10000 + ((ord(low[2]) - 0xD800) << 10) + (code - 0xDC00)
                pieces[-1] = (low[0], m.end(), chr(pair))
            else:
                pieces.append((m.start(), m.end(), chr(code)))
    if pieces:
        yield _replaced(layer, "unicode", pieces)
    if _BINARY_BACKSLASH.search(layer.text):
        for run in _BACKSLASH_RUN.finditer(layer.text):
            if _BINARY_BACKSLASH.search(run[0]):
                yield from _escaped_bytes(layer, run, _BACKSLASH_STEP, "unicode")


class _Inflating:
    """What zlib or gzip bytes inflate to, a part at a time; gzip members may follow each other, and nothing behind them counts."""

    def __init__(self, source: BinaryIO, bits: int) -> None:
        self.source, self.bits, self.tail, self.stream = source, bits, b"", zlib.decompressobj(bits)

    def read(self, size: int) -> bytes:
        while True:
            if self.stream.eof:
                self.tail = self.stream.unused_data + self.source.read(2)
                if self.bits != _GZIP_BITS or self.tail[:2] != b"\x1f\x8b":
                    return b""
                self.stream = zlib.decompressobj(self.bits)
            data = self.tail or self.source.read(_PART)
            out = self.stream.decompress(data, size)
            self.tail = self.stream.unconsumed_tail
            if out:
                return out
            if not data and not self.stream.eof:
                raise EOFError


class _Frames:
    """What zstd frames inflate to, a part at a time; nothing behind the last frame counts."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.held, self.frame = source, b"", None

    def read(self, size: int) -> bytes:
        import zstandard

        while True:
            data, self.held = self.held or self.source.read(_PART), b""
            if self.frame is None or self.frame.eof:
                data += self.source.read(4) if 0 < len(data) < 4 else b""
                if self.frame is not None and data[:4] != _ZSTD:
                    return b""
                self.frame = zstandard.ZstdDecompressor().decompressobj()
            if not data:
                raise EOFError
            # a few bytes may stand for many: 1,024 of them for 32 MB
            out = self.frame.decompress(data[:1024])
            self.held = self.frame.unused_data + data[1024:]
            if out:
                return out


_OPENED = {
    "gzip": lambda source: _Inflating(source, _GZIP_BITS),
    "bzip2": bz2.BZ2File,
    "xz": lzma.LZMAFile,
    "zstd": _Frames,
    "zlib": lambda source: _Inflating(source, zlib.MAX_WBITS),
}


def _format(head: bytes) -> str | None:
    """The compressed format that bytes start like."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:3] == b"BZh":
        return "bzip2"
    if head[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if head[:4] == _ZSTD:
        return "zstd"
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return "zlib"
    return None


def _parts(raw: bytes, at: int, names: tuple[str, ...]) -> Iterator[bytes]:
    """What ``raw`` from a place on becomes by decompressions one after the other, in parts of bounded size.

    Damaged or truncated bytes give an error, after the parts before the damage.
    """
    source = io.BytesIO(raw)
    source.seek(at)
    for name in names:
        source = _OPENED[name](source)
    while part := source.read(_PART):
        yield part


def _head(raw: bytes, at: int, names: tuple[str, ...]) -> bytes:
    head = b""
    try:
        for part in _parts(raw, at, names):
            head += part
            if len(head) >= _PART:
                break
    except Exception:  # noqa: BLE001  the libraries have errors of their own each
        pass
    return head[:_PART]


def _is_whole(raw: bytes, at: int, names: tuple[str, ...]) -> bool:
    """Do the bytes inflate to a proper end, or at least as far as they are ever looked at?"""
    size = 0
    try:
        for part in _parts(raw, at, names):
            size += len(part)
            if size > MOST_INFLATED:
                break
    except Exception:  # noqa: BLE001
        return False
    return True


def _windows(parts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Inflated bytes in windows of up to ``MOST_DECODED`` code points that overlap, and whether the window is all there is."""
    held, points, size, only = [], 0, 0, True
    try:
        for part in parts:
            new = max(len(part.translate(None, _CONTINUATION)), len(part) // 4)
            if held and points + new > MOST_DECODED:
                only = False
                window = b"".join(held)
                yield window, False
                if size > MOST_INFLATED:
                    return
                held = [window[len(window) - min(len(window), MOST_DECODED // 64) :]]
                points = len(held[0])
            held.append(part)
            points, size = points + new, size + len(part)
    except Exception:  # noqa: BLE001  what came before the damage is looked at
        pass
    if held:
        yield b"".join(held), only and points <= MOST_DECODED


def _unpacked(raw: bytes, at: int, names: tuple[str, ...]) -> Iterator[tuple[bytes, tuple[str, ...], bool]]:
    """Windows of what the bytes become by any number of decompressions, with their formats, and whether each is all there is."""
    head = _head(raw, at, names)
    inner = _format(head)
    if inner and head != _head(raw, at, (*names, inner)) and _is_whole(raw, at, (*names, inner)):
        yield from _unpacked(raw, at, (*names, inner))
    else:
        for window, only in _windows(_parts(raw, at, names)):
            yield window, names, only


def _readings(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """What bytes say as text: all of them, or else each stretch of them that is text, with its place."""
    for coding in ("utf-8", "utf-16-le") if b"\x00" in raw else ("utf-8",):
        try:
            text = raw.decode(coding)
        except UnicodeDecodeError:
            continue
        if text and not _UNPRINTABLE.search(text):
            yield 0, len(raw), text
            return
    text = raw.decode("utf-8", "surrogateescape")
    at = done = 0
    for m in _STRETCH.finditer(text):
        at += len(text[done : m.start()].encode("utf-8", "surrogateescape"))
        size = len(m[0].encode())
        yield at, at + size, m[0]
        at, done = at + size, m.end()
    for m in _WIDE.finditer(raw) if b"\x00" in raw else ():
        yield m.start(), m.end(), m[0].decode("utf-16-le")


def _texts(raw: bytes, path: tuple[str, ...]) -> Iterator[tuple[int, int, str, tuple[str, ...], bool]]:
    """Place, text, path and whether it is all there is, of what bytes say as they are and after any number of compressions.

    Compressed bytes may begin anywhere, as other characters may stand before an
    encoded run without a gap.  zlib's mark is short, and so counts only with a
    proper end.
    """
    for start, end, text in _readings(raw):
        yield start, end, text, path, True
    for start, text, names, only in _inflated(raw, path):
        yield start, len(raw), text, names, only


def _inflated(raw: bytes, path: tuple[str, ...]) -> Iterator[tuple[int, str, tuple[str, ...], bool]]:
    """Start, text, path and whether it is all there is, of each compressed part of some bytes."""
    for m in _MARK.finditer(raw):
        name = _format(raw[m.start() : m.start() + 8])
        if not name or (name == "zlib" and not _is_whole(raw, m.start(), (name,))):
            continue
        for some, names, only in _unpacked(raw, m.start(), (name,)):
            for _, _, text in _readings(some):
                yield m.start(), text, (*path, *names), only
            if not only:
                yield m.start(), "", (*path, *names), False


def _wrapped(text: str) -> Iterator[tuple[int, int]]:
    """Places of lines of one length that hold nothing but base64 characters, one after the other.

    A run at the end of the line before belongs to them, and so does a shorter
    line behind them.  Blanks around the lines are none of it.
    """
    block: list[re.Match] = []
    for line in (*_FULL_LINE.finditer(text), None):
        if block and (line is None or text[block[-1].end() : line.start()] or len(line[1]) > len(block[0][1]) or len(block[-1][1]) < len(block[0][1])):
            # the other pattern finds lines of the usual lengths
            usual = block[0].start() == block[0].start(1) and 60 <= len(block[0][1]) <= 76
            if len(block) > 1 and not usual:
                before = _LINE_TAIL.search(text, max(0, block[0].start() - 256), max(0, block[0].start() - 1))
                yield before.start() if before else block[0].start(1), block[-1].end(1)
            block = []
        if line is not None:
            block.append(line)


def _encoded_runs(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in _BASE64.finditer(text))
    if "\n" in text:
        yield from _wrapped(text)


def _base64(layer: Layer) -> Iterator[Layer]:
    for begin, stop in _encoded_runs(layer.text):
        run = layer.text[begin:stop]
        body = run.rstrip("=").translate(_VARIANT)
        broken = len(body) < len(run.rstrip("="))
        chars = array("q", (i for i, c in enumerate(run) if c not in " \t\r\n=")) if broken else range(len(body))
        # what stands before the encoded characters in one run moves their groups of four
        for shift in range(4):
            some = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
            raw = binascii.a2b_base64(some + "=" * (-len(some) % 4))
            for start, end, text, path, only in _texts(raw, (*layer.path, "base64")):
                first = begin + chars[shift + start * 4 // 3]
                last = stop if end == len(raw) else begin + chars[shift - (-end * 4 // 3) - 1] + 1
                yield Layer(text, path, whole=layer.span(first, last), only=only)


def _layers(layer: Layer) -> Iterator[Layer]:
    for decode in (_base64, _unicode, _percent):
        yield from decode(layer)


def read_layers(text: str) -> tuple[list[dict], list[tuple[int, int]]]:
    """Spans by start, kind and end, with the layer each was found in, and the places whose layers were not all looked at as a whole."""
    found: dict[tuple[int, int, int], str] = {}
    unread: set[tuple[int, int]] = set()
    # layers of a layer are made one after the other, so that only one window of each is held
    work = [iter([Layer(text, ())])]
    seen = set()
    deepest = max(MOST_DECODED, LEAST_DEPTH * len(text))
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.only:
            unread.add(layer.whole)
        key = layer.key()
        if key in seen:
            continue
        seen.add(key)
        for kind, start, end in base_matches(layer.text):
            place = (layer.span(start, end)[0], KINDS.index(kind), layer.span(start, end)[1])
            path = ">".join(layer.path)
            found[place] = min(found.get(place, path), path)
        layer.spent += len(layer.text)
        if layer.spent > deepest:
            unread.update(layer.span(m.start(), m.end()) for runs in (_PERCENT, _UNICODE, _BASE64) for m in runs.finditer(layer.text))
        else:
            work.append(_below(layer))
    rows = [{"kind": KINDS[k], "start": a, "end": b, "layer": path} for (a, k, b), path in sorted(found.items())]
    return rows, sorted(unread)


def _below(layer: Layer) -> Iterator[Layer]:
    for more in _layers(layer):
        # what is inflated counts anew: a large text in plain sight takes nothing from it
        more.spent = layer.spent if more.path[-1] in ("url", "unicode", "base64") else 0
        yield more


def find_secrets(text: str) -> tuple[list[dict], bool]:
    """Spans by start, kind and end, with the layer each was found in; were all layers looked at as a whole?"""
    rows, unread = read_layers(text)
    return rows, not unread


def secrets(content: Column) -> Column:
    """``struct<spans, unread, complete>`` of each content; a null content counts as empty.

    ``unread`` has a span of kind 'unread' for each place that was not read as a
    whole: the content is ``complete`` if there is none.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())])
    kind = pa.struct([("spans", pa.list_(span)), ("unread", pa.list_(span)), ("complete", pa.bool_())])

    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            results = [read_layers(text or "") for text in batch.to_pylist()]
            yield pa.array([{"spans": spans, "unread": _unread_spans(unread), "complete": not unread} for spans, unread in results], kind)

    scanned.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    spans = "array<struct<kind:string,start:int,end:int,layer:string>>"
    return F.arrow_udf(scanned, f"spans {spans}, unread {spans}, complete boolean")(content)


def _unread_spans(unread: list[tuple[int, int]]) -> list[dict]:
    return [{"kind": "unread", "start": start, "end": end, "layer": ""} for start, end in unread]


def scan_secrets(contents: DataFrame) -> DataFrame:
    """``id, spans, complete`` for every row of ``contents`` (``id``, ``content``), without a shuffle.

    ``spans`` has kind, start and end (code points of the content, end
    exclusive) and the layer in which it was found, '' for plain sight; equal
    spans from several layers are one.  ``complete`` is false where a layer has
    grown beyond ``MOST_DECODED`` and was looked at in windows.  Repeated rows give repeated results, an empty
    table an empty one; other columns are not looked at.
    """
    bounded_batches(contents.sparkSession)
    return contents.select("id", secrets(F.col("content")).alias("s")).select("id", "s.spans", "s.complete")


def masked(content: Column, spans: Column) -> Column:
    """The content with each span, or several that overlap, replaced by its kind in brackets."""

    def mask(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([_mask(t, s) for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    mask.__annotations__ = {"texts": pa.Array, "found": pa.Array, "return": pa.Array}
    return F.arrow_udf(mask, "string")(content, spans)


def _mask(text: str | None, spans: list[dict] | None) -> str | None:
    if not text or not spans:
        return text
    pieces, at = [], 0
    for span in sorted(spans, key=lambda s: s["start"]):
        if span["start"] >= at:
            pieces += [text[at : span["start"]], f"[{span['kind']}]"]
        at = max(at, span["end"])
    return "".join([*pieces, text[at:]])
