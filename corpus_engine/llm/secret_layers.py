"""Operator 9: secrets, found also under nested encodings.

A worklist holds the layers of a text: the text itself, then what its percent-encoded, escaped,
base64 or compressed parts decode to, and so on until nothing new decodes. Each layer is scanned,
and each character of a layer knows the span of the original text it comes from. What is under
compression comes from the whole compressed part, so it is unfolded and scanned by pieces, and only
the kinds of secrets in it are kept.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import html
import html.entities
import io
import lzma
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm.batches import map_texts

#: Kinds in the order that breaks ties.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
NAMES = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\(?:([0-3][0-7]{2})|N\{([A-Za-z0-9 -]{2,90})\})"
)
REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST_RUN = 16
#: A run at the end of a text, read from there.
RUN_BACK = re.compile(r"(?:[A-Za-z0-9+/_-]++|[ \t]*+\n\r?)*+")
READABLE = b"\t\r\n" + bytes(range(0x20, 0x7F))
#: A run over line ends.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++(?:\r?\n)?={0,2}")
#: How base64 of gzip, zlib, bz2, xz and lzma data begins, wherever it lies in a run.
PACKED = re.compile(r"H4sI|eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|Qlpo[MNO]|/Td6WFoA|XQAA")
#: Raw deflate has no mark: data counts as such if it unfolds to at least so many bytes, nearly all of them readable.
LEAST_RAW = 24
#: Readable bytes amid others.
STRETCH = re.compile(
    rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){8,}+"
)
#: Letters of a run over line ends, as a stream meets them.
RUN = re.compile(r"(?:[A-Za-z0-9+/_-]++|\r?\n[ \t]*+|\r)*+")
#: Bytes or characters of unfolded data that are held at once; characters that two pieces share.
PIECE, SHARED = 1 << 19, 1 << 17

MASK = "[SECRET]"

Span = tuple[int, int, str]
#: Starts and ends, in the original, of each character of a layer.
Places = tuple[np.ndarray, np.ndarray]
#: A layer: its text and the places of its characters; None: it is the original.
Layer = tuple[str, Places | None]


def scan(text: str) -> list[Span]:
    """Leftmost matches of each kind that do not overlap; those too short are dropped afterwards."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _readable(data: bytes) -> str | None:
    """Text of bytes that are UTF-8 and mostly printable."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    odd = sum(not (c.isprintable() or c in "\t\r\n") for c in text)
    return text if text and odd * 20 <= len(text) else None


def _mark(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Stream:
    """Bytes that come by pieces, of any number: unfolded while they are compressed, then scanned as text.

    The kinds of secrets below are added to `kinds`. `above` has marks of what this lies in, so data
    that unfolds to itself ends. Members of compressed data are read in a row and one by one.
    """

    def __init__(self, kinds: set[str], above: frozenset[bytes]):
        self.kinds, self.above = kinds, above
        self.held = bytearray()  # until it is known what it is
        self.unpack = self.text = None
        self.below: list[Stream] = []  # the members in a row, the member at hand
        self.first: bytearray | None = None  # the first member, while it is small
        #: Whether all compressed data was unfolded to its end.
        self.sound = False

    def feed(self, data: bytes) -> None:
        while data:
            if self.text:
                self.text.feed_bytes(data)
                return
            if self.unpack:
                data = self._unfold(data)
                continue
            self.held += data
            if len(self.held) < PIECE:
                return
            data = self._decide()

    def _decide(self) -> bytes:
        """Settle what the held bytes begin; gives them back."""
        data = bytes(self.held)
        self.held.clear()
        mark = _mark(data)
        unpack = _unpacker(data) if mark not in self.above else None
        if unpack:
            self.unpack, self.sound = unpack, False
            if self.below:
                self.below = [self.below[0], Stream(self.kinds, self.above | {mark})]
                if self.first is not None:  # it has been read in a row only
                    alone = Stream(self.kinds, self.above | {mark})
                    alone.feed(bytes(self.first))
                    alone.close()
                    self.first = None
            else:
                self.below, self.first = [Stream(self.kinds, self.above | {mark})], bytearray()
        else:
            self.text = Text(self.kinds, self.above)
        return data

    def _unfold(self, data: bytes) -> bytes:
        """Unfold data; gives the bytes behind its end."""
        try:
            for out in self.unpack.pieces(data):
                for stream in self.below:
                    stream.feed(out)
                if self.first is not None and len(self.below) == 1:
                    self.first += out
                    if len(self.first) > PIECE:  # as text it is read by pieces, whatever follows
                        self.first = None
        except BROKEN:
            self.unpack, self.text = None, Text(self.kinds, self.above)
            return data
        if not self.unpack.inner.eof:
            return b""
        rest, self.unpack, self.sound = self.unpack.inner.unused_data, None, True
        for stream in self.below[1:]:
            stream.close()
        self.below = self.below[:1]
        return rest

    def close(self) -> None:
        while self.held:
            data = self._decide()
            while data and self.unpack:
                data = self._unfold(data)
            if data and self.text:
                self.text.feed_bytes(data)
            elif data:
                self.held += data
        for stream in self.below:  # if the data was cut off, what there was is scanned
            stream.close()
        if self.text:
            self.text.close()


class Text:
    """Text that comes by pieces; the kinds of secrets in it and under it are added to `kinds`.

    Bytes are UTF-8, or UTF-16 where a mark or their zero bytes say so; of others the readable stretches are read.
    Pieces share their ends, and what may go on over several pieces has streams of its own: base64 runs, and the
    text under percent signs, escapes or character references.
    """

    def __init__(self, kinds: set[str], above: frozenset[bytes]):
        self.kinds, self.above = kinds, above
        self.started = False
        self.decoder: codecs.IncrementalDecoder | None = None
        self.rest = b""
        self.fresh, self.tail = "", ""
        self.under: dict[str, Text] = {}
        self.runs: list[Base64Stream] = []

    def feed_bytes(self, data: bytes) -> None:
        if not self.started:
            self.started, self.decoder = True, codecs.getincrementaldecoder(_wide(data) or "utf-8")()
        if self.decoder:
            try:
                self.feed(self.decoder.decode(data))
                return
            except UnicodeDecodeError:
                data, self.decoder = self.decoder.getstate()[0] + data, None
        self.feed(self._readable_parts(data))

    def _readable_parts(self, data: bytes) -> str:
        """Of bytes that are no UTF-8, what is readable; its end waits for the next bytes."""
        data = self.rest + data
        loose = len(data) - len(data.rstrip(READABLE))
        at = len(data) - (loose if loose < 16 else 8)
        self.rest = data[at:]
        parts, end = [], 0
        for m in STRETCH.finditer(data[:at]):
            parts += ["\0"] * (m.start() > end) + [m[0].decode()]
            end = m.end()
        return "".join(parts) + "\0" * (end < at)

    def feed(self, text: str) -> None:
        self.fresh += text
        at = 0
        while len(self.fresh) - at >= PIECE:
            piece = self.fresh[at : at + PIECE]
            open_end = max(piece.rfind("%", PIECE - 12), piece.rfind("\\", PIECE - 96), piece.rfind("&", PIECE - 36))  # not within %41
            piece = piece[: open_end if open_end > 0 else PIECE]
            at += len(piece)
            self._scan(piece, False)
        self.fresh = self.fresh[at:]

    def close(self) -> None:
        if self.decoder and self.decoder.getstate()[0]:  # cut off within a character
            self.rest += self.decoder.getstate()[0]
        self._scan(self.fresh + self.rest.decode("utf-8", "replace"), True)
        for text in self.under.values():
            text.close()
        self.fresh, self.rest, self.decoder = "", b"", None

    def _find(self, text: str) -> None:
        if text and (mark := _mark(text.encode("utf-8", "replace"))) not in self.above:
            self.kinds.update(kind for _, _, kind in find(text, self.above | {mark})[1])

    def _scan(self, piece: str, last: bool) -> None:
        if self.runs:
            end = RUN.match(piece).end()
            for run in self.runs:
                run.feed(piece[:end])
            if end < len(piece) or last:
                self._end_runs()
        window = re.sub("\x20{2,}", "\x20", self.tail + piece)  # any number of blanks is as good as one
        self._find(window)
        for mark, parts in REPLACED:
            found = [p for p in parts(piece) if p[2] is not None] if mark in piece else []
            if found and mark not in self.under and not last:
                self.under[mark] = Text(self.kinds, self.above)
                self.under[mark].feed(self.tail)
            if mark in self.under:
                below = _replaced((piece, None), iter(found))
                self.under[mark].feed(below[0] if below else piece)
        if not last and not self.runs:
            start = len(window) - RUN_BACK.match(window[::-1]).end()
            if len(window) - start >= LEAST_RUN:
                letters = re.sub("[ \t\r\n]", "", window[start:])
                heads = {*range(4), *(m.start() for m in PACKED.finditer(letters))}
                self.runs = [Base64Stream(self.kinds, self.above, letters[k:], k > 3) for k in sorted(heads) if k < len(letters)]
        self.tail = window[-SHARED:]

    def _end_runs(self) -> None:
        for run in self.runs:
            run.close()
        self.runs = []


class Base64Stream:
    """A base64 run that comes by pieces. `packed`: it matters only if it is compressed data."""

    def __init__(self, kinds: set[str], above: frozenset[bytes], letters: str, packed: bool):
        self.stream: Stream | None = Stream(kinds, above)
        if packed and not _unpacker(_bytes(letters[:1024]), False):
            self.stream = None
        self.held = ""
        self.feed(letters)

    def feed(self, text: str) -> None:
        if self.stream:
            letters = self.held + re.sub("[ \t\r\n]", "", text)
            whole = len(letters) // 4 * 4
            self.held = letters[whole:]
            self.stream.feed(_bytes(letters[:whole]))

    def close(self) -> None:
        if self.stream:
            self.stream.feed(_bytes(self.held))
            self.stream.close()


BROKEN = (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError)


class Unpacker:
    """Compressed data, unfolded by pieces of PIECE bytes at most."""

    def __init__(self, inner):
        self.inner = inner

    def pieces(self, data: bytes) -> Iterator[bytes]:
        while not self.inner.eof:
            out = self.inner.decompress(data, PIECE)
            if out:
                yield out
            data = getattr(self.inner, "unconsumed_tail", b"")  # the others keep what they have not read
            if not data and len(out) < PIECE and getattr(self.inner, "needs_input", True):
                return


def _readable_share(data: bytes) -> float:
    return sum(len(m[0]) for m in STRETCH.finditer(data)) / max(len(data), 1)


def _unpacker(data: bytes, raw: bool = True) -> Unpacker | None:
    """What unfolds data that begins as compressed data does. raw: deflate without a mark counts too."""
    head = data[:4096]
    if data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        made = lambda: zlib.decompressobj(47)
    elif data[:3] == b"BZh" and data[4:10] == b"1AY&SY":
        made = bz2.BZ2Decompressor
    elif data[:6] == b"\xfd7zXZ\0" or data[:3] == b"]\0\0":
        made = lzma.LZMADecompressor
    elif raw and len(data) >= 8 and _readable_share(head) < 0.8:
        try:
            out = zlib.decompressobj(-15).decompress(head, 4096)
        except zlib.error:
            return None
        known = len(out) >= LEAST_RAW and (_readable_share(out) >= 0.9 or _wide(out) or _unpacker(out, False))
        return Unpacker(zlib.decompressobj(-15)) if known else None
    else:
        return None
    try:
        made().decompress(head, PIECE)
    except BROKEN:
        return None
    return Unpacker(made())


def _wide(data: bytes) -> str | None:
    """The codec of UTF-16, if data is such text by its mark or by where its zero bytes are."""
    head = data[:256]
    if head[:2] in (b"\xff\xfe", b"\xfe\xff") and _readable_share(head[2:]) < 0.5:
        return "utf-16"
    if len(head) >= 16:
        for codec, low, high in (("utf-16-le", head[::2], head[1::2]), ("utf-16-be", head[1::2], head[::2])):
            if high.count(0) >= 0.9 * len(high) and not low.count(0):
                return codec
    return None


def _percent(text: str) -> Iterator[tuple[int, int, str | None]]:
    """Percent runs; bytes of them that are no UTF-8 stay as they are and part the rest."""
    for m in PERCENT.finditer(text):
        data, at = memoryview(bytes.fromhex(m[0].replace("%", ""))), 0
        while at < len(data):
            try:
                bad, after = len(data), len(data)
                new = str(data[at:], "utf-8")
            except UnicodeDecodeError as e:
                bad, after = at + e.start, at + e.end
                new = str(data[at:bad], "utf-8")
            if new:
                yield m.start() + 3 * at, m.start() + 3 * bad, new
            at = after


def _escaped(text: str) -> Iterator[tuple[int, int, str | None]]:
    for m in ESCAPE.finditer(text):
        if m[6]:
            try:
                yield m.start(), m.end(), unicodedata.lookup(m[6])
            except KeyError:
                pass
            continue
        point = int(m[5], 8) if m[5] else int(next(g for g in m.groups() if g), 16)
        yield m.start(), m.end(), chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None


def _referenced(text: str) -> Iterator[tuple[int, int, str | None]]:
    for m in REFERENCE.finditer(text):
        if m[0][1] == "#" or m[0][1:] in html.entities.html5:
            yield m.start(), m.end(), html.unescape(m[0])


#: What stands for other characters within a text: its first character, and what finds it.
REPLACED = (("%", _percent), ("\\", _escaped), ("&", _referenced))


def _origin(layer: Layer, start: int, end: int) -> tuple[int, int]:
    _, places = layer
    return (int(start), int(end)) if places is None else (int(places[0][start]), int(places[1][end - 1]))


def _same(origin: tuple[int, int], size: int) -> Places:
    return np.full(size, origin[0], np.int64), np.full(size, origin[1], np.int64)


def _replaced(layer: Layer, parts: Iterator[tuple[int, int, str | None]]) -> Layer | None:
    """The layer with parts, none longer than its span, put in place of spans; their characters come from the whole span.

    None if there are no parts.
    """
    text, places = layer
    out, at, size = io.StringIO(), 0, 0
    first, last = np.empty(len(text), np.int64), np.empty(len(text), np.int64)

    def keep(upto: int) -> None:
        nonlocal size
        out.write(text[at:upto])
        own = slice(size, size + upto - at)
        first[own], last[own] = (np.arange(at, upto), np.arange(at + 1, upto + 1)) if places is None else (places[0][at:upto], places[1][at:upto])
        size += upto - at

    for start, end, new in parts:
        if not new:
            continue
        if start > at:
            keep(start)
        out.write(new)
        whole = _origin(layer, start, end)
        own, step = slice(size, size + len(new)), (end - start) // len(new)
        if len(new) > 1 and step * len(new) == end - start == whole[1] - whole[0]:  # e.g. %41%42: a place for each
            first[own] = np.arange(whole[0], whole[1], step)
            last[own] = first[own] + step
        else:
            first[own], last[own] = whole
        at, size = end, size + len(new)
    if not at:
        return None
    keep(len(text))
    return out.getvalue(), (first[:size], last[:size])


def decoded(layer: Layer, far: list[Span], above: frozenset[bytes]) -> Iterator[Layer]:
    """The layers one decoding below: percent and escapes within the text, each base64 run by itself.

    Secrets under compression are added to `far`.
    """
    text, _ = layer
    for mark, parts in REPLACED:
        if mark in text and (below := _replaced(layer, parts(text))) is not None:
            yield below
    for m in BASE64.finditer(text):
        yield from _base64(layer, m[0].rstrip("="), range(*m.span()), m.end(), far, above)
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            at = np.fromiter((k for k in range(*m.span()) if text[k] not in " \t\r\n="), np.int64)
            if len(at) >= LEAST_RUN:
                yield from _base64(layer, "".join(c for c in m[0] if c not in " \t\r\n="), at, m.end(), far, above)


def _bytes(run: str) -> bytes:
    """What a run of base64 letters holds; a last letter that is too much is left out."""
    whole = len(run) - (len(run) % 4 == 1)
    return base64.b64decode(run[:whole].replace("-", "+").replace("_", "/") + "=" * (-whole % 4), validate=True)


def _base64(layer: Layer, run: str, at: Sequence[int], end: int, far: list[Span], above: frozenset[bytes]) -> Iterator[Layer]:
    """The layers under a run whose letters are at these places of the layer; `end` is after its padding.

    A run that does not decode as a whole may have a payload behind a path or a prefix, or before
    something else: then compressed data is opened wherever it begins, and what is readable at any
    of the four offsets is taken.
    """

    def spread(start: int, size: int) -> Places:  # one byte a character: three of them in four
        k, where = np.arange(size), np.asarray(at)
        upto = start + ((k + 1) * 4 + 2) // 3
        first, last = where[start + k * 4 // 3], np.where(upto > len(run), end, where[np.minimum(upto, len(run)) - 1] + 1)
        return (first, last) if layer[1] is None else (layer[1][0][first], layer[1][1][last - 1])

    def unfold(data: bytes, start: int) -> bool:
        kinds: set[str] = set()
        stream = Stream(kinds, above)
        stream.feed(data)
        stream.close()
        far.extend((*_origin(layer, at[start], end), kind) for kind in kinds)
        return stream.sound

    data = _bytes(run)
    if _unpacker(data) and unfold(data, 0):
        return
    below = _readable(data)
    if below is not None:
        yield below, spread(0, len(below)) if len(below) == len(data) else _same(_origin(layer, at[0], end), len(below))
        return
    if codec := _wide(data):
        below = data.decode(codec, "replace")
        marked = 2 if codec == "utf-16" else 0
        if 2 * len(below) + marked == len(data):
            first, last = spread(marked, len(data) - marked)
            yield below, (first[::2], last[1::2])
        elif below:
            yield below, _same(_origin(layer, at[0], end), len(below))
        return
    for m in PACKED.finditer(run, 1):
        if _unpacker(_bytes(run[m.start() : m.start() + 1024]), False):
            unfold(_bytes(run[m.start() :]), m.start())
    for offset in range(4):
        for m in STRETCH.finditer(_bytes(run[offset:])):
            below, start = m[0].decode(), m.start()
            head, skip = offset + start // 3 * 4, start % 3
            if len(below) == len(m[0]):
                first, last = spread(head, skip + len(below))
                yield below, (first[skip:], last[skip:])
            else:
                upto = at[min(len(run), head + -(-(skip + len(m[0])) * 4 // 3)) - 1] + 1
                yield below, _same(_origin(layer, at[head], upto), len(below))


def layers(text: str, far: list[Span], above: frozenset[bytes] = frozenset()) -> Iterator[Layer]:
    """The text and all layers below it. A layer's text at the same place is opened once, so cycles end."""
    work: list[Layer] = [(text, None)]
    seen = set()
    while work:
        layer = work.pop()
        own, places = layer
        if places is not None:
            ends = (int(places[0][0]), int(places[1][0]), int(places[0][-1]), int(places[1][-1]))
            mark = (_mark(own.encode("utf-8", "replace")), ends)
            if mark in seen:
                continue
            seen.add(mark)
        yield layer
        work += decoded(layer, far, above)


def _sorted(spans) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(text: str | None, above: frozenset[bytes] = frozenset()) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, in code points of it, end exclusive, by start and kind."""
    far: list[Span] = []
    base: list[Span] = []
    every: list[Span] = []
    for layer in layers(text or "", far, above):
        found = scan(layer[0])
        if layer[1] is None:
            base = found
            every += found
        else:
            every += [(*_origin(layer, start, end), kind) for start, end, kind in found]
    return _sorted(base), _sorted(every + far)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str | None) -> str | None:
    """The text with MASK in place of each span; spans that overlap become one. Null stays null."""
    if text is None:
        return None
    out, at, open_end = [], 0, -1
    for start, end, _ in find(text)[1]:
        if start >= open_end or open_end < 0:
            out += [text[at:start], MASK] if start >= at else []
        at = open_end = max(open_end, end)
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, *keep) -> keep, n_assign, n_access, n_hex (base ones), base_sha256, spans, masked.

    One row per row, texts whole. Null and empty texts: counts 0, the hash of no bytes, no spans.
    """

    def work():
        def do(texts: list[str | None]) -> list[pa.Array]:
            found = [find(t) for t in texts]
            counts = [pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64()) for kind in KINDS]
            return [
                *counts,
                pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([joined(every) for _, every in found], pa.string()),
            ]

        return do

    schema = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_texts(docs, keep, "text", work, schema)


def mask_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs(text, *keep) -> keep, masked: the text with every secret masked; null stays null."""
    return map_texts(
        docs, keep, "text", lambda: lambda texts: [pa.array([masked(t) for t in texts], pa.string())], "masked string"
    )


def op9_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; one row per row, repeated rows and null doc_ids kept, other columns not read.

    Null and empty texts: counts 0, the hash of no bytes, no spans. Spans that are equal count once
    in `spans`. Texts of any length are read whole. No documents: no rows.
    """
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])


QUERIES = {"op9_secret_layers": op9_secret_layers}
ORACLE_SQL: dict[str, str] = {}
