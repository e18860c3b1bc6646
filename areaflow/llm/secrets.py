"""Secret scans through nested encodings.

Every text is scanned for three kinds of secret. Then a worklist unwraps what is encoded in it: percent escapes
(``%uXXXX`` too), Unicode, hex or entity escapes, base64 runs, also over single line ends, and compressed bytes inside any of these.
Each decoded layer is scanned and searched for further layers until nothing is left to unwrap; a layer seen
before at the same place ends its branch, so texts that decode to themselves end too. Positions are carried
along: a secret in any layer is reported at the characters of the original text that produced it.

Some characters are part of no secret and of no encoding, so a text falls into stretches that they divide. All
escapes of one kind in a stretch are decoded at once, beside what is plain in it. Base64 counts as a layer where
its bytes are readable text, in UTF-8 or UTF-16, or compressed. A run that is neither as a whole, such as base64 behind a path or
other letters, is decoded from each of its first four letters, and readable parts of at least ``LEAST_PART`` bytes are layers; so are
compressed bytes that begin inside it. Compressed are gzip, zlib, bz2 and xz; written with escapes, gzip and zlib only.

Compressed bytes are unfolded in pieces, through all members and to their end, whatever the length; every piece ends
with a stretch, so only a single stretch is held whole. Bytes compressed twice are spilled to a file of the task.

Defined cases: a null text is empty and has no secrets. Equal rows get equal results each. An empty table gives
an empty result. Other columns are not read. Damaged or incomplete compressed bytes are scanned as far as they
unfold and counted in ``cut_layers``.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import html
import io
import lzma
import re
import tempfile
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

from pyspark.sql import DataFrame

from areaflow.llm.common import keyed, map_arrow

# The three kinds, in the order that breaks ties, and their shortest lengths.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Bytes unfolded at once, and bytes of a nested compressed layer that are kept in memory.
PIECE_BYTES = 1 << 20
SPILL_BYTES = 16 << 20
#: Readable bytes inside a base64 run that are worth a layer: no secret is shorter.
LEAST_PART = 12
#: Bytes that an xz stream may ask for; one that wants more is reported as broken.
XZ_MEMORY = 128 << 20

_STRETCH = re.compile(r"""[A-Za-z0-9+/_.=\-"'\x20:%\\{}&#;\r\n]+""")
_TO_LAST_DIVIDER = re.compile(r"""(?s:.*)[^A-Za-z0-9+/_.=\-"'\x20:%\\{}&#;\r\n]""")
_PERCENT_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+|%[uU]([0-9A-Fa-f]{4})")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})"
                     r"|(&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&[A-Za-z][A-Za-z0-9]{1,30};)")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]+)?={0,2}")

# Compressed bytes among escapes: how they start, and single bytes of them.
_PACKED_PERCENT = re.compile(r"%1[fF]%8[bB]|(?:x|%78)(?:%01|%5[eE]|%9[cC]|%[dD][aA]|\^)")
_PERCENT_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|[^%\s\"'<>]")
_PACKED_ESCAPE = re.compile(r"(?:\\x|\\u00)1[fF](?:\\x|\\u00)8[bB]|(?:x|\\x78|\\u0078)(?:(?:\\x|\\u00)(?:01|5[eE]|9[cC]|[dD][aA])|\^)"
                            r"|&#(?:31|[xX]1[fF]);&#(?:139|[xX]8[bB]);|(?:x|&#120;|&#[xX]78;)&#(?:1|94|156|218|[xX](?:0?1|5[eE]|9[cC]|[dD][aA]));")
_ESCAPE_BYTE = re.compile(_ESCAPE.pattern + r"|\\([abtnvfr0'\"\\/])|[^\\Ā-\U0010ffff]")
_PART = re.compile(rb"[\t\r\n\x20-\x7e]{%d,}" % LEAST_PART)
_PACKED_LETTERS = re.compile(r"H4sI|e[AFJN]|QlpoO|QlpoM|QlpoN|/Td6|_Td6")  # first letters of compressed bytes
_SHORT = dict(zip("abtnvfr0'\"\\/", b"\a\b\t\n\v\f\r\0'\"\\/", strict=True))

Span = tuple[str, int, int]


def matches(text: str) -> list[Span]:
    """Secrets of one layer as it stands, leftmost and non-overlapping in each kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    at = 0
    while first := _LONG_HEX.search(text, at):
        whole = _HEX.match(text, first.start())  # the run's start: what precedes it in the run would have matched
        out.append(("hex", *whole.span()))
        at = whole.end()
    return out


class Layer:
    """A decoded text in pieces, each with the span of the original text it came from, character by character or as a whole."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.pieces = text, pieces or [(0, 0, len(text), True)]
        self.at = [p[0] for p in self.pieces]

    def span(self, lo: int, hi: int) -> tuple[int, int]:
        at, start, _, same = self.pieces[bisect_right(self.at, lo) - 1]
        first = start + lo - at if same else start
        at, start, end, same = self.pieces[bisect_right(self.at, hi - 1) - 1]
        return first, start + hi - at if same else end

    def part(self, pieces: list[tuple[str | None, int, int]]) -> Layer:
        """A layer of pieces, each the span of this layer that it stands for and its new text, None if unchanged."""
        text, out, size = [], [], 0
        for new, lo, hi in pieces:
            if new is None:
                k = bisect_right(self.at, lo) - 1
                while lo < hi:
                    end = min(hi, self.at[k + 1] if k + 1 < len(self.at) else hi)
                    out.append((size, *self.span(lo, end), self.pieces[k][3]))
                    text.append(self.text[lo:end])
                    size, lo, k = size + end - lo, end, k + 1
            elif new:
                out.append((size, *self.span(lo, hi), False))
                text.append(new)
                size += len(new)
        return Layer("".join(text), out)


def _substituted(layer: Layer, lo: int, hi: int, escape: re.Pattern, value) -> Layer | None:
    """A stretch with all escapes of one kind replaced."""
    pieces, at = [], lo
    for m in escape.finditer(layer.text, lo, hi):
        new = value(m)
        if new is not None:
            pieces += [(None, at, m.start()), (new, *m.span())]
            at = m.end()
    return layer.part([*pieces, (None, at, hi)]) if pieces else None


def _character(code: str) -> str | None:
    point = int(code, 16)
    return chr(point) if point < 0x110000 and not 0xD800 <= point < 0xE000 else None


def _percent(m: re.Match) -> str | None:
    if m[1]:
        return _character(m[1])
    return bytes.fromhex(m[0].replace("%", "")).decode(errors="replace")


def _escape(m: re.Match) -> str | None:
    if m[5]:
        new = html.unescape(m[5])
        return new if new != m[5] else None
    return _character(m[1] or m[2] or m[3] or m[4])


_BZ2, _XZ = b"BZh", b"\xfd7zXZ\0"
_DAMAGED = (zlib.error, lzma.LZMAError, OSError)


def _packed(raw: bytes) -> bool:
    """Whether bytes start as gzip, zlib, bz2 or xz do."""
    return (raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 1 and (raw[0] * 256 + raw[1]) % 31 == 0
            or raw[:3] == _BZ2 and raw[4:10] == b"1AY&SY" or raw[:6] == _XZ)


class _Blocks:
    """A bz2 or xz stream unfolded in pieces, with the names that zlib has for what is left."""

    def __init__(self, stream: bz2.BZ2Decompressor | lzma.LZMADecompressor):
        self.stream, self.unconsumed_tail = stream, b""

    def decompress(self, raw: bytes, size: int) -> bytes:
        """``_KEPT`` instead of bytes asks for more of what the stream keeps itself."""
        out = self.stream.decompress(b"" if raw is _KEPT else raw, size)
        self.unconsumed_tail = b"" if self.stream.eof or self.stream.needs_input else _KEPT
        return out

    @property
    def eof(self) -> bool:
        return self.stream.eof

    @property
    def unused_data(self) -> bytes:
        return self.stream.unused_data


_KEPT = b"kept"


def _unfolding(raw: bytes):
    """What unfolds bytes that start like these."""
    if raw[:3] == _BZ2:
        return _Blocks(bz2.BZ2Decompressor())
    if raw[:6] == _XZ:
        return _Blocks(lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=XZ_MEMORY))
    return zlib.decompressobj(47)


def _starts(raw: bytes) -> bool:
    """Whether the first bytes unfold without an error; a block may need more of them than these."""
    try:
        _unfolding(raw).decompress(raw, PIECE_BYTES)
    except _DAMAGED:
        return False
    return True


def _extent(raw: bytes) -> int:
    """How many bytes the compressed members at the start of ``raw`` take, all if the last is not complete."""
    rest = raw
    while _packed(rest):
        d = _unfolding(rest)
        try:
            d.decompress(rest, PIECE_BYTES)
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, PIECE_BYTES)
        except _DAMAGED:
            return len(raw)
        if not d.eof:
            return len(raw)
        rest = d.unused_data
    return len(raw) - len(rest)


class Packed:
    """Compressed bytes and the part of a layer that they stand for."""

    def __init__(self, raw: bytes, layer: Layer, lo: int, hi: int):
        self.raw, self.where, self.broken = raw, layer.span(lo, hi), False

    def _inflated(self, source) -> Iterator[bytes]:
        """What all members unfold to, in pieces; bytes behind them come as they are, after a divider."""
        d, fed, rest = None, False, b""
        while raw := rest or source.read(PIECE_BYTES):
            d = d or _unfolding(raw)
            try:
                out = d.decompress(raw, PIECE_BYTES)
            except _DAMAGED:
                self.broken = True
                yield b"\0" + (b"" if raw is _KEPT else raw)
                while raw := source.read(PIECE_BYTES):
                    yield raw
                return
            if out:
                yield out
            rest, fed = d.unconsumed_tail, True
            if d.eof:
                rest = d.unused_data.lstrip(b"\0") or source.read(PIECE_BYTES).lstrip(b"\0")
                if 0 < len(rest) < 10:
                    rest += source.read(PIECE_BYTES)
                fed = False
                if rest and not _packed(rest):
                    yield b"\0" + rest
                    while raw := source.read(PIECE_BYTES):
                        yield raw
                    return
                d = None
        while fed and not d.eof and (out := d.decompress(b"", PIECE_BYTES)):
            yield out
        self.broken |= fed and not d.eof

    def layers(self) -> Iterator[Layer]:
        """The unfolded text, through any further compression, in pieces that end with a stretch."""
        source, seen = io.BytesIO(self.raw), {sha256(self.raw).digest()}
        while True:
            out, head = self._inflated(source), b""
            while len(head) < 10 and (more := next(out, b"")):
                head += more
            if not _packed(head):
                break
            digest, spill = sha256(), tempfile.SpooledTemporaryFile(SPILL_BYTES)
            for piece in chain([head], out):
                digest.update(piece)
                spill.write(piece)
            source.close()
            spill.seek(0)
            source = spill
            if digest.digest() in seen:
                return
            seen.add(digest.digest())
        decode, held = codecs.getincrementaldecoder("utf-8")("replace").decode, []
        for piece in chain([head], out):
            text = decode(piece)
            if m := _TO_LAST_DIVIDER.match(text):
                yield self._whole("".join(held) + text[:m.end()])
                held = [text[m.end():]]
            else:
                held.append(text)
        yield self._whole("".join(held) + decode(b"", True))
        source.close()

    def _whole(self, text: str) -> Layer:
        return Layer(text, [(0, *self.where, False)])


def _readable(raw: bytes) -> str | None:
    code = "utf-8"
    if raw.count(0) * 3 > len(raw) > 3 and len(raw) % 2 == 0:
        code = "utf-16-be" if raw[::2].count(0) > raw[1::2].count(0) else "utf-16-le"
    try:
        text = raw.decode(code)
    except UnicodeDecodeError:
        return None
    return text if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.95 * len(text) else None


def _base64(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return b""


def _parts(run: str) -> Iterator[tuple[str, int, int]]:
    """Readable parts of a base64 run that is not readable as a whole, decoded from each of its first four letters."""
    for phase in range(min(4, len(run))):
        raw = _base64(run[phase:])
        for m in _PART.finditer(raw):
            yield m[0].decode(), phase + m.start() * 4 // 3, min(len(run), phase - (-m.end() * 4 // 3))


def _packed_parts(run: str) -> Iterator[tuple[bytes, int]]:
    """Compressed bytes that begin inside a base64 run, with the place of their first letter."""
    for m in _PACKED_LETTERS.finditer(run, 1):
        raw = _base64(run[m.start():m.start() + 256])
        if _packed(raw) and _starts(raw):
            yield _base64(run[m.start():]), m.start()


def _runs(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Base64 runs, long ones first: lines of equal length with a line of any length before and after, and every line.

    With each run, the number of its characters before its last line.
    """
    for m in _BASE64.finditer(text):
        lines = [x.span() for x in _LINE.finditer(m[0])]
        ends = [hi for _, hi in lines[:-1]] + [len(m[0])]
        size = [hi - lo for lo, hi in lines]
        wanted = {(k, k) for k in range(len(lines)) if size[k] >= 16}
        a = 0
        while a < len(lines) and len(lines) > 1:
            b = a
            while b + 1 < len(lines) and size[b + 1] == size[a]:
                b += 1
            wanted |= {(i, j) for i in (a, max(a - 1, 0)) for j in (b, min(b + 1, len(lines) - 1))}
            a = b + 1
        for i, j in sorted(wanted, key=lambda w: (w[0] - w[1], w)):
            lo, hi = lines[i][0], ends[j]
            yield m[0][lo:hi].replace("\r", "").replace("\n", ""), m.start() + lo, m.start() + hi, sum(size[i:j])


def _byte_runs(text: str, start: re.Pattern, one: re.Pattern, value) -> Iterator[tuple[bytes, int, int]]:
    """Compressed bytes written with escapes: the bytes from a start to where they have unfolded."""
    at = 0
    while first := start.search(text, at):
        at = first.start() + 1
        raw, ends, p = bytearray(), [], first.start()
        d, used, out = zlib.decompressobj(47), 0, 0
        try:
            while True:
                lo = len(raw)
                while len(raw) < lo + 4096 and (m := one.match(text, p)):
                    new = value(m)
                    if new is None:
                        break
                    raw += new
                    p = m.end()
                    ends += [p] * len(new)
                if len(raw) == lo:
                    used = lo
                    break
                more = bytes(raw[lo:])
                while more and not d.eof:
                    out += len(d.decompress(more, PIECE_BYTES))
                    more = d.unconsumed_tail
                while d.eof and _packed(d.unused_data):  # the next member
                    more, d = d.unused_data, zlib.decompressobj(47)
                    while more and not d.eof:
                        out += len(d.decompress(more, PIECE_BYTES))
                        more = d.unconsumed_tail
                if d.eof and len(d.unused_data) > 1:
                    used = len(raw) - len(d.unused_data)
                    break
        except zlib.error:
            used = len(raw)
        if out:
            yield bytes(raw[:used]), first.start(), ends[used - 1]
            at = ends[used - 1]


def _percent_byte(blank: str):
    def value(m: re.Match) -> bytes:
        return bytes([int(m[1], 16)]) if m[1] else m[0].replace("+", blank).encode(errors="replace")
    return value


def _escape_byte(m: re.Match) -> bytes | None:
    if m[6]:
        return bytes([_SHORT[m[6]]])
    if m[5] and m[5][1] != "#":
        new = html.unescape(m[5])
        return new.encode("latin-1") if max(new) < "\u0100" else None
    if m[5]:
        body = m[5][2:-1]
        point = int(body[1:], 16) if body[0] in "xX" else int(body)
    else:
        code = m[1] or m[2] or m[3] or m[4]
        point = int(code, 16) if code else ord(m[0])
    return bytes([point]) if point < 256 else None


def inner(layer: Layer) -> Iterator[Layer | Packed | None]:
    """The layers directly inside one."""
    text = layer.text
    percent, escaped = "%" in text, "\\" in text or "&" in text and ";" in text
    if percent or escaped:
        for m in _STRETCH.finditer(text):
            if percent and text.find("%", *m.span()) >= 0:
                yield _substituted(layer, *m.span(), _PERCENT_RUN, _percent)
            if escaped:
                yield _substituted(layer, *m.span(), _ESCAPE, _escape)
    if percent:
        for blank in (" ", "+") if "+" in text else " ":  # forms write a blank as a plus sign
            for found in _byte_runs(text, _PACKED_PERCENT, _PERCENT_BYTE, _percent_byte(blank)):
                yield Packed(found[0], layer, *found[1:])
    if escaped:
        for found in _byte_runs(text, _PACKED_ESCAPE, _ESCAPE_BYTE, _escape_byte):
            yield Packed(found[0], layer, *found[1:])
    whole = (0, 0)
    for run, lo, hi, before in _runs(text):
        raw = _base64(run)
        if _packed(raw) and before and (used := _extent(raw)) <= before * 3 // 4 and not _readable(raw[used:]):
            continue  # the last line is a word of its own
        if _packed(raw) and not whole[0] <= lo < hi <= whole[1]:
            packed = Packed(raw, layer, lo, hi)
            yield packed
            if not packed.broken:
                whole = lo, hi
        if plain := _readable(raw):
            yield layer.part([(plain, lo, hi)])
        elif not before and hi - lo == len(run) and not _packed(raw):
            for part, a, b in _parts(run):
                yield layer.part([(part, lo + a, lo + b)])
            for raw, a in _packed_parts(run):
                yield Packed(raw, layer, lo + a, hi)


class _Scan:
    """Spans found in one text, and its layers seen."""

    def __init__(self):
        self.spans, self.seen, self.layers, self.cut = set(), set(), 0, 0

    def new(self, raw: bytes, where: tuple[int, int]) -> bool:
        mark = (sha256(raw).digest(), *where)
        if mark in self.seen:
            return False
        self.seen.add(mark)
        return True

    def search(self, layer: Layer) -> None:
        work = deque([layer])
        while work:
            for new in inner(work.popleft()):
                if isinstance(new, Packed):
                    if self.new(new.raw, new.where):
                        unfolded = False
                        for piece in new.layers():
                            if piece.text.strip("\0") and self.new(piece.text.encode(errors="replace"), new.where):
                                unfolded = True
                                self.spans.update((k, *new.where) for k, _, _ in matches(piece.text))
                                self.search(piece)
                        self.layers += unfolded
                        self.cut += new.broken and unfolded
                elif new is not None and new.text and self.new(new.text.encode(errors="replace"), new.span(0, len(new.text))):
                    self.layers += 1
                    self.spans.update((k, *new.span(lo, hi)) for k, lo, hi in matches(new.text))
                    work.append(new)


def scan(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans, number of layers unwrapped, number of those that break off."""
    order = {k: i for i, k in enumerate(KINDS)}

    def key(s: Span):
        return s[1], order[s[0]], s[2]

    base = sorted(matches(text), key=key)
    state = _Scan()
    state.spans.update(base)
    state.search(Layer(text))
    return base, sorted(state.spans, key=key), state.layers, state.cut


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in spans)


def found(docs: DataFrame) -> DataFrame:
    """Every document's secrets: counts of each kind and digest of the base spans, all spans, layers."""

    def run(batch):
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "cut_layers")}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base, spans, layers, cut = scan(text)
            row = (doc, *[sum(k == kind for k, _, _ in base) for kind in KINDS],
                   sha256(joined(base).encode()).hexdigest(), joined(spans), layers, cut)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return out

    return map_arrow(keyed(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                       "spans string, layers int, cut_layers int")
