"""Secret scans through nested encodings.

Every text is scanned for assignments, access keys and long hex runs. A worklist of fragments then
unwraps layers until no new one appears:

* URL and Unicode escapes of all kinds stand inside words, so their whole line is decoded, all
  escapes of a level at once; chains of escaped escape marks are one step.
* A base64 run is decoded by itself: as text or as a compressed stream from every place where a
  payload may start, and as any bytes at its four offsets. What comes out is a fragment of its
  own, so nothing around it is read again and the work grows with the text.
* A compressed stream (gzip, zlib, raw deflate, bzip2, xz, members of a zip file; several in a row)
  is unfolded in pieces of ``PIECE`` bytes that are cut where no pattern can be open, so a stream of
  any length is read whole in bounded memory. Streams inside its content are opened too, from a
  temporary file that begins at the first mark of one.

Each fragment is scanned, and each of its characters knows its place in the original text; what a
stream holds stands where the stream does. A fragment met before at the same place is not opened
again, which ends cycles and streams that hold themselves.

Defined results: a null or empty text has no secrets. Spans are in code points, end exclusive.
Equal spans are reported once; a text's own spans always stay, and layers add only spans that
touch something unwrapped. A base64 run goes on over single line breaks if its first line has 16
characters; its payload may start and end at its ends, at line breaks and at any "/", "-" or "_".
Bytes are read as UTF-8 or UTF-16, all characters included; other bytes are read as Latin-1 and
kept where they hold a secret or another layer. Of a stream that is cut or broken, what unfolds is
scanned; it and zip members packed by other methods are counted in ``n_unopened``. Repeated rows
and null ids are carried as they are; extra columns are ignored.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import codecs
import hashlib
import html.entities
import lzma
import mmap
import re
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxtable.llm import columnar as cx

# Bytes of a stream unfolded at once.
PIECE = 4 << 20
_FEED = 1 << 16

# The patterns of the base scan and the order of the kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20

_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
# Escapes; a chain such as %2525 or &amp;amp; in front of one belongs to it.
_UNITS = (
    r"%(?:25)*[0-9A-Fa-f]{2}", r"%u[0-9A-Fa-f]{4}", r"\\u[0-9A-Fa-f]{4}", r"\\u\{[0-9A-Fa-f]{1,6}\}", r"\\U[0-9A-Fa-f]{8}", r"\\x[0-9A-Fa-f]{2}", r"\\[0-3][0-7]{2}",
    r"""\\["'/\\]""", r"&(?:amp;)*#[0-9]{1,7};", r"&(?:amp;)*#[xX][0-9A-Fa-f]{1,6};", r"&(?:amp;)*[A-Za-z][A-Za-z0-9]{1,31};",
)
_UNIT = re.compile("|".join(f"({u})" for u in _UNITS))
_ESCAPED = re.compile("(?:" + "|".join(_UNITS) + ")+")
_ENTITY = re.compile("&(?:amp;)*([^;&]+);")
_MARKS = ("%", "\\", "&")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)*={0,2}")
_BREAK = re.compile(r"\r?\n[\x20\t]*")
_PART = re.compile(r"[/_-]")
_STANDARD = str.maketrans("-_", "+/")
MIN_RUN = 16
# Characters that no pattern, run or escape holds, and blanks inside plain words.
_APART = ",()<>[]!?*$@~^|`"
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z0-9])\x20(?=[A-Za-z0-9])")

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """Spans of the base kinds in one layer, ordered by start and kind."""
    found: list[Span] = []
    lower = text.lower()
    if any(k in lower for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_place)


def _place(span: Span):
    return span[1], KINDS.index(span[0]), span[2]


class Fragment:
    """A text and the place [starts, ends) of its characters in the original: per character, or one for all.

    ``opened`` marks characters that an encoding gave; None means all of them.
    """

    __slots__ = ("text", "starts", "ends", "opened")

    def __init__(self, text: str, starts, ends, opened=None):
        self.text, self.starts, self.ends, self.opened = text, starts, ends, opened

    def place(self, low: int, high: int) -> tuple[int, int]:
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[low]), int(self.ends[high - 1])

    def places(self, low: np.ndarray, high: np.ndarray):
        """Places of the characters [low, high), for many at once."""
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[low], self.ends[high - 1]

    def touched(self, low: int, high: int) -> bool:
        return self.opened is None or bool(self.opened[low:high].any())

    def key(self) -> tuple:
        return (hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *self.place(0, len(self.text)))


# ---- escapes ----

def _code(unit: str) -> list[int] | bytes | None:
    """Code points of an escape, or the byte of a URL escape; None if it stands for nothing."""
    if unit[0] == "%":
        return [int(unit[2:], 16)] if unit[1] == "u" else bytes([int(unit[-2:], 16)])
    if unit[0] == "\\":
        if unit[1] in "\"'/\\":
            return [ord(unit[1])]
        code = int(unit[1:], 8) if unit[1] in "0123" else int(unit[3:-1] if unit[2] == "{" else unit[2:], 16)
    else:
        name = _ENTITY.fullmatch(unit)[1]
        if name[0] != "#":
            return [ord(c) for c in html.entities.html5.get(f"{name};", "")] or None
        code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return [code] if code <= 0x10FFFF else None


def _unescaped(run: str) -> tuple[str, np.ndarray, np.ndarray, bytes] | None:
    """A run of escapes decoded, with the range of each character in the run; and the bytes it starts with."""
    text, starts, ends = [], [], []
    plain, only_bytes = bytearray(), True
    raw, at_raw = bytearray(), []

    def flush():
        if raw:
            read = raw.decode("utf-8", "replace")
            sizes = [len(c.encode()) if c != "�" else 1 for c in read]
            if sum(sizes) != len(raw):  # a literal replacement character or a cut sequence
                read, sizes = raw.decode("latin-1"), [1] * len(raw)
            at = 0
            for c, size in zip(read, sizes):
                text.append(c)
                starts.append(at_raw[at][0])
                at += size
                ends.append(at_raw[at - 1][1])
            raw.clear()
            at_raw.clear()

    high = None
    for m in _UNIT.finditer(run):
        codes = _code(m[0])
        only_bytes = only_bytes and codes is not None and max(codes) < 256
        if only_bytes:
            plain.extend(codes)
        if isinstance(codes, bytes):
            raw.extend(codes)
            at_raw.append(m.span())
            high = None
            continue
        flush()
        if codes is None:
            codes = [ord(c) for c in m[0]]
            text += m[0]
            starts += range(m.start(), m.end())
            ends += range(m.start() + 1, m.end() + 1)
            high = None
            continue
        for code in codes:
            if high is not None and 0xDC00 <= code < 0xE000:
                text[-1] = chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00)
                ends[-1] = m.end()
                high = None
            else:
                high = code if 0xD800 <= code < 0xDC00 else None
                text.append("�" if 0xD800 <= code < 0xE000 else chr(code))
                starts.append(m.start())
                ends.append(m.end())
    flush()
    new = "".join(text)
    return None if new == run else (new, np.array(starts, np.int64), np.array(ends, np.int64), bytes(plain))


def _lines(frag: Fragment) -> Iterator[Fragment]:
    """The lines of a fragment that hold escapes, with these decoded; and streams that escapes spell out."""
    text = frag.text
    if not any(m in text for m in _MARKS):
        return
    low = high = 0
    parts: list[tuple[int, int, str, np.ndarray, np.ndarray]] = []
    for m in _ESCAPED.finditer(text):
        got = _unescaped(m[0])
        if got is None:
            continue
        if m.start() >= high:
            if parts:
                yield _spliced(frag, low, high, parts)
            parts = []
            low = max(text.rfind("\n", 0, m.start()), text.rfind("\r", 0, m.start())) + 1
            after = [x for x in (text.find("\n", m.end()), text.find("\r", m.end())) if x >= 0]
            high = min(after, default=len(text))
        parts.append((m.start(), m.end(), got[0], got[1] + m.start(), got[2] + m.start()))
        if _magic(got[3]):
            yield from _from_stream(Stream(got[3]), *frag.place(m.start(), m.end()))
    if parts:
        yield _spliced(frag, low, high, parts)


def _spliced(frag: Fragment, low: int, high: int, parts) -> Fragment:
    """frag[low:high] with some runs replaced."""
    texts, at = [], low
    fixed = isinstance(frag.starts, int)
    starts, ends, opened = [], [], []
    for first, last, new, source, source_end in [*parts, (high, high, "", np.zeros(0, np.int64), np.zeros(0, np.int64))]:
        texts += [frag.text[at:first], new]
        if not fixed:
            starts += [frag.starts[at:first], frag.starts[source]]
            ends += [frag.ends[at:first], frag.ends[source_end - 1]]
        opened += [np.ones(first - at, bool) if frag.opened is None else frag.opened[at:first], np.ones(len(new), bool)]
        at = last
    text, marks = "".join(texts), np.concatenate(opened)
    if fixed:
        return Fragment(text, frag.starts, frag.ends, None if marks.all() else marks)
    return Fragment(text, np.concatenate(starts), np.concatenate(ends), None if marks.all() else marks)


# ---- compressed streams ----

# Marks long enough to be looked for at any byte.
_STRONG = (b"\x1f\x8b\x08\x00", b"\x1f\x8b\x08\x08", b"1AY&SY", b"\xfd7zXZ\x00", b"PK\x03\x04")


def _magic(raw: bytes) -> str | None:
    if raw[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if len(raw) > 6 and raw[0] == 0x78 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return "zlib"
    if raw[:3] == b"BZh" and raw[3:4].isdigit() and raw[4:10] == b"1AY&SY":
        return "bz2"
    if raw[:6] == b"\xfd7zXZ\x00":
        return "xz"
    return "zip" if raw[:4] == b"PK\x03\x04" else None


class Stream:
    """The streams at the start of some bytes: their content in pieces, then ``used`` bytes and whether all ended well."""

    def __init__(self, raw: bytes, raw_deflate: bool = False):
        self.raw, self.raw_deflate, self.used, self.whole, self.sure = raw, raw_deflate, 0, True, False

    def pieces(self) -> Iterator[bytes]:
        kind = "deflate" if self.raw_deflate else _magic(self.raw[:16])
        while kind and self.whole:
            self.sure |= kind not in ("zlib", "deflate")
            if kind == "zip":
                yield from self._members()
            elif kind in ("bz2", "xz"):
                yield from self._fed(bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(lzma.FORMAT_XZ))
            else:
                yield from self._inflated(-15 if kind == "deflate" else 47)
            kind = _magic(self.raw[self.used : self.used + 16]) if self.whole and not self.raw_deflate else None

    def _inflated(self, window: int) -> Iterator[bytes]:
        stream, at, tail = zlib.decompressobj(window), self.used, b""
        while not stream.eof:
            block = tail or self.raw[at : at + _FEED]
            at += 0 if tail else len(block)
            if not block:
                self.whole = False
                break
            before = stream.copy()
            try:
                got = stream.decompress(block, PIECE)
            except zlib.error:
                self.whole, got = False, b""
                try:  # byte by byte, to keep what comes before the fault
                    for k in range(len(block)):
                        got += before.decompress(block[k : k + 1])
                except zlib.error:
                    pass
            tail = stream.unconsumed_tail
            if got:
                yield got
            if not self.whole:
                break
        self.used = at - len(stream.unused_data) - len(tail)

    def _fed(self, stream) -> Iterator[bytes]:
        at = self.used
        while not stream.eof:
            block = self.raw[at : at + _FEED] if stream.needs_input else b""
            if stream.needs_input and not block:
                self.whole = False
                break
            at += len(block)
            try:
                got = stream.decompress(block, PIECE)
            except (OSError, lzma.LZMAError, EOFError):
                self.whole = False
                break
            if got:
                yield got
        self.used = at - len(stream.unused_data if stream.eof else b"")

    def _members(self) -> Iterator[bytes]:
        while self.raw[self.used : self.used + 4] == b"PK\x03\x04" and len(self.raw) >= self.used + 30:
            head = self.raw[self.used : self.used + 30]
            number = lambda a, n: int.from_bytes(head[a : a + n], "little")
            method, size = number(8, 2), number(18, 4)
            self.used += 30 + number(26, 2) + number(28, 2)
            if method == 8:
                yield from self._inflated(-15)
            elif method == 12:
                yield from self._fed(bz2.BZ2Decompressor())
            elif method == 0:
                for k in range(self.used, min(self.used + size, len(self.raw)), PIECE):
                    yield self.raw[k : min(k + PIECE, self.used + size)]
                self.whole &= self.used + size <= len(self.raw)
                self.used += size
            else:
                self.whole = False
            if not self.whole:
                return
            following = self.raw.find(b"PK", self.used, self.used + 32)
            if following < 0:
                return
            self.used = following
            if self.raw[following : following + 4] == b"PK\x07\x08":  # sizes that follow a member
                self.used = following + 16 if self.raw[following + 16 : following + 18] == b"PK" else following + 12
        # The directory at the end holds names only.
        end = self.raw.find(b"PK\x05\x06", self.used)
        if end >= 0:
            self.used = min(len(self.raw), end + 22)


def _readings(pieces: Iterator[bytes]) -> Iterator[str]:
    """Text of a stream, cut only where no pattern can be open."""
    reader, held = None, ""
    for piece in pieces:
        if reader is None:
            codec = _utf16(piece[: 1 << 12])
            reader = codecs.getincrementaldecoder(codec)("replace") if codec else codecs.getincrementaldecoder("utf-8")("surrogateescape")
        held += reader.decode(piece)
        cut = max(held.rfind(c) for c in _APART)
        for m in _BETWEEN_WORDS.finditer(held, max(cut, len(held) - _FEED, 0)):
            cut = max(cut, m.start())
        if cut >= 0:
            yield held[: cut + 1]
            held = held[cut + 1 :]
    if reader is not None:
        held += reader.decode(b"", True)
    if held:
        yield held


class _From:
    """The bytes of some data or mapped file from a place on, read where they are asked for."""

    def __init__(self, data, at: int):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.data) - self.at

    def __getitem__(self, part: slice) -> bytes:
        end = len(self.data) if part.stop is None else min(len(self.data), self.at + part.stop)
        return bytes(self.data[self.at + (part.start or 0) : end])

    def find(self, mark: bytes, start: int = 0, end: int | None = None) -> int:
        got = self.data.find(mark, self.at + start, len(self.data) if end is None else min(len(self.data), self.at + end))
        return got - self.at if got >= 0 else -1


# Marks of streams inside the content of a stream; "BZh" and a digit stand before that of bzip2.
_HELD = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|PK\x03\x04")
_MARK = 10


def _stream_digest(stream: Stream) -> bytes:
    digest = hashlib.sha256()
    for k in range(0, stream.used, PIECE):
        digest.update(stream.raw[k : min(k + PIECE, stream.used)])
    return digest.digest()


def _unfolded(stream: Stream, low: int, high: int, seen: set[bytes]) -> Iterator[Fragment | Stream]:
    """The texts of a stream, then the streams its content holds; content from the first mark on is kept in a file."""
    with tempfile.TemporaryFile() as kept:
        size = 0

        def watched() -> Iterator[bytes]:
            nonlocal size
            tail, fresh = b"", True
            for piece in stream.pieces():
                if size:
                    size += kept.write(piece)
                else:
                    window = tail + piece
                    mark = _HELD.search(window)
                    at = 0 if fresh and _magic(window[:16]) else mark.start() if mark else -1
                    if at >= 0:
                        size = kept.write(memoryview(window)[at:])
                    tail, fresh = window[-_MARK:], False
                yield piece

        for text in _readings(watched()):
            yield Fragment(text, low, high)
        # An empty fragment tells how the stream at this place ended.
        if stream.sure or not stream.whole:
            yield Fragment("", low, high, stream.whole)
        key = _stream_digest(stream)
        if not size or key in seen:
            return
        seen.add(key)
        kept.flush()
        with mmap.mmap(kept.fileno(), 0, access=mmap.ACCESS_READ) as data:
            at = 0
            while at < size:
                held = Stream(_From(data, at))
                yield held
                following = _HELD.search(data, at + (held.used if held.whole and held.used else 1))
                at = following.start() if following else size


def _from_stream(stream: Stream, low: int, high: int) -> Iterator[Fragment]:
    """Texts of a stream and of all streams inside it, however deep; a stream that holds itself is opened once."""
    seen: set[bytes] = set()
    work = [_unfolded(stream, low, high, seen)]
    while work:
        got = next(work[-1], None)
        if got is None:
            work.pop()
        elif isinstance(got, Stream):
            work.append(_unfolded(got, low, high, seen))
        else:
            yield got


# ---- base64 ----

def _utf16(raw: bytes) -> str | None:
    """The codec of bytes with a mark of UTF-16 or zeros in most high bytes."""
    for codec, mark, high in (("utf-16-le", codecs.BOM_UTF16_LE, raw[1::2]), ("utf-16-be", codecs.BOM_UTF16_BE, raw[::2])):
        if raw[:2] == mark or (len(high) >= 4 and 2 * high.count(0) > len(high) and 2 * raw.count(0) <= len(raw) + 1):
            return codec
    return None


def _sizes(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


def _readable(raw: bytes) -> tuple[str, np.ndarray] | None:
    """UTF-16 or UTF-8 text and the bytes of each of its characters."""
    codec = _utf16(raw)
    if codec:
        text = raw[: len(raw) // 2 * 2].decode(codec, "replace")
        return text, np.where(_sizes(text) > 3, 4, 2)
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return (text, _sizes(text)) if text else None


def _bytes(run: str) -> bytes:
    """The bytes of a run of any length; a last character alone holds no byte."""
    run = run[: len(run) - (len(run) % 4 == 1)]
    return binascii.a2b_base64(run + "=" * (-len(run) % 4))


def _valid(raw: bytes) -> int:
    """Length of the start of ``raw`` that is UTF-8; a character cut at the end does not count."""
    try:
        return len(codecs.utf_8_decode(raw, "strict", False)[0].encode())
    except UnicodeDecodeError as fault:
        return fault.start


def _deflated(head: bytes) -> bool:
    """Whether raw deflate can go on from some first bytes, and they already hold plain text."""
    try:
        got = zlib.decompressobj(-15).decompress(head, 64)
    except zlib.error:
        return False
    return len(got) >= 8 and sum(c in b"\t\n\r" or 32 <= c < 127 for c in got) * 10 >= 9 * len(got)


def _payload(run: str, start: int, ends: list[int]):
    """What stands at ``start``: (end, text, bytes of each character), (None, stream, None), or None."""
    head = _bytes(run[start : start + 128])
    if _magic(head) or _deflated(head):
        return None, Stream(_bytes(run[start:]), not _magic(head)), None
    head = head[:48]
    if _utf16(head):
        return len(run), *_readable(_bytes(run[start:]))
    valid = _valid(head)
    if valid >= len(head) - 3:
        raw = _bytes(run[start:])
        valid = _valid(raw)
        limit = len(run) if valid >= len(raw) - 3 else start + -(-valid * 4 // 3)
    elif valid < 12:
        return None
    else:
        limit = start + -(-valid * 4 // 3)
    for end in reversed(ends[: bisect.bisect_right(ends, limit)]):
        if end - start < MIN_RUN:
            break
        got = _readable(_bytes(run[start:end])) if (end - start) % 4 != 1 else None
        if got is not None:
            return end, *got
    return None


def _runs(text: str):
    """Base64 runs as one line each: the match, the run, the place of its characters, and where payloads may start and end."""
    for m in _BASE64.finditer(text):
        body = m[0].rstrip("=")
        lines, at = [], 0
        for line_break in _BREAK.finditer(body):
            lines.append((at, line_break.start()))
            at = line_break.end()
        lines.append((at, len(body)))
        places = np.concatenate([np.arange(a, b) for a, b in lines]) + m.start()
        run = "".join(body[a:b] for a, b in lines)
        joins = np.cumsum([b - a for a, b in lines]).tolist()
        parts = [x.start() for x in _PART.finditer(run)]
        yield m, run.translate(_STANDARD), places, sorted({0, *joins, *(k + 1 for k in parts)}), sorted({*joins, *parts})


def _payloads(frag: Fragment) -> Iterator[Fragment]:
    for m, run, places, starts, ends in _runs(frag.text):
        low = 0
        for start in starts:
            if start < low or len(run) - start < MIN_RUN:
                continue
            got = _payload(run, start, ends)
            if got is None:
                continue
            end, text, sizes = got
            if end is None:
                stream, first, some = text, int(places[start]), False
                held = _from_stream(stream, *frag.place(first, m.end()))
                ahead = []
                for piece in held:
                    # Bytes that only look like a stream end at once and hold little.
                    if not some and not (stream.sure or stream.whole and stream.used or len(piece.text) >= 64):
                        ahead.append(piece)
                        continue
                    some = True
                    yield from ahead
                    ahead = []
                    yield piece
                if some or (ahead and stream.whole):
                    yield from ahead
                    low = min(len(run), start + stream.used * 4 // 3) if stream.whole else start + 1
                    after = _readable(stream.raw[stream.used :]) if stream.whole and stream.used < len(stream.raw) else None
                    if after:
                        yield Fragment(after[0], *frag.place(first, m.end()))
                continue
            low = end
            if text:
                to = np.cumsum(sizes)
                first, last = places[start + (to - sizes) * 4 // 3], places[np.minimum(start - (-to * 4 // 3), low) - 1] + 1
                if low == len(run):
                    last[-1] = m.end()
                yield Fragment(text, *frag.places(first, last))
        yield from _any_bytes(frag, m, run, places)


def _holds_more(text: str) -> bool:
    return bool(scan(text) or any(m in text for m in _MARKS) and _ESCAPED.search(text) or _BASE64.search(text))


def _any_bytes(frag: Fragment, m, run: str, places: np.ndarray) -> Iterator[Fragment]:
    """A run read as Latin-1 or UTF-16 from each offset."""
    for k in range(4):
        raw = _bytes(run[k:])
        for mark in _STRONG:
            ahead = 4 if mark == b"1AY&SY" else 0
            at = raw.find(mark, 1 + ahead)
            while at > 0:
                at -= ahead
                stream = Stream(raw[at:])
                yield from _from_stream(stream, *frag.place(int(places[k + at * 4 // 3]), m.end()))
                at = raw.find(mark, at + ahead + max(1, stream.used))
        for codec, skip, size in (("latin-1", 0, 1), *((c, j, 2) for c in ("<u2", ">u2") for j in (0, 1))):
            part = raw[skip : skip + (len(raw) - skip) // size * size]
            if size == 1:
                text = part.decode("latin-1")
            else:
                units = np.frombuffer(part, codec)
                # The shortest secret has more plain characters in a row.
                plain = cx.running(units < 0x80)
                if not (plain[8:] - plain[:-8] == 8).any():
                    continue
                # Each pair of bytes stays one character: lone halves of a pair of surrogates are kept.
                text = units.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            if _holds_more(text):
                before = skip + size * np.arange(len(text))
                first, last = places[k + before * 4 // 3], places[np.minimum(k - (-(before + size) * 4 // 3), len(run)) - 1] + 1
                yield Fragment(text, *frag.places(first, last))


# ---- the worklist ----

def _inner(frag: Fragment) -> Iterator[Fragment]:
    yield from _lines(frag)
    yield from _payloads(frag)


def find(text: str) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans, and how many compressed streams did not open wholly."""
    base = scan(text)
    if not (_BASE64.search(text) or any(m in text for m in _MARKS) and _ESCAPED.search(text)):
        return base, base, 0
    n = len(text)
    root = Fragment(text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool))
    found, seen, whole, broken = set(base), {root.key()}, set(), set()
    work = [_inner(root)]
    while work:
        frag = next(work[-1], None)
        if frag is None:
            work.pop()
            continue
        if not frag.text:
            (whole if frag.opened else broken).add(frag.starts)
            continue
        key = frag.key()
        if key in seen:
            continue
        seen.add(key)
        for kind, low, high in scan(frag.text):
            if frag.touched(low, high):
                found.add((kind, *frag.place(low, high)))
        work.append(_inner(frag))
    # Some other layer may open what one has cut.
    return base, sorted(found, key=_place), len(broken - whole)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: counts of the base kinds, a digest of the base spans, and all spans."""

    def run(texts):
        got = [find(t) for t in texts]
        counts = [pa.array([sum(s[0] == kind for s in base) for base, _, _ in got], pa.int64()) for kind in KINDS]
        digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in got]
        return [*counts, pa.array(digests, pa.string()), pa.array([joined(every) for _, every, _ in got], pa.string()), pa.array([n for *_, n in got], pa.int64())]

    return cx.text_map(docs, text_col, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_unopened long", [id_col], strings=True)
