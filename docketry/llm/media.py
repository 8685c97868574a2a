"""Media columns (op 2): signature sniffing over binary columns.

Aho-Corasick finds all magic bytes of a value in one pass; a validator for each format confirms the structure and
its length. A value that is one whole medium gets that medium's type, whatever was declared; media found further in are
carved out with their spans. Values are bytes; each is judged by itself, in Arrow batches. What several starts would search
for again (ends of PDF and ZIP, chains of chunks and blocks) is found once a value, so time grows with a value's length.

Cases: null or empty bytes are type "empty"; bytes that no validator confirms keep the declared type; of overlapping
finds the leftmost, then longest, is carved; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import small_batches, stored



class Value:
    """The bytes of a value, with what has been found out about it so far."""

    def __init__(self, b: bytes):
        self.b = b
        self.dead: dict[str, set[int]] = {}
        self.ends: dict[str, dict[int, int]] = {}
        self._chunks: Chunks | None = None

    def chunks(self) -> Chunks:
        if self._chunks is None:
            self._chunks = Chunks(self.b)
        return self._chunks

    def walk(self, name: str, at: int, step: Callable[[int], tuple[str, int]]) -> int | None:
        """Follows step from place to place until it says "end" (then that place) or "no". Places that led nowhere are kept,
        but for the first ones, which are as many as there are starts."""
        dead, seen = self.dead.setdefault(name, set()), []
        while at not in dead:
            says, at = step(at)
            if says == "end":
                return at
            if says == "no":
                break
            seen.append(at)
        dead.update(seen)
        return None

    def last_ends(self, name: str, find: Callable[[bytes], Iterator[tuple[int, int]]]) -> dict[int, int]:
        """start -> the last end that belongs to it, from one pass over the value."""
        if name not in self.ends:
            found: dict[int, int] = {}
            for start, end in find(self.b):
                found[start] = max(end, found.get(start, 0))
            self.ends[name] = found
        return self.ends[name]


# Each validator takes a value and a start and returns the end of a well-formed medium there, or None.


def _png(v: Value, at: int) -> int | None:
    b = v.b
    if b[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None

    def chunk(p: int) -> tuple[str, int]:
        if p + 12 > len(b):
            return "no", p
        n, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + n
        if end > len(b) or zlib.crc32(memoryview(b)[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return "no", p
        return ("end" if kind == b"IEND" else "on"), end

    return v.walk("png", at + 8, chunk)


class Chunks:
    """The chains of RIFF chunks from all headers of a value. A chunk's place says where the next one is, so chains that meet are one
    from there on: a forest, in which a place is on the chain of a start if and only if it is an ancestor. Each place is looked at once."""

    def __init__(self, b: bytes):
        self.next: dict[int, int] = {}
        at = b.find(b"RIFF")
        while at >= 0:
            p = at + 12
            while p not in self.next and p + 8 <= len(b):
                n = struct.unpack_from("<I", b, p + 4)[0]
                self.next[p] = p = p + 8 + n + (n & 1)
            at = b.find(b"RIFF", at + 1)
        size: dict[int, int] = {}
        for p in sorted({*self.next, *self.next.values()}):  # a chunk lies before the next one: children before parents
            size[p] = size.get(p, 0) + 1
            if p in self.next:
                size[self.next[p]] = size.get(self.next[p], 0) + size[p]
        self.first: dict[int, int] = {}
        self.size, free, roots = size, {}, 0
        for p in sorted(size, reverse=True):
            up = self.next.get(p)
            self.first[p] = roots if up is None else free[up]
            if up is None:
                roots += size[p]
            else:
                free[up] += size[p]
            free[p] = self.first[p] + 1

    def leads(self, start: int, to: int) -> bool:
        """True if the chain from start comes by `to`; start itself counts."""
        if start == to:
            return True
        return start in self.first and to in self.first and 0 <= self.first[start] - self.first[to] < self.size[to]


def _riff(form: bytes) -> Callable[[Value, int], int | None]:
    def check(v: Value, at: int) -> int | None:
        b = v.b
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b) or end < at + 12:
            return None
        chain = v.chunks()
        # A last chunk of odd size has a byte of padding after it; a chunk whose head reaches over the end is none.
        padded = chain.leads(at + 12, end + 1) and not (chain.next.get(end - 7) == end + 1 and chain.leads(at + 12, end - 7))
        return end if chain.leads(at + 12, end) or padded else None

    return check


def _jpeg(v: Value, at: int) -> int | None:
    b = v.b

    def segment(p: int) -> tuple[str, int]:
        if b[p : p + 2] == b"\xff\xd9":
            return "end", p + 2
        if p + 4 > len(b) or b[p] != 0xFF:
            return "no", p
        if b[p + 1] == 0xDA:  # the scan's data lasts until a marker that is not part of it
            m = _MARKER.search(b, p + 2)
            return ("on", m.start()) if m else ("no", p)
        n = struct.unpack_from(">H", b, p + 2)[0]
        return ("on", p + 2 + n) if n >= 2 else ("no", p)

    return v.walk("jpeg", at + 2, segment)


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


def _gif(v: Value, at: int) -> int | None:
    b = v.b
    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def block(p: int) -> tuple[str, int]:
        """Places below zero are sub-blocks, others the beginnings of blocks."""
        if p < 0:
            q = ~p
            if q >= len(b):
                return "no", p
            return "on", q + 1 if not b[q] else ~(q + 1 + b[q])
        if p >= len(b):
            return "no", p
        if b[p] == 0x3B:
            return "end", p + 1
        if b[p] == 0x21:
            return "on", ~(p + 2)
        if b[p] == 0x2C and p + 10 <= len(b):
            return "on", ~(p + 11 + table(b[p + 9]))
        return "no", p

    return v.walk("gif", at + 13 + table(b[at + 10]), block)


def _bmp(v: Value, at: int) -> int | None:
    b = v.b
    if at + 30 > len(b):
        return None
    size, _, offset, head = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    return at + size if head in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and 54 <= offset <= size <= len(b) - at else None


_PDF_END = re.compile(rb"startxref\s{1,4}(\d{1,12})\s{1,4}%%EOF")
_PDF_TABLE = re.compile(rb"(?<!start)xref\b|\b\d{1,10} \d{1,5} obj\b")


def _pdf_ends(b: bytes) -> Iterator[tuple[int, int]]:
    """Each end names the offset of its table: the last table or object before it, so the start is known. Later ends are updates."""
    tables, last = _PDF_TABLE.finditer(b), {}
    ahead = next(tables, None)
    for m in _PDF_END.finditer(b):
        while ahead and ahead.start() < m.start():
            last[ahead[0] == b"xref"] = ahead.start()
            ahead = next(tables, None)
        for at in last.values():
            yield at - int(m[1]), m.end()


def _pdf(v: Value, at: int) -> int | None:
    end = v.last_ends("pdf", _pdf_ends).get(at)
    return end if end and end > at else None


def _zip_ends(b: bytes) -> Iterator[tuple[int, int]]:
    """Each end record names the size and offset of its directory, so the start is known."""
    at = b.find(b"PK\x05\x06")
    while at >= 0:
        if at + 22 <= len(b):
            size, offset, note = struct.unpack_from("<IIH", b, at + 12)
            start, end = at - size - offset, at + 22 + note
            if start >= 0 and end <= len(b) and (not size or b[at - size : at - size + 4] == b"PK\x01\x02"):
                yield start, end
        at = b.find(b"PK\x05\x06", at + 1)


def _zip(v: Value, at: int) -> int | None:
    return v.last_ends("zip", _zip_ends).get(at)


def _gzip(v: Value, at: int) -> int | None:
    b = v.b
    if at + 18 > len(b) or b[at + 3] & 0xE0 or b[at + 8] not in (0, 2, 4) or (b[at + 9] > 13 and b[at + 9] != 255):
        return None
    d = zlib.decompressobj(31)
    try:
        left = memoryview(b)[at:]
        while not d.eof and left:
            d.decompress(left, 1 << 20)
            left = d.unconsumed_tail
        return len(b) - len(d.unused_data) if d.eof else None
    except zlib.error:
        return None


#: Magic bytes of the formats, their media types and validators.
FORMATS: list[tuple[bytes, str, Callable[[Value, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE")),
    (b"RIFF", "image/webp", _riff(b"WEBP")),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
]
_AUTOMATON = []


def _automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic in dict.fromkeys(m for m, _, _ in FORMATS):
            a.add_word(magic.decode("latin-1"), (len(magic), [(kind, check) for m, kind, check in FORMATS if m == magic]))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of each confirmed medium: the whole value first if it is one, then those inside it, leftmost first."""
    v, out, free = Value(b), [], 0
    here: list[tuple[int, str, int]] = []

    def take() -> None:
        """Of the media that begin at one place, the longest."""
        nonlocal free
        end, kind, start = max(here)
        here.clear()
        if start == 0 and end == len(b) and not out:
            out.append((kind, start, end))
        elif start >= free:
            out.append((kind, start, end))
            free = end

    for last, (n, kinds) in _automaton().iter(b.decode("latin-1")):
        start = last - n + 1
        if here and here[0][2] != start:
            take()
        if start < free:
            continue
        here += [(end, kind, start) for kind, check in kinds if (end := check(v, start)) is not None]
    if here:
        take()
    return out


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples as a RIFF/WAVE file."""
    pad = b"\0" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad


def wav_samples(b: bytes) -> bytes:
    """The data chunk of a RIFF/WAVE file."""
    at = 12
    while at + 8 <= len(b):
        kind, n = struct.unpack_from("<4sI", b, at)
        if kind == b"data":
            return b[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    return b""


def feature(samples: bytes) -> str:
    """Level and spread of 8-bit samples, and how often they cross their middle value, as text."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return "n=0"
    counts = np.bincount(x, minlength=256)
    total, square = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    crossings = int(np.count_nonzero((x[1:] > 127) != (x[:-1] > 127)))
    share = counts[counts > 0] / len(x)
    return f"n={len(x)};mean={total / len(x):.4f};var={square / len(x) - (total / len(x)) ** 2:.4f};cross={crossings};entropy={float(-(share * np.log2(share)).sum()):.4f}"


SNIFFED = "key long, declared string, type string, n_carved int, carved array<struct<type:string,start:long,end:long>>"


def sniff_media(df: DataFrame, key: str = "doc_id", media: str = "media", declared: str = "declared") -> DataFrame:
    """One row for each value: the type that its bytes have (else the declared one), and what is carved out of it."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, carved = [], []
            for says, value in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                raw = value.as_py() or b""
                found = sniff(raw)
                whole = bool(found) and found[0][1:] == (0, len(raw))
                kinds.append(found[0][0] if whole else says if raw else "empty")
                carved.append([{"type": k, "start": s, "end": e} for k, s, e in found[whole:]])
            span = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kinds, pa.string()), pa.array([len(c) for c in carved], pa.int32()), pa.array(carved, span)], names=["key", "declared", "type", "n_carved", "carved"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(declared).cast("string").alias("declared"), F.col(media).cast("binary").alias("media")).mapInArrow(run, SNIFFED)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = [(t or "").encode() for t in b.column(1).to_pylist()]
        media = [wav(r + b"\0" * (-len(r) % 64 if r else 64)) for r in raw]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as 8-bit samples in RIFF/WAVE files (padded with bytes 0 to a positive multiple of 64), stored under a wrong type."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(d.mapInArrow(_store, "doc_id long, n_bytes long, declared string, media binary"), "media")


PROFILE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, n_carved int"


def profile_media(media: DataFrame) -> DataFrame:
    """Sniffs stored media, takes the samples of those that are RIFF/WAVE, and computes digests and features of both."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for says, value in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                raw = value.as_py()
                found = sniff(raw)
                whole = bool(found) and found[0][1:] == (0, len(raw))
                kind = found[0][0] if whole else says
                payload = wav_samples(raw) if kind == "audio/wav" else raw
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{kind};{feature(payload)}", kind, len(found) - whole))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in PROFILE.split(", ")])

    return media.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, PROFILE)


def media_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as a medium, reads the files back, and profiles them."""
    return profile_media(store_texts(docs, id_col, text_col))
