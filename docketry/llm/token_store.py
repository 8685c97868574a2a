"""Token-ID / binary output (op 1): one concatenated id array in blocks, with Elias-Fano coded document boundaries.

A store is a Parquet folder with one row per block. A block holds its ids (unsigned 16 or 32 bit, little endian),
the end offsets of its documents and their doc_ids, both Elias-Fano coded: about 2 + log2(ids per document) bits a
document instead of a table of 64-bit offsets. Blocks are in ascending doc_id order: by (part, block).

Cases: null text is an empty document (only its end id); null doc_id sorts first and comes back as null; equal
doc_ids keep all their rows, ordered by text; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import scratch_path, small_batches


class EliasFano:
    """A rising sequence of non-negative integers in near-minimal space; select(i) by sampled unary high bits."""

    SAMPLE = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64) if len(high) else np.zeros(0, np.int64)
        # For each SAMPLE-th one: the byte that holds it, and the ones before that byte.
        at = np.searchsorted(ones, np.arange(0, n, self.SAMPLE), side="right") if n else np.zeros(0, np.int64)
        self._byte, self._before = at, np.where(at > 0, ones[at - 1], 0) if n else at

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        high = np.zeros(int(v[-1] >> np.uint64(low_bits)) + n, np.uint8)
        high[(v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        return cls(n, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"))

    def _low(self, i: int) -> int:
        a = i * self.low_bits
        raw = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8].tobytes(), "little")
        return (raw >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, without decoding the rest."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, before = int(self._byte[i // self.SAMPLE]), int(self._before[i // self.SAMPLE])
        while before + (k := int(self.high[byte]).bit_count()) <= i:
            before, byte = before + k, byte + 1
        x = int(self.high[byte])
        for _ in range(i - before):
            x &= x - 1
        place = byte * 8 + (x & -x).bit_length() - 1
        return ((place - i) << self.low_bits) | self._low(i)

    def decode(self) -> np.ndarray:
        """All values, as int64."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low)], "<u4").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, k = np.frombuffer(raw, "<u4", 3).tolist()
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, k, 12), np.frombuffer(raw, np.uint8, offset=12 + k))


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct chunk of text once as long as it stays in a bounded table.

    Chunks are cut before a blank or line feed that follows a non-blank. A byte-level pre-tokenizer cuts there too and
    never looks further, so the ids of a text are those of its chunks in turn; other tokenizers encode whole texts.
    """

    #: Entries of the table of known chunks; when it is full, only those met again and again stay. Bounds memory only: ids never depend on it.
    KNOWN = 1_200_000
    _odd = re.compile(r"\s[ \n]")
    _cut = re.compile(r"(?<=\S)(?=[ \n])")
    #: A run of Latin letters, then nothing or an ASCII mark or digit: a pre-tokenizer cuts between the two.
    _word = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([\x21-\x40\x5B-\x60\x7B-\x7E].*)?", re.S)

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # a text never yields control ids
        self.dtype = "<u2" if self.model.get_vocab_size() <= 65536 else "<u4"
        kind = repr(self.model.pre_tokenizer)
        self.cut = kind.startswith("ByteLevel(") and "add_prefix_space=False" in kind and "use_regex=True" in kind and self.model.normalizer is None
        if self.cut:
            alphabet = _byte_alphabet()
            self.width = np.zeros(self.model.get_vocab_size(), np.int64)
            for token, i in self.model.get_vocab().items():
                self.width[i] = len(token) if all(ch in alphabet for ch in token) else len(token.encode())
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.turn = 0

    def _chunks(self, text: str) -> list[str]:
        """Keys of chunks: without the blank that they begin with; a chunk as it stands has a blank before it."""
        if self._odd.search(text):
            return [p[1:] if p[:1] == " " and p[1:2].strip() else " " + p for p in self._cut.split(text)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = " " + parts[0]
        return parts

    def _learn(self, new: set[str]) -> None:
        """Encodes new chunks: words joined to long texts, whose ids are cut by the tokens' widths in bytes; marks after words apart."""
        pairs, words, apart = [], set(), []
        for k in new:
            m = self._word.fullmatch(k)
            if m:
                words.add(m[1])
                if m[2]:
                    pairs.append((k, m[1], " " + m[2]))
            else:
                apart.append(k)
        known = self.known
        for k in {*apart, *(p[2] for p in pairs)}.difference(known):
            whole = k[1:] if k[:1] == " " else k if k[:1] == "\n" else " " + k
            known[k] = np.array(self.model.encode(whole, add_special_tokens=False).ids, self.dtype).tobytes()
        rest = list(words.difference(known))
        groups = [rest[i : i + 2048] for i in range(0, len(rest), 2048)]
        texts = [" " + " ".join(g) for g in groups]
        w = np.dtype(self.dtype).itemsize
        for group, text, e in zip(groups, texts, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            starts = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)
            at = [*(w * np.searchsorted(np.cumsum(self.width[ids]), starts, side="right")).tolist(), w * len(ids)]
            packed = ids.astype(self.dtype).tobytes()
            known.update(zip(group, [packed[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        known.update([(k, known[word] + known[tail]) for k, word, tail in pairs])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cut:
            return [np.array(e.ids, self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self._chunks(t) if t else [] for t in texts]
        seen = set().union(*parts)
        new = seen.difference(self.known)
        if self.turn % 8 == 0:  # enough to tell common chunks
            self.again.update(self.known.keys() & seen)
        self.turn += 1
        if len(self.known) + len(new) > self.KNOWN:  # keep those met again
            self.known = {k: self.known[k] for k in (self.again if len(self.again) < self.KNOWN // 2 else ())}
            self.again = set()
            new = seen.difference(self.known)
        self._learn(new)
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


def _byte_alphabet() -> set[str]:
    """The printable stand-ins of byte-level vocabularies, one character a byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in kept} | {chr(256 + i) for i in range(256 - len(kept))}


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


BLOCK_SCHEMA = "part int, block int, start_in_part long, n_docs int, n_null int, n_tokens long, unit int, first_id long, last_id long, ids binary, ends binary, doc_ids binary"


def _pack(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        unit, block, start = np.dtype(enc.dtype).itemsize, 0, 0
        keys: list[int | None] = []
        rows: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            ends = np.cumsum([len(r) // unit for r in rows], dtype=np.int64)
            named = np.array([k for k in keys if k is not None], np.int64)
            first, final = (int(named[0]), int(named[-1])) if len(named) else (None, None)
            row = [part, block, start, len(keys), len(keys) - len(named), int(ends[-1]), unit, first, final, b"".join(rows), EliasFano.encode(ends).to_bytes(), EliasFano.encode(named.view(np.uint64) - np.uint64(named[:1].view(np.uint64)[0]) if len(named) else named).to_bytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
            block, start, held = block + 1, start + row[5], 0
            keys.clear()
            rows.clear()
            return out

        for b in batches:
            for k, r in zip(b.column(0).to_pylist(), enc.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                keys.append(k)
                rows.append(r + end)
                held += len(r) // unit + 1
                if held >= block_ids:
                    yield flush()
        if keys:
            yield flush()

    return run


def write_store(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_ids: int = 1 << 20) -> str:
    """Encodes docs and writes the store, in ascending id_col order. One range shuffle of the texts; blocks never span tasks."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    d = d.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    d.mapInArrow(_pack(tokenizer_path, end_id, block_ids), BLOCK_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            c = {n: b.column(n)[i] for n in b.schema.names}
            ids = np.frombuffer(c["ids"].as_buffer(), {2: "<u2", 4: "<u4"}[c["unit"].as_py()])
            ends = EliasFano.from_bytes(c["ends"].as_py()).decode()
            starts = np.concatenate([[0], ends[:-1]])
            wide = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(wide[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
            first, gaps = c["first_id"].as_py(), EliasFano.from_bytes(c["doc_ids"].as_py()).decode()
            keys = [None] * c["n_null"].as_py() + [first + g for g in gaps.tolist()]
            base = c["base"].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def _with_base(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with `base`, the ids of all blocks before them. Only one total per write task is broadcast."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).select(*names)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_base"))
    return blocks.join(F.broadcast(parts), "part").withColumn("base", F.col("_base") + F.col("start_in_part")).drop("_base")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    return _with_base(spark, path).mapInArrow(_unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _find(wanted: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []
            for i in range(b.num_rows):
                c = {n: b.column(n)[i] for n in b.schema.names}
                ids = np.frombuffer(c["ids"].as_buffer(), {2: "<u2", 4: "<u4"}[c["unit"].as_py()])
                ends, keys = EliasFano.from_bytes(c["ends"].as_py()), EliasFano.from_bytes(c["doc_ids"].as_py())
                first, last, nulls, base = (c[n].as_py() for n in ("first_id", "last_id", "n_null", "base"))
                for w in wanted:
                    if not first <= w <= last:
                        continue
                    at = bisect.bisect_left(range(keys.n), w - first, key=keys.select)
                    while at < keys.n and keys.select(at) == w - first:
                        d = nulls + at
                        start = ends.select(d - 1) if d else 0
                        out.append((w, base + start, ids[start : ends.select(d)].tolist()))
                        at += 1
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return run


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, start, ids of the documents with one of a few doc_ids: blocks are pruned by their range of doc_ids, and the
    document and its bounds are found in them by select, without decoding the rest."""
    wanted = sorted(set(doc_ids))
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.lit(w).between(F.col("first_id"), F.col("last_id"))
    return _with_base(spark, path).where(hit).mapInArrow(_find(wanted), "doc_id long, start long, ids array<long>")


def token_output(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Writes docs as a store (in the shared folder unless path is given) and returns what the files hold."""
    spark = docs.sparkSession
    return read_store(spark, write_store(docs, tokenizer_path, path or scratch_path(spark, "tokens"), **options))
