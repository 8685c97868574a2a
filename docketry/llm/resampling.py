"""Target-distribution importance resampling (op 11): hashed n-gram counts of a corpus and of a target, and a draw without
replacement by log weights plus Gumbel noise.

Separators collapse to single spaces; then one overlapped regex scan, between a space and a space ahead, gives at each word the
spans of all runs that begin there, and each span's bytes are counted by CRC-32. A document's buckets are stored once, as packed
numbers; the corpus counts and the weights are both taken from there, so each text is scanned once.

A bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) for s of S features of the corpus, t of T of the target, and B
buckets; a document's weight is the floored mean of its features' gains; noise follows a hash of seed and id. Of the documents
with at least `least_words` words the given percentage with the highest scores is drawn.

Cases: null and empty texts have no features and weight 0; a null id is hashed as an empty text and sorts last among ties; ties
go to the smaller id, then to the smaller hash of the text; repeated rows are rows of their own; an empty corpus gives an empty
result, an empty target t = T = 0; other columns are ignored. Long texts pass as streams of spans.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ASCII_LOWER, ASCII_UPPER, discard, ranked, small_batches, stored

#: Separators (all ASCII that is no letter and no digit) as blanks, A-Z in lower case.
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256)).translate(bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode()))


def run_pattern(runs: int):
    """At each word: group 1 is the longest run of up to `runs` words, each further group one with a word less."""
    import regex

    p = rb"[^ ]++(?= )"
    for _ in range(runs - 1):
        p = rb"(" + p + rb")(?: [^ ]++(?= ))?"
    return regex.compile(rb" (" + p + rb")")


def crcs_of(text: str | None, pattern, runs: int) -> tuple[int, np.ndarray]:
    """The number of words, and the CRC-32 of all runs of 1 to `runs` words, repeats included."""
    flat = b" %s " % b" ".join((text or "").encode().translate(_FOLD).split())
    crc, found = zlib.crc32, array("I")
    found.extend(crc(flat[a:b]) for m in pattern.finditer(flat, overlapped=True) for a, b in m.regs[1:])
    every = np.frombuffer(found, np.uint32).reshape(-1, runs) if len(found) else np.zeros((0, runs), np.uint32)
    n = len(every)
    # Column i is for runs of runs - i words; towards the end of the text there are fewer words left.
    return n, np.concatenate([every[: max(0, n - (runs - i) + 1), i] for i in range(runs)])


def scan_features(docs: DataFrame, runs: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, b (the features' buckets as packed 32- or 16-bit numbers, sorted)."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = run_pattern(runs)
        for b in batches:
            found = [crcs_of(t, pattern, runs) for t in b.column(2).to_pylist()]
            packed = [np.sort((c % buckets).astype(kind)).tobytes() for _, c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([len(c) for _, c in found], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "n_words", "n_features", "b"])

    return d.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, b binary")


def bucket_counts(scanned: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket: a task counts its own rows, and one row a bucket reaches the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    counts = [0] * buckets
    for r in scanned.select("b").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    big, small, n = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((t + 1) * (big + n) / ((s + 1) * (small + n)))) for s, t in zip(corpus, target, strict=True)]


def noise(seed: int, doc_id: int | None) -> int:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(scanned: DataFrame, gains: list[int], seed: int) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score."""
    kind = "<u2" if len(gains) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, np.int64)
        for b in batches:
            weight = [int(gain[x].sum()) // len(x) if len(x) else 0 for x in (np.frombuffer(v.as_buffer(), kind) for v in b.column(4))]
            score = [w + noise(seed, i) for w, i in zip(weight, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    return scanned.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, runs: int = 2, buckets: int = 10_000, seed: int = 7, percent: int = 25, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score of every row, and rank: 1, 2, ... of those drawn, else null."""
    scanned = stored(scan_features(docs, runs, buckets, id_col, text_col), "features")
    wanted = scan_features(target.withColumn(target_id, F.lit(None).cast("long")), runs, buckets, target_id, target_text)
    gains = bucket_gains(bucket_counts(scanned, buckets), bucket_counts(wanted, buckets))
    able = F.col("n_words") >= least_words
    order = [(~able).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("text_hash").asc()]
    scored = ranked(weigh(scanned, gains, seed), order, "scored")
    discard(scanned)
    drawn = scored.where(able).count() * percent // 100
    rank = F.when(able & (F.col("_rank") < drawn), F.col("_rank") + 1)
    return scored.withColumn("rank", rank.cast("long")).drop("_rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are drawn, as they came; of rows with one id and one text as many as were drawn."""
    from pyspark.sql import Window

    from docketry.llm.common import join_rows, rows_of, with_keys

    key = ["doc_id", "text_hash"]
    r = resample(docs, target, id_col=id_col, text_col=text_col, **options).groupBy(*key).agg(F.count("rank").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0")
    d = join_rows(with_keys(docs, doc_id=F.col(id_col).cast("long"), text_hash=F.xxhash64(F.col(text_col))), r, key, "inner")
    # Only where not all of some equal rows are drawn is their order needed.
    part = d.where("n < rows").withColumn("turn", F.row_number().over(Window.partitionBy(*key).orderBy("text_hash"))).where("turn <= n").drop("turn")
    return rows_of(d.where("n = rows").unionByName(part))
