"""SimHash near-dedup (op 3): fingerprints by majority of shingle hashes, linked by a Gray-order hierarchical index.

Distinct fingerprints are dealt to buckets by bit masks: with `exact` masks two fingerprints that differ in at most k bits
share a bucket for certain (of k + 2 runs of bits at least two agree). In each bucket fingerprints are sorted by Gray
rank, so neighbours share long bit patterns; groups of neighbours become leaves, whose common masked pattern is
factored into upper nodes, and a pair of nodes is dropped as soon as the bits in which their patterns differ exceed k.
Buckets that hold too many fingerprints for one task are dealt anew by finer masks (of k + 1 runs of the bits not yet
used, one must agree), so a third of all rows in one bucket is spread, and no link is lost.

Each bucket reports a spanning forest of its links, not all pairs; components run over distinct fingerprints only.

Cases: null or empty text has fingerprint 0, linked like any other; equal texts share a fingerprint and are never paired
with each other; null doc_id is never a component's smallest unless all are null; repeated rows come back as often;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ASCII_LOWER, ASCII_UPPER, SPACE_WORD, discard, rows_of, small_batches, stored, with_keys
from docketry.llm.components import connected_components

_WORDS = re.compile(SPACE_WORD.encode())
_FOLD = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
#: For each byte value its 8 bits, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Distinct fingerprints that one task compares in a bucket; larger buckets are dealt anew.
BUCKET = 8192
#: Fingerprints in a leaf, and children of an upper node.
FAN = 32


def shingle_hashes(text: str | None, shingle: int, bits: int) -> np.ndarray:
    """A row of bits / 8 bytes for each shingle: XXH64 with seed 42 for 64 bits, else XXH3-128 with that seed."""
    import xxhash

    words = _WORDS.findall((text or "").encode().translate(_FOLD))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(words) else ends
    n = min(shingle, len(words))
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True) if n else ()
    if bits == 64:
        h = xxhash.xxh64_intdigest
        return np.array([h(joined[a:b], 42) for a, b in spans], "<u8").view(np.uint8).reshape(-1, 8)
    d = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([d(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 16)


def fingerprint(text: str | None, shingle: int = 4, bits: int = 64) -> tuple[int, ...]:
    """The fingerprint as 64-bit words, lowest first: a bit is 1 if it is in over half of the hashes."""
    return _majority(shingle_hashes(text, shingle, bits), bits)


def _majority(h: np.ndarray, bits: int) -> tuple[int, ...]:
    k = bits // 8
    if not len(h):
        return (0,) * (bits // 64)
    counts = np.bincount((h + np.arange(k) * 256).ravel(), minlength=k * 256).reshape(k, 256)
    ones = (counts @ _BITS).ravel() * 2 > len(h)
    return tuple(np.packbits(ones, bitorder="little").view("<u8").tolist())


def fingerprints(docs: DataFrame, shingle: int = 4, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp (array of bits / 64 longs) for every row."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, shingle, bits) for t in b.column(2).to_pylist()], np.uint64).view(np.int64).ravel()
            w = bits // 64
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(f) + 1, w), pa.int32()), pa.array(f))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["doc_id", "text_hash", "fp"])

    return d.mapInArrow(run, "doc_id long, text_hash long, fp array<long>")


# --- bit masks that deal fingerprints to buckets ---


def _runs(places: list[int], n: int) -> list[list[int]]:
    """The places in n runs of even length."""
    at = [round(i * len(places) / n) for i in range(n + 1)]
    return [places[a:b] for a, b in zip(at, at[1:], strict=False)]


def exact_masks(bits: int, k: int) -> list[list[int]]:
    """Pairs of k + 2 runs: k differing bits spoil at most k runs, so two agree."""
    return [a + b for a, b in itertools.combinations(_runs(list(range(bits)), k + 2), 2)]


def finer_masks(bits: int, k: int, used: list[int]) -> list[list[int]]:
    """The used places with one of k + 1 runs of the rest."""
    rest = [i for i in range(bits) if i not in set(used)]
    return [used + r for r in _runs(rest, k + 1) if r]


def sampled_masks(bits: int, tables: int, width: int, seed: int = 5) -> list[list[int]]:
    """Random places, as many in each table; near fingerprints share some table's bucket with a probability that tests measure."""
    r = np.random.default_rng(seed)
    return [sorted(r.choice(bits, width, replace=False).tolist()) for _ in range(tables)]


def finer_sampled(bits: int, tables: int, width: int, used: list[int], seed: int = 6) -> list[list[int]]:
    rest = [i for i in range(bits) if i not in set(used)]
    r = np.random.default_rng(seed)
    return [used + sorted(r.choice(rest, min(width, len(rest)), replace=False).tolist()) for _ in range(tables if len(rest) > width else 1)] if rest else []


def _words(places: list[int], w: int) -> list[int]:
    """The places as a mask in w signed longs."""
    masks = [sum(1 << (p - 64 * i) for p in places if 64 * i <= p < 64 * i + 64) for i in range(w)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


# --- the index within a bucket ---


def _differ(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    x = a ^ b if mask is None else (a ^ b) & mask
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after the links a-b join the given components."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
    return label


def _crossed(a: np.ndarray, b: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes a, each with each child of b."""
    na, nb = end[a] - begin[a], end[b] - begin[b]
    of = np.repeat(np.arange(len(a)), na * nb)
    at = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    i, j = np.divmod(at, nb[of])
    return i + begin[a][of], j + begin[b][of]


def gray_pairs(fp: np.ndarray, k: int, starts: np.ndarray | None = None, worth=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """fp: (n, w) fingerprints, in Gray order in each of the buckets that begin at `starts` (None: one bucket). Blocks of the pairs
    i < j of one bucket that differ in at most k bits, and of that number. `worth` tells which pairs of leaves are worth comparing."""
    first = np.zeros(1, np.int64) if starts is None else starts
    # Levels of nodes, none across buckets: their children, the mask of the bits all members share, and those bits.
    levels = []
    low = high = fp
    while not levels or len(low) > len(first):
        nodes = -(-np.diff(first, append=len(low)) // FAN)
        top = np.cumsum(nodes) - nodes
        begin = np.repeat(first, nodes) + (np.arange(nodes.sum()) - np.repeat(top, nodes)) * FAN
        end = np.append(begin[1:], len(low))
        low, high = np.bitwise_and.reduceat(low, begin, axis=0), np.bitwise_or.reduceat(high, begin, axis=0)
        levels.append((begin, end, ~(low ^ high), low))
        first = top
    a = b = np.arange(len(first))
    for depth, (begin, end, mask, value) in reversed(list(enumerate(levels))):
        kept = _differ(value[a], value[b], mask[a] & mask[b]) <= k
        a, b = a[kept], b[kept]
        if depth:
            a, b = _crossed(a, b, begin, end)
            a, b = a[a <= b], b[a <= b]
    step = np.cumsum((end[a] - begin[a]) * (end[b] - begin[b])) >> 18
    cut = np.flatnonzero(np.diff(step)) + 1
    for x, y in zip(np.split(a, cut), np.split(b, cut), strict=True):
        if worth is not None:
            on = worth(x, y)
            x, y = x[on], y[on]
        i, j = _crossed(x, y, begin, end)
        i, j = i[i < j], j[i < j]
        d = _differ(fp[i], fp[j])
        yield i[d <= k], j[d <= k], d[d <= k]


def gray_components(fp: np.ndarray, k: int) -> np.ndarray:
    """fp: (n, w) distinct fingerprints in Gray order. Returns for each the first one of its component under links of at most k bits."""
    n = len(fp)
    label = np.arange(n)
    near = np.flatnonzero(_differ(fp[1:], fp[:-1]) <= k) if n > 1 else np.zeros(0, int)
    label = _roots(n, near, near + 1, label)
    if n <= 2:
        return label

    def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Two leaves that are one component already have nothing to add."""
        lo, hi = np.minimum.reduceat(label, np.arange(0, n, FAN)), np.maximum.reduceat(label, np.arange(0, n, FAN))
        return ~((lo[x] == hi[x]) & (lo[y] == hi[y]) & (lo[x] == lo[y]))

    for i, j, _ in gray_pairs(fp, k, worth=apart):
        label = _roots(n, i, j, label)
    return label


def _gray_ordered(x: DataFrame, w: int, *then: str) -> DataFrame:
    """x (table, key, f0.. and more) dealt by bucket, and in it by the Gray rank of the fingerprints, then by the columns `then`."""
    columns, x = x.columns, x.repartition("table", "key")
    for i in range(w):  # the Gray rank of each word, by prefix xor
        g = F.col(f"f{i}")
        for s in (1, 2, 4, 8, 16, 32):
            x = x.withColumn(f"g{i}", g.bitwiseXOR(F.shiftrightunsigned(g, s)))
            g = F.col(f"g{i}")
    return x.sortWithinPartitions("table", "key", *[f"g{i}" for i in range(w - 1, -1, -1)], *then).select(*columns)


def _link(w: int, k: int, bucket: int):
    """Runs of one bucket, in Gray order -> rows: links (a, b) of a spanning forest, or the members of a bucket to deal anew."""

    def work(table: int, fp: np.ndarray, out: list) -> None:
        label = gray_components(fp, k)
        kid = np.flatnonzero(label != np.arange(len(fp)))
        if len(kid):
            # Each member links to the one before it in its component, so no fingerprint gets very many links.
            order = np.lexsort((np.arange(len(fp)), label))
            prev, cur = order[:-1], order[1:]
            same = label[prev] == label[cur]
            out.append((np.full(same.sum(), -1, np.int32), fp[prev[same]], fp[cur[same]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size, now, hot = 0, None, False

        def rows(out: list) -> pa.RecordBatch:
            t = np.concatenate([o[0] for o in out]) if out else np.zeros(0, np.int32)
            x = [np.concatenate([o[i] for o in out]) if out else np.zeros((0, w), np.uint64) for i in (1, 2)]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, w), pa.int32()), pa.array(np.ascontiguousarray(v).view(np.int64).ravel())) for v in x]
            return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), *lists], names=["table", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = []
            table, key = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            fp = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(w)], axis=1)
            cut = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
                this = (int(table[a]), int(key[a]))
                if this != now:
                    if not hot and size > 1:
                        work(now[0], np.concatenate(kept), out)
                    kept, size, now, hot = [], 0, this, False
                kept.append(fp[a:b])
                size += b - a
                if hot or size > bucket:
                    hot = True
                    x = np.concatenate(kept)
                    out.append((np.full(len(x), this[0], np.int32), x, x))
                    kept = []
            yield rows(out)
        out = []
        if not hot and size > 1:
            work(now[0], np.concatenate(kept), out)
        yield rows(out)

    return run


def fingerprint_links(fps: DataFrame, k: int, bits: int = 64, tables: int = 0, width: int = 20, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b: arrays of longs) among the distinct fps(fp) that differ in at most k bits, enough to connect them.

    tables = 0: exact masks. Otherwise so many sampled ones of `width` bits, for k too large for exact ones."""
    spark, w, links = fps.sparkSession, bits // 64, None
    # (table that a bucket came from, places of the mask)
    level = [(0, p) for p in (sampled_masks(bits, tables, width) if tables else exact_masks(bits, k))]
    todo = fps.select(F.lit(0).alias("parent"), "fp")
    while level:
        rows = [(parent, t, *_words(p, w)) for t, (parent, p) in enumerate(level)]
        masks = spark.createDataFrame(rows, ", ".join(["parent int", "table int", *[f"m{i} long" for i in range(w)]]))
        x = todo.join(F.broadcast(masks), "parent")  # as many rows as there are masks, a number fixed by bits and k
        word = [F.element_at("fp", i + 1) for i in range(w)]
        key = F.xxhash64("table", *[word[i].bitwiseAND(F.col(f"m{i}")) for i in range(w)])
        x = x.select("table", key.alias("key"), *[word[i].alias(f"f{i}") for i in range(w)])
        x = _gray_ordered(x, w)
        found = stored(x.mapInArrow(_link(w, k, bucket), "table int, a array<long>, b array<long>"), "found")
        part = found.where("table < 0").select("a", "b")
        links = part if links is None else links.unionByName(part)
        hot = sorted(r[0] for r in found.where("table >= 0").select("table").distinct().collect())  # numbers of masks, not rows
        finer = (lambda used: finer_sampled(bits, 16, 8, used)) if tables else (lambda used: finer_masks(bits, k, used))
        level = [(t, p) for t in hot for p in finer(level[t][1])]
        todo = found.where("table >= 0").select(F.col("table").alias("parent"), F.col("a").alias("fp"))
    return links


def near_duplicates(docs: DataFrame, shingle: int = 4, k: int = 4, bits: int = 64, tables: int = 0, width: int = 20, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id for every row: the smallest doc_id that links reach, its own included."""
    f = fingerprints(docs, shingle, bits, id_col, text_col)
    # One long stands for a fingerprint: itself, or the number of a wider one in the stored table.
    f = stored(f, "fingerprints")
    classes = f.groupBy("fp").agg(F.min("doc_id").alias("first"))
    if bits == 64:
        classes = stored(classes.withColumn("node", F.element_at("fp", 1)), "classes")
    else:
        classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # fixed once it is stored
    links = fingerprint_links(classes, k, bits, tables, width, bucket)
    if bits == 64:
        links = links.select(F.element_at("a", 1).alias("a"), F.element_at("b", 1).alias("b"))
    else:
        of = classes.select("fp", "node")
        links = links.join(of.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(of.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    found = connected_components(links)
    found = stored(found.join(classes.select("node", "first"), "node"), "members")
    least = found.groupBy("root").agg(F.min("first").alias("least"))
    of = found.join(least, "root").select("node", "least")
    of = classes.join(of, "node", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return f.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id")


def _place(id_col: str, text_col: str) -> Column:
    """What tells different rows apart. In a struct null equals null, so that a join and a dropDuplicates share one shuffle."""
    return F.struct(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"))


def _place_of(s: str) -> Column:
    """A stored place s in the type that _place gives; else a cast of the join's key would cost the shuffle that is to be shared."""
    return F.struct(F.col(f"{s}.doc_id").alias("doc_id"), F.coalesce(f"{s}.text_hash", F.lit(0)).alias("text_hash"))


# --- links confirmed by the texts' shingle sets ---


def shingle_set(text: str | None, shingle: int, bits: int) -> np.ndarray:
    """The distinct shingle hashes, ordered by their lowest 64 bits, which stand for them."""
    h = shingle_hashes(text, shingle, bits)
    return h[np.unique(np.ascontiguousarray(h[:, :8]).view("<u8").ravel(), return_index=True)[1]]


#: Longs of a sketch: one bit of each of 64 times as many minima of hash functions over a shingle set. Two sets of similarity s
#: agree in a bit with probability s + (1 - s) / 2. The first round compares FEW of them, the second all.
SKETCH, FEW = 16, 4
_ODD, _ADD = (np.random.default_rng(9).integers(0, 1 << 63, 64 * SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.random.default_rng(10).integers(0, 1 << 63, 64 * SKETCH, dtype=np.uint64))


def sketch(h: np.ndarray) -> np.ndarray:
    """The sketch of distinct 64-bit hashes, in blocks of bounded memory; without any, no bit is set."""
    low = np.full(len(_ODD), np.iinfo(np.uint64).max)
    for i in range(0, len(h), 1024):
        np.minimum(low, (h[i : i + 1024, None] * _ODD + _ADD).min(0), out=low)
    return np.packbits((low >> np.uint64(17)).astype(np.uint8) & 1 if len(h) else np.zeros(len(_ODD), np.uint8), bitorder="little").view(np.uint64)


def least_agreeing(near: float, longs: int, deviations: float) -> int:
    """Bits in which two sets of similarity `near` agree at least, but for those so many standard deviations below the mean."""
    n, p = 64 * longs, near + (1 - near) / 2
    return int(np.floor(n * p - deviations * np.sqrt(n * p * (1 - p))))


def _set_fingerprints(docs: DataFrame, shingle: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set), n (its size), fp (majority over the set), sk (its sketch) for every row."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        w = bits // 64
        for b in batches:
            sets = [shingle_set(t, shingle, bits) for t in b.column(2).to_pylist()]
            f = np.array([_majority(h, bits) for h in sets], np.uint64).view(np.int64).ravel()
            node = np.array([xxhash.xxh3_64_intdigest(np.ascontiguousarray(h[:, :8]).tobytes(), 42) for h in sets], np.uint64).view(np.int64)
            sk = np.array([sketch(np.ascontiguousarray(h[:, :8]).view("<u8").ravel()) for h in sets], np.uint64).view(np.int64).ravel()
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, k), pa.int32()), pa.array(v)) for v, k in ((f, w), (sk, SKETCH))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array([len(h) for h in sets], pa.int32()), *lists], names=["doc_id", "text_hash", "node", "n", "fp", "sk"])

    return d.mapInArrow(run, "doc_id long, text_hash long, node long, n int, fp array<long>, sk array<long>")


def _set_of(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """node, s (distinct shingle hashes as longs) of docs(node, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.ascontiguousarray(shingle_set(t, shingle, bits)[:, :8]).view("<i8").ravel() for t in b.column(1).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            values = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["node", "s"])

    return docs.select("node", "text").mapInArrow(run, "node long, s array<long>")


#: By how many standard deviations sketches may agree less than expected: of sets of SHORT shingles or more in the first round and
#: in the second (0.966 and 0.971 of pairs at the threshold agree so well), and of smaller sets, whose bits catch fewer pairs.
LONG_DEVIATIONS, SHORT_DEVIATIONS, SHORT = (1.83, 1.9), 3.4, 32
#: A bucket with over so many candidates a member first gives one a member, the most alike; the rest follow, between components.
DENSE = 2


def _candidates(w: int, m: int, k: int, long: tuple[int, int] | None, near: float, bucket: int, dense: int | None, masks: list[tuple]):
    """Rows (table, key, node, n, f0.., s0.., and label, or the node is its label) by table, key and Gray rank -> rows (kind, a, b).

    kind -1: nodes a and b of different labels differ in at most k bits (of sets of long[0] or more long[1], if it is given),
    their sizes allow a similarity of `near`, and their sketches (m longs) agree as sets of that similarity do.
    kind -2 - t: node a is in the dense bucket b of table t. kind >= 0: node a is in a bucket of that table to be dealt anew.
    dense = None: every pair of every bucket is given, whatever its size.

    masks: for each table its words, the first table of its level, and whether none of its buckets is dealt anew. A pair is
    given by the first bucket of its level that both are in, not by later ones; one that is dealt anew does not count as such."""
    names = ["kind", "a", "b"]
    agree, agree_short = least_agreeing(near, m, LONG_DEVIATIONS[m > FEW]), least_agreeing(near, m, SHORT_DEVIATIONS)
    since = np.array([first for _, first, _ in masks])

    def batch_of(kind, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(a)).copy()), pa.array(a), pa.array(b)], names=names)

    def earlier(x: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs meet in a table before their own, too."""
        own, differ, met = x["table"][i], x["fp"][i] ^ x["fp"][j], np.zeros(len(i), bool)
        for t, (mask, _, whole) in enumerate(masks[: own.max(initial=0)]):
            if whole:
                met |= ~(differ & np.array(mask).astype(np.uint64)).any(1) & (t < own) & (t >= since[own])
        return met

    def close(x: dict, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The candidates of pairs that differ in d <= k bits, and in how many bits their sketches agree."""
        least, most = np.minimum(x["n"][i], x["n"][j]), np.maximum(x["n"][i], x["n"][j])
        ok = (x["label"][i] != x["label"][j]) & (least >= near * most)
        if long:
            ok &= (d <= long[1]) | (least < long[0])
        i, j, least = i[ok], j[ok], least[ok]
        alike = 64 * m - _differ(x["sk"][i], x["sk"][j])
        ok = alike >= np.where(least < SHORT, agree_short, agree)
        i, j, alike = i[ok], j[ok], alike[ok]
        ok = ~earlier(x, i, j)
        return i[ok], j[ok], alike[ok]

    def work(x: dict) -> Iterator[pa.RecordBatch]:
        """x holds whole buckets."""
        starts, sizes = buckets(x)
        if dense is not None and (sizes > bucket).any():
            rows = np.repeat(sizes > bucket, sizes)
            yield batch_of(x["table"][rows], x["node"][rows], x["node"][rows])
            x = {c: v[~rows] for c, v in x.items()}
            starts, sizes = buckets(x)
        if not len(starts):
            return
        of, count, kept = np.repeat(np.arange(len(starts)), sizes), np.zeros(len(starts), np.int64), []
        first, best = np.full(len(of), -1), np.full(len(of), -1)  # the most alike partner before it, and how alike
        for i, j, d in gray_pairs(x["fp"], k, starts):
            i, j, alike = close(x, i, j, d)
            if not len(i):
                continue
            if dense is None:
                yield batch_of(-1, x["node"][i], x["node"][j])
                continue
            order = np.lexsort((x["node"][i], -alike, j))
            top = order[np.unique(j[order], return_index=True)[1]]
            top = top[alike[top] > best[j[top]]]
            first[j[top]], best[j[top]] = i[top], alike[top]
            count += np.bincount(of[i], minlength=len(count))
            few = (count <= dense * sizes)[of[i]]
            kept.append((i[few], j[few]))
        if not kept:
            return
        full = (count > dense * sizes)[of]
        i, j = (np.concatenate(c) for c in zip(*kept, strict=True))
        i, j = i[~full[i]], j[~full[i]]
        yield batch_of(-1, x["node"][i], x["node"][j])
        yield batch_of(-2 - x["table"][full], x["node"][full], x["key"][full].astype(np.int64))
        j = np.flatnonzero(full & (first >= 0))
        yield batch_of(-1, x["node"][first[j]], x["node"][j])

    def buckets(x: dict) -> tuple[np.ndarray, np.ndarray]:
        """Where they start, and their sizes."""
        new = np.ones(len(x["key"]), bool)
        new[1:] = (x["table"][1:] != x["table"][:-1]) | (x["key"][1:] != x["key"][:-1])
        starts = np.flatnonzero(new)
        return starts, np.diff(starts, append=len(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None  # rows of the last bucket so far; the bucket whose rows pass through
        for batch in batches:
            if not batch.num_rows:
                continue
            c = [v.to_numpy(zero_copy_only=False) for v in batch.columns]
            x = dict(zip(["table", "key", "node", "n"], c, strict=False)) | {name: np.stack([f.view(np.uint64) for f in c[a:b]], axis=1) for name, a, b in (("fp", 4, 4 + w), ("sk", 4 + w, 4 + w + m))}
            x["label"] = c[4 + w + m] if len(c) > 4 + w + m else x["node"]
            if held is not None:
                x = {m: np.concatenate([held[m], x[m]]) for m in x}
                held = None
            if hot is not None:
                same = (x["table"] == hot[0]) & (x["key"] == hot[1])
                yield batch_of(hot[0], x["node"][same], x["node"][same])
                x = {m: v[~same] for m, v in x.items()}
                if not len(x["key"]):
                    continue
                hot = None
            last = (x["table"] == x["table"][-1]) & (x["key"] == x["key"][-1])
            at = len(last) - int(last.sum())
            if at:
                yield from work({m: v[:at] for m, v in x.items()})
            held = {m: v[at:] for m, v in x.items()}
            if dense is not None and len(held["key"]) > bucket:
                hot = (held["table"][0], held["key"][0])
                yield batch_of(hot[0], held["node"], held["node"])
                held = None
        if held is not None and len(held["key"]) > 1:
            yield from work(held)

    return run


def _candidate_rows(x: DataFrame, w: int, m: int, k: int, long: tuple[int, int] | None, near: float, bucket: int, dense: int | None, masks: list[tuple], name: str) -> DataFrame:
    """x: table, key, node, n, fp, sk (of which m longs are used) and perhaps label."""
    spark = x.sparkSession
    x = x.select("table", "key", "node", "n", *[F.element_at("fp", i + 1).alias(f"f{i}") for i in range(w)], *[F.element_at("sk", i + 1).alias(f"s{i}") for i in range(m)], *[c for c in x.columns if c == "label"])
    small_batches(spark, 1 << 15)  # numbers only
    out = stored(_gray_ordered(x, w, "node").mapInArrow(_candidates(w, m, k, long, near, bucket, dense, masks), "kind int, a long, b long"), name)
    small_batches(spark)
    return out


def wide_enough(n: int, tables: int, width: int, bucket: int, differ: float = 24 / 128) -> tuple[int, int]:
    """(tables, width) for n fingerprints: masks as wide as buckets of half the limit need, and as many more of them as keep the
    probability that two texts that differ in such a share of bits meet in some bucket. So only uneven buckets are dealt anew."""
    wide = width
    while n > (bucket << wide) // 2:
        wide += 1
    miss = lambda w: np.log1p(-((1 - differ) ** w))
    return int(np.ceil(tables * miss(width) / miss(wide) - 1e-9)), wide


def similar_groups(docs: DataFrame, near: float, shingle: int = 5, k: int = 22, bits: int = 128, tables: int = 64, width: int = 20, finer: tuple[int, int] = (16, 8), long: tuple[int, int] | None = None, bucket: int = BUCKET, dense: int = DENSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id as near_duplicates gives them, where a link is a Jaccard similarity of shingle sets of `near` or more.

    Candidates are the pairs of distinct sets that share a bucket, differ in at most k bits (long: _candidates) and agree in their
    sketches, which rule out most of what is less similar before it is listed; all of them are compared by their sets, unless other
    links join them already. fp is the hash that stands for the whole component."""
    spark, w = docs.sparkSession, bits // 64
    f = stored(_set_fingerprints(docs, shingle, bits, id_col, text_col), "fingerprints")
    classes = stored(f.groupBy("node").agg(F.first("fp").alias("fp"), F.first("sk").alias("sk"), F.first("n").alias("n"), F.min("doc_id").alias("first"), F.first(F.struct("doc_id", "text_hash")).alias("rep")), "classes")

    def paired(x: DataFrame) -> DataFrame:
        return stored(x.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        at = nodes.distinct().join(classes, "node").select("node", _place_of("rep").alias("at"))
        texts = docs.select(_place(id_col, text_col).alias("at"), F.col(text_col).cast("string").alias("text"))
        return stored(_set_of(texts.join(at, "at").dropDuplicates(["at"]), shingle, bits), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return stored(x.where(both >= F.lit(near) * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "confirmed")

    n = classes.count()
    tables, width = wide_enough(n, tables, width, bucket)
    level = [(0, p) for p in sampled_masks(bits, tables, width)]
    todo = classes.select(F.lit(0).alias("parent"), "node", "n", "fp", "sk")
    pairs = thick = None
    done: list[DataFrame] = []
    masks: list[tuple] = []  # of all levels
    while level:
        base = len(masks)
        rows = [(parent, base + t, *_words(p, w)) for t, (parent, p) in enumerate(level)]
        x = todo.join(F.broadcast(spark.createDataFrame(rows, ", ".join(["parent int", "table int", *[f"m{i} long" for i in range(w)]]))), "parent")
        # 32 bits of the key: buckets that share them are compared as one, which loses nothing.
        key = F.hash("table", *[F.element_at("fp", i + 1).bitwiseAND(F.col(f"m{i}")) for i in range(w)])
        x = x.select("table", key.alias("key"), "node", "n", "fp", "sk")
        # Tables with a bucket to be dealt anew: numbers of masks, not rows.
        hot = x.groupBy("table", "key").count().where(F.col("count") > bucket).select("table").distinct() if n > bucket else None
        hot = sorted(r[0] for r in hot.collect()) if hot is not None else []
        masks += [(words, base, t not in hot) for _, t, *words in rows]
        found = _candidate_rows(x, w, FEW, k, long, near, bucket, dense, masks, "candidates")
        pair, dense_rows = found.where("kind = -1").select("a", "b"), found.where("kind < -1").select((-2 - F.col("kind")).alias("table"), F.col("b").alias("key"), F.col("a").alias("node"))
        pairs, thick = (pair, dense_rows) if pairs is None else (pairs.unionByName(pair), thick.unionByName(dense_rows))
        done.append(found)
        level = [(t, p) for t in hot for p in finer_sampled(bits, *finer, level[t - base][1])]
        todo = found.where("kind >= 0").select(F.col("kind").alias("parent"), F.col("a").alias("node")).join(classes.select("node", "n", "fp", "sk"), "node")

    pairs = paired(pairs)
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(thick.select("node")))  # read by both rounds
    links = confirmed(pairs, sets)
    found = stored(connected_components(links), "members")
    if thick.limit(1).count():
        # What is left between the components of dense buckets.
        x = thick.join(classes.select("node", "n", "fp", "sk"), "node").join(found, "node", "left")
        x = x.select("table", "key", "node", "n", F.coalesce("root", "node").alias("label"), "fp", "sk")
        rest = _candidate_rows(x, w, SKETCH, k, long, near, bucket, None, masks, "rest")
        more = paired(rest.select("a", "b"))
        discard(rest)
        again = confirmed(more, sets)
        both, first = stored(connected_components(links.unionByName(again)), "members"), found
        discard(more, again, first)
        found = both
    discard(pairs, sets, links, *done)
    of = classes.join(found, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    of = of.join(least, "root").select("node", "root", "component_id")
    return f.select("doc_id", "text_hash", "node").join(of, "node").select("doc_id", "text_hash", F.array("root").alias("fp"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float | None = None, **options) -> DataFrame:
    """The row of docs with the smallest id of each component (of equal rows one); with `near`, links are confirmed by it."""
    n = near_duplicates(docs, id_col=id_col, text_col=text_col, **options) if near is None else similar_groups(docs, near, id_col=id_col, text_col=text_col, **options)
    # A component that has no id at all is known by its fingerprint.
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp"))
    kept = n.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("m"))
    d = with_keys(docs, at=_place(id_col, text_col))
    return rows_of(d.join(kept.select(_place_of("m").alias("at")), "at", "left_semi").dropDuplicates(["at"]))


#: Options for "a similarity of 0.8 or more on five-word shingles": such texts share at least 8/9 of their shingles, so the
#: angle between their sums is 27 degrees, and of 128 bits about 19.4 differ, 4 up or down; of very short texts (4 shingles of 5)
#: 24. By the binomial and hypergeometric distributions 0.98 and 0.9 of such pairs share a bucket within k bits, and as many if
#: all buckets are dealt anew by the `finer` masks (number, width). Bits of larger sets stray less: where both have 32 shingles
#: or more, 30 bits catch 0.981 of such pairs (38: 0.984, by simulation) and half as many of similarity 0.5.
SIMILAR = {"near": 0.8, "shingle": 5, "k": 38, "bits": 128, "tables": 72, "width": 14, "finer": (32, 6), "long": (32, 30)}
