"""Each operator against a brute-force version, on tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import chat, decontaminate, licenses, media, mixing, quality, queries, secret_scan, simhash, token_store, url_filter
from tests.conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sample():
    base = "The quick brown fox jumps over the lazy dog and then it runs away from all of the noise in the old town"
    texts = [base, base, base + " x", "", None, "É à ü ß 中文 ﬁ\t\n  double  space\r\n", "token = \"abcdef123456\" " * 3, "word " * 30000, "<|endoftext|> end", base.upper(), "Σίσυφος ΟΔΟΣ İ K"]
    return [(i if i != 4 else None, t, "en" if i % 2 else None, f"src{i % 3}" if i != 2 else None, len(t or "")) for i, t in enumerate(texts)] + [(0, base, "en", "src0", 5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano(values):
    v = np.sort(np.array(values, np.int64))
    ef = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(v).to_bytes())
    assert ef.decode().tolist() == v.tolist() == [ef.select(i) for i in range(len(v))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'sté\n\t\r\x1c\u00a0.!12中", max_size=40))
def test_chunks_encode_as_whole_texts(text):
    e = token_store.encoder(queries.tokenizer_path())
    assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == e.model.encode(text, add_special_tokens=False).ids


def test_token_store(spark, docs, empty):
    e = token_store.encoder(queries.tokenizer_path())
    want, start = [], 0
    for k, t in sorted(((d[0], d[1] or "") for d in sample()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*e.model.encode(t, add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_store.token_output(docs, queries.tokenizer_path(), block_ids=1000)
    assert rows(got) == sorted(want, key=repr)
    assert token_store.token_output(empty, queries.tokenizer_path()).count() == 0


def test_find_documents(spark, docs):
    """Documents found by select in their blocks: repeated ids, ids that no document has, beside null ids."""
    e = token_store.encoder(queries.tokenizer_path())
    path = token_store.write_store(docs, queries.tokenizer_path(), token_store.scratch_path(spark, "find"), block_ids=50)
    starts = {(r.doc_id, r.start): r.n_tokens for r in token_store.read_store(spark, path).collect()}
    got = token_store.find_documents(spark, path, [0, 3, 7, 10, 99]).collect()
    texts = {(d[0], tuple([*e.model.encode(d[1] or "", add_special_tokens=False).ids, 0])) for d in sample()}
    assert sorted(r.doc_id for r in got) == [0, 0, 3, 7, 10]
    assert all(starts[r.doc_id, r.start] == len(r.ids) and (r.doc_id, tuple(r.ids)) in texts for r in got)


# --- 2 ---


def test_media(spark, docs, empty):
    """All columns, with a file made by another writer and features from their definition."""
    import collections
    import io
    import math
    import wave

    want = []
    for d in sample():
        b = (d[1] or "").encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        f = io.BytesIO()
        with wave.open(f, "wb") as w:
            w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000)
            w.writeframes(p)
        m = f.getvalue()
        n, mean = len(p), sum(p) / len(p)
        var = sum(x * x for x in p) / n - mean * mean
        cross = sum((x > 127) != (y > 127) for x, y in zip(p, p[1:], strict=False))
        entropy = sum(-c / n * math.log2(c / n) for c in collections.Counter(p).values())
        want.append((d[0], len(b), n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"audio/wav;n={n};mean={mean:.4f};var={var:.4f};cross={cross};entropy={entropy:.4f}", "audio/wav", 0))
    got = rows(media.media_of_texts(docs))
    near = lambda r: (*r[:7], [round(float(x.split("=")[1]), 3) if "=" in x else x for x in r[7].split(";")], *r[8:])
    assert [near(r) for r in got] == [near(r) for r in sorted(want, key=repr)] and media.media_of_texts(empty).count() == 0


def test_nested_and_updated_media():
    """A zip in a zip, an updated PDF, scans of JPEG and blocks of GIF; texts of nothing but magic bytes take no quadratic time."""
    import gzip
    import io
    import time
    import zipfile

    def zipped(name, body):
        f = io.BytesIO()
        with zipfile.ZipFile(f, "w") as w:
            w.writestr(name, body)
        return f.getvalue()

    inner = zipped("a", "x" * 50)
    outer = zipped("in.zip", inner)
    assert media.sniff(outer) == [("application/zip", 0, len(outer)), ("application/zip", outer.index(inner), outer.index(inner) + len(inner))]
    assert media.sniff(b"ab" + outer + b"cd") == [("application/zip", 2, 2 + len(outer))]
    pdf = b"%PDF-1.4\n1 0 obj\n<<>>\nendobj\n"
    pdf += b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(pdf)
    update = pdf + b"\n2 0 obj\n<<>>\nendobj\n"
    update += b"xref\n0 1\ntrailer\n<<>>\nstartxref\n%d\n%%%%EOF" % len(update)
    assert media.sniff(pdf) == [("application/pdf", 0, len(pdf))] and media.sniff(update) == [("application/pdf", 0, len(update))]
    assert media.sniff(b"zz" + update) == [("application/pdf", 2, 2 + len(update))] and media.sniff(pdf[:-3]) == []
    gif = b"GIF89a\1\0\1\0\0\0\0,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
    jpg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2abc\xff\0d\xff\xd9"
    packed = gzip.compress(b"hello" * 100)
    for kind, x in (("image/gif", gif), ("image/jpeg", jpg), ("application/gzip", packed)):
        assert media.sniff(b"x" + x + b"y") == [(kind, 1, 1 + len(x))] and media.sniff(x[:-1]) == []
    began = time.time()
    for x in (b"%PDF-", b"PK\3\4", b"PK\5\6", b"GIF89aAAAAAAA!AAAA", b"RIFF\0\0\1\0WAVE", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", b"%PDF-startxref 5 %%EOF 1 0 obj "):
        assert media.sniff(x * (2_000_000 // len(x))) == []
    assert time.time() - began < 60


def test_sniff(spark):
    def chunk(kind, body):
        return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    wav = media.wav(b"abc")
    assert media.sniff(png) == [("image/png", 0, len(png))]
    assert media.sniff(b"xx" + png + b"yy" + wav) == [("image/png", 2, 2 + len(png)), ("audio/wav", 4 + len(png), 4 + len(png) + len(wav))]
    assert media.sniff(png[:-3]) == [] and media.sniff(b"BM RIFF GIF89a") == []
    assert media.wav_samples(wav) == b"abc"
    d = spark.createDataFrame([(1, bytearray(png), "text/plain"), (2, bytearray(b"plain"), "text/plain"), (3, None, "image/gif")], "doc_id long, media binary, declared string")
    assert [(r.key, r.type) for r in media.sniff_media(d).orderBy("key").collect()] == [(1, "image/png"), (2, "text/plain"), (3, "empty")]


# --- 3 ---


def brute_fp(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, k):
    """items: (id, fingerprint) -> {fingerprint: least id of its component}."""
    fps = sorted({f for _, f in items})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= k:
            root[find(a)] = find(b)
    least: dict = {}
    for i, f in items:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


def test_simhash(spark, docs, empty):
    items = [(d[0], brute_fp(d[1])) for d in sample()]
    comp = brute_components(items, 4)
    got = [(r.doc_id, r.fp[0] % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(((i, f, comp[f]) for i, f in items), key=repr)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bucket", [8192, 20])
def test_links_lose_nothing(spark, bucket):
    """Clusters with large buckets; with bucket=20 hot buckets are dealt anew."""
    r = np.random.default_rng(bucket)
    fps = set()
    for c in r.integers(0, 1 << 63, 8).tolist():
        for _ in range(60):
            x = c
            for p in r.integers(0, 64, r.integers(0, 7)).tolist():
                x ^= 1 << p
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([([f],) for f in signed], "fp array<long>")
    links = simhash.fingerprint_links(df, 4, bucket=bucket).collect()
    comp = brute_components([(f, f) for f in fps], 4)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for x in links:
        a, b = x.a[0] % (1 << 64), x.b[0] % (1 << 64)
        assert comp[a] == comp[b]
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    assert {f: find(f) for f in fps} == comp


def test_one_of_each_and_recall(spark):
    """Copies with similarity 0.8 or more on five-word shingles are caught; unrelated texts stay."""
    r = np.random.default_rng(3)
    vocab = ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    texts, pairs = [], 0
    for i in range(150):
        w = r.choice(vocab, 300).tolist()
        texts.append((2 * i, " ".join(w)))
        c = list(w)
        for p in r.integers(0, 300, 4):
            c[p] = "zz" + str(p)
        sh = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        assert len(sh(w) & sh(c)) / len(sh(w) | sh(c)) >= 0.8
        texts.append((2 * i + 1, " ".join(c)))
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts] + [(0, texts[0][1], "en", "s", 1)], DOCS)
    kept = sorted(x.doc_id for x in simhash.one_of_each(d, **simhash.SIMILAR).collect())
    assert all(2 * i in kept for i in range(150)) and kept.count(0) == 1
    assert sum(i % 2 for i in kept) <= 15  # recall of 0.9 at least
    assert simhash.one_of_each(d, **simhash.SIMILAR).columns == d.columns


def jaccard(a, b, n=5):
    sh = lambda t: {tuple(w[j : j + n]) for w in [t.split()] for j in range(max(1, len(w) - n + 1))}
    return len(sh(a) & sh(b)) / len(sh(a) | sh(b))


def edited(r, words, low, high):
    """A copy of words whose similarity is in [low, high): words at random places are replaced until it is."""
    c = list(words)
    while jaccard(" ".join(words), " ".join(c)) >= high:
        c[r.integers(0, len(c))] = f"zz{r.integers(0, 1 << 30)}"
    return " ".join(c) if jaccard(" ".join(words), " ".join(c)) >= low else edited(r, words, low, high)


def drawn(r, n):
    return [f"w{x}" for x in r.integers(0, 1 << 30, n)]


def test_one_of_each_keeps_what_is_less_similar(spark):
    """Texts at 0.70-0.79, and short ones beside an empty text, stay; equal sets of shingles are one."""
    r = np.random.default_rng(11)
    texts = []
    for _ in range(60):
        w = drawn(r, 300)
        texts += [" ".join(w), edited(r, w, 0.70, 0.79)]
    texts += ["", *(" ".join(drawn(r, 6)) for _ in range(300))]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(900, "", "en", "s", 1), (901, texts[0].upper(), "en", "s", 1), (902, None, "en", "s", 1)], DOCS)
    assert sorted(x.doc_id for x in simhash.one_of_each(d, **simhash.SIMILAR).collect()) == list(range(len(texts)))


@pytest.mark.parametrize("limits", [{}, {"dense": 0}, {"bucket": 80, "dense": 0, "finer": (40, 4)}, {"dense": 100}])
def test_similar_groups_are_those_of_confirmed_pairs(spark, limits):
    """Variants of few bases in wide buckets: components of the links of 0.8, whatever the limits of a bucket are."""
    r = np.random.default_rng(12)
    texts = []
    for _ in range(3):
        w = drawn(r, 120)
        texts += [" ".join(w)] + [edited(r, w, 0.6, 0.95) for _ in range(50)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    options = simhash.SIMILAR | {"k": 60, "tables": 24, "width": 1} | limits
    assert {x.doc_id: x.component_id for x in simhash.similar_groups(d, **options).collect()} == dict(enumerate(root))


def test_family_below_the_threshold(spark, monkeypatch):
    """400 variants of one text, none at 0.8 with another: a part of the pairs is listed, and all are kept."""
    r = np.random.default_rng(13)
    w, texts = drawn(r, 300), []
    for _ in range(400):
        texts.append(edited(r, w, 0.8, 0.84))  # of the base, which is no text itself
    pairs = [jaccard(texts[i], texts[j]) for i, j in r.integers(0, 400, (300, 2)).tolist() if i != j]
    assert max(pairs) < 0.8 and np.mean(pairs) > 0.6
    listed, plain = [], simhash.stored

    def counted(df, name, path=None):
        out = plain(df, name, path)
        if name == "pairs":
            listed.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert simhash.one_of_each(d, **simhash.SIMILAR).count() == 400 and sum(listed) < 79_800 / 5, listed



def test_candidates_come_from_the_gray_index(monkeypatch):
    """Buckets of one to many leaves: the index finds the pairs that brute force finds, and near-dedup's candidates come from it."""
    import pyarrow as pa

    r, found, k = np.random.default_rng(15), [], 38
    sizes = [1, 40, 2, 300, 33]
    fp = np.concatenate([r.integers(0, 1 << 63, (1, 2), dtype=np.uint64) ^ (r.integers(0, 1 << 63, (n, 2), dtype=np.uint64) & r.integers(0, 1 << 63, (n, 2), dtype=np.uint64)) for n in sizes])
    key = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    want = {(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if key[i] == key[j] and int(np.bitwise_count(fp[i] ^ fp[j]).sum()) <= k}
    assert 1000 < len(want) < 40_000
    plain = simhash.gray_pairs

    def spied(*a, **b):
        for i, j, d in plain(*a, **b):
            found.extend(zip(i.tolist(), j.tolist(), strict=True))
            yield i, j, d

    monkeypatch.setattr(simhash, "gray_pairs", spied)
    words = [pa.array(fp[:, i].view(np.int64)) for i in range(2)]
    zeros = pa.array(np.zeros(len(fp), np.int64))
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(fp), np.int32)), pa.array(key.astype(np.int32)), pa.array(np.arange(len(fp))), pa.array(np.full(len(fp), 50, np.int32)), *words, *[zeros] * 4], names=list("abcdefghij"))
    out = simhash._candidates(2, 4, k, None, 0.8, 8192, None, [((0, 0), 0, True)])(iter([batch.slice(0, 60), batch.slice(60)]))
    pairs = [p for b in out for p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert len(found) == len(pairs) and set(found) and set(pairs) == want == {tuple(sorted(p)) for p in pairs}


@pytest.mark.parametrize("limits", [{}, {"width": 1, "tables": 24, "k": 60, "bucket": 80, "finer": (40, 4), "dense": 100}])
def test_a_pair_is_listed_once(spark, monkeypatch, limits):
    """Near copies share many buckets: the first of a level lists a pair, no other, and the components stay those of brute force."""
    r = np.random.default_rng(16)
    texts = []
    for _ in range(2):
        w = drawn(r, 120)
        texts += [" ".join(w)] + [edited(r, w, 0.75, 0.95) for _ in range(70)]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    listed, plain = [], simhash.stored

    def counted(df, name, path=None):
        out = plain(df, name, path)
        if name in ("candidates", "rest"):
            pairs = out.where("kind = -1").selectExpr("least(a, b) a", "greatest(a, b) b")
            listed.append((name, pairs.count(), pairs.distinct().count()))
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert {x.doc_id: x.component_id for x in simhash.similar_groups(d, **simhash.SIMILAR | limits).collect()} == dict(enumerate(root))
    # Of tables with buckets that are dealt anew, some pairs are listed again.
    assert listed[0][1] and all(once <= n <= once * (1.1 if limits else 1) for _, n, once in listed), listed


def test_sketches():
    """Sketches agree as often as sets do; masks grow with the number of fingerprints, and their number with them."""
    r = np.random.default_rng(14)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(60):
            h = r.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = round(400 * share)
            a, b = h[:n], h  # b holds a: similarity is n / 400
            got.append(64 * simhash.SKETCH - int(np.bitwise_count(simhash.sketch(a) ^ simhash.sketch(b)).sum()))
        assert abs(np.mean(got) / (64 * simhash.SKETCH) - (share + (1 - share) / 2)) < 0.01
    assert not simhash.sketch(np.zeros(0, np.uint64)).any()
    assert simhash.wide_enough(1 << 20, 72, 14, 8192) == (72, 14) and simhash.wide_enough(0, 72, 14, 8192) == (72, 14)
    tables, width = simhash.wide_enough(10**10, 72, 14, 8192)
    assert width == 22 and (10**10 >> width) <= 4096 and 380 < tables < 400


@pytest.mark.parametrize("words", [8, 40, 300])
def test_recall_at_the_edge(spark, words):
    """Nine of ten copies at 0.80-0.83 at least are caught, short texts too (8 words: 4 shingles of 5 are shared)."""
    r = np.random.default_rng(words)
    texts = []
    for _ in range(400):
        w = drawn(r, words)
        texts += [" ".join(w), " ".join([*w, "end"]) if words == 8 else edited(r, w, 0.80, 0.83)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = [x.doc_id for x in simhash.one_of_each(d, **simhash.SIMILAR).collect()]
    assert sum(i % 2 == 0 for i in kept) == 400 and sum(i % 2 for i in kept) <= 40


# --- 4 ---


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train, held = lab.where("doc_id % 4 > 0"), lab.where("doc_id % 4 = 0")
    got = quality.classify(d, train).join(held, "doc_id").toPandas()
    assert ((got.p_quality > 0.5) == (got.quality == 1)).mean() > 0.93
    assert (got.keep == ((got.quality == 1) & (got.toxic == 0))).mean() > 0.85


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, none)
    assert got.count() == len(sample()) and got.where("keep").count() == len(sample())
    assert quality.classify(empty, none).count() == 0
    some = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (6, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.kept_documents(docs, some).columns == docs.columns


def test_quality_cases(spark):
    """Null labels, repeated doc_ids and labels, extra columns named like the operator's own."""
    r = np.random.default_rng(4)
    data = [(i, ("awful " if i % 3 == 0 else "fine ") + " ".join(drawn(r, 30)), "en", f"s{i % 4}", 1, 1, 2, 3, "x") for i in range(60)]
    data += [data[0], (3, "other text", "en", "s1", 1, 1, 2, 3, "x"), (None, None, None, None, None, None, None, None, None)]
    d = spark.createDataFrame(data, DOCS + ", quality int, toxic int, text_hash int, row string")
    labels = [(i, 1 if i % 5 else 0, int(i % 3 == 0)) for i in range(60)]
    lab = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    want = rows(quality.classify(d, lab(labels)))
    assert len(want) == len(data)
    noisy = lab(labels + labels[:30] + [(None, 1, 1), (1, None, 1), (2, 0, None)])
    assert rows(quality.classify(d, noisy)) == want
    kept = quality.kept_documents(d, noisy)
    assert kept.columns == d.columns and kept.count() == quality.classify(d, noisy).where("keep").count()
    assert quality.classify(d, lab([(0, 1, 0)] * 5 + [(None, None, None)])).where("NOT keep").count() == 0


def test_posteriors_model(spark):
    """Soft counts, shrinkage and posteriors against plain Python: 50 documents, 4 hosts (one null), 3 paths."""
    r = np.random.default_rng(5)
    ev = [(i, i, None if i % 4 == 3 else f"h{i % 4}", ["en", "de", None][i * i % 3], float(r.normal(-1 + i % 4, 1)), float(r.normal(-3, 1))) for i in range(50)]
    rates = (0.2, 0.1)
    got = {x.doc_id: x for x in quality.posteriors(spark.createDataFrame(ev, "doc_id long, text_hash long, host string, path string, e_low double, e_toxic double"), rates).collect()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def logit(p):
        p = min(max(p, 1e-4), 1 - 1e-4)
        return np.log(p / (1 - p))

    def strength(groups):  # (n, soft count, rate of the level above)
        n = sum(g[0] for g in groups)
        excess = (sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - sum(g[2] * (1 - g[2]) for g in groups)) / n
        mean = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
        return min(max(mean / excess - 1, 1.0), 1e6) if excess > 0 else 1e6

    for what, at, rate in (("low", 4, rates[0]), ("toxic", 5, rates[1])):
        hosts: dict = {}
        paths: dict = {}
        for x in ev:
            for table, key in ((hosts, x[2]), (paths, (x[2], x[3]))):
                n, s = table.get(key, (0, 0.0))
                table[key] = (n + 1, s + round(sig(x[at]) * 1e6) / 1e6)
        overall = sum(s for _, s in hosts.values()) / 50
        k = strength([(n, s, overall) for n, s in hosts.values()])
        up = {h: (s + k * overall) / (n + k) for h, (n, s) in hosts.items()}
        k = strength([(n, s, up[h]) for (h, _), (n, s) in paths.items()])
        for x in ev:
            n, s = paths[x[2], x[3]]
            site = (s + k * up[x[2]]) / (n + k)
            assert abs(got[x[0]][f"site_{what}"] - site) < 1e-5
            assert abs(got[x[0]][f"p_{what}"] - sig(x[at] + logit(site) - logit(rate))) < 1e-5


# --- 5 ---


def brute_hits(text, items, size):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = rx.findall((text or "").translate(LOW))
    hit, names = set(), set()
    for i, t in items:
        iw = rx.findall((t or "").translate(LOW))
        for s in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[s : s + size]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    names.add(str(i)) if i is not None else None
    return len(w), len(hit), sorted(names)


ITEMS = [(1, "quick brown fox jumps over the lazy dog and then it runs"), (2, "fox JUMPS"), (3, None), (4, ""), (11, "word word word"), (12, "οδοσ"), (13, "ΟΔΟΣ"), (1, "quick brown fox jumps over the lazy dog and then it runs"), (14, "a b c d e f g h i j k")]


def brute_near(text, items, size, near):
    """Positions at which some window has at least `near` of its words in place, and none all of them."""
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = rx.findall((text or "").translate(LOW))
    close, whole = set(), set()
    for _, t in items:
        iw = rx.findall((t or "").translate(LOW))
        for s in range(max(1, len(iw) - size + 1)) if iw else ():
            win = iw[s : s + size]
            for p in range(len(w)):
                same = sum(a == b for a, b in zip(w[p : p + len(win)], win, strict=False))
                if same == len(win):
                    whole.add(p)
                elif same >= -(-near * len(win) // 1):
                    close.add(p)
    return len(close - whole)


@pytest.mark.parametrize(("block", "near"), [(256, 0.9), (4, 0.9), (7, 0.8)])
def test_decontamination(spark, docs, empty, monkeypatch, block, near):
    """Also with blocks that most windows cross, and with words replaced in a passage."""
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    passage = ITEMS[0][1].split()
    more = [(50 + i, " ".join(["start", *passage[:i], "zebra", *passage[i + 1 :], "fox jumps"])) for i in range(len(passage))] + [(90, " ".join(["quick", "unicorn", *passage[2:9], "unicorn", *passage[10:]]))]
    data = sample() + [(i, t, "en", "s", 1) for i, t in more]
    d = spark.createDataFrame([(*x, "w", 1) for x in data], DOCS + ", win string, block int")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.items_sha256, r.contaminated, r.n_near) for r in decontaminate.find_contamination(d, items, near=near).collect()]
    want = []
    for x in data:
        n, hit, names = brute_hits(x[1], ITEMS, 10)
        want.append((x[0], n, hit, names, hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, brute_near(x[1], ITEMS, 10, near)))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(x[-1] for x in want) > 10
    clean = decontaminate.clean_documents(d, items)
    assert clean.columns == d.columns and clean.count() == sum(not x[-2] for x in want)
    assert decontaminate.find_contamination(empty, items).count() == 0
    assert decontaminate.find_contamination(docs, items.limit(0)).where("contaminated").count() == 0


# --- 6 ---


def brute_base(t):
    a = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", *m.span()) for m in a.finditer(t) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "apiKEY", "api_key", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "ſecret", "K", "é"]), max_size=14).map("".join))
def test_base_spans(text):
    assert sorted(secret_scan.base_spans(text)) == sorted(brute_base(text))


def test_secrets(spark, docs, empty):
    import base64
    import json

    b64 = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    jwt = f"{b64({'alg': 'HS256'})}.{b64({'sub': 'x'})}.c2lnbmF0dXJl"
    der = bytes([0x30, 40, 0x02, 1, 0, 0x04, 35]) + b"k" * 35
    pem = "-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(der).decode() + "\n-----END PRIVATE KEY-----"
    ssh = base64.b64encode((7).to_bytes(4, "big") + b"ssh-rsa" + (9).to_bytes(4, "big") + b"x" * 9).decode()
    kinds = lambda t: [s[0] for s in secret_scan.added_spans(t)]
    assert kinds(f"a {jwt} b") == ["jwt"] and kinds(jwt.replace("eyJ", "eyK", 1)) == []
    assert kinds(pem) == ["pem"] and kinds(pem.replace("MC", "MD")) == []
    assert kinds(ssh) == ["sshkey"] and kinds(f"x {der.hex()} y") == ["der"] and kinds(f"x {der.hex()[:-2]} y") == []
    got = secret_scan.scan_secrets(docs).collect()
    assert sorted((r.doc_id, r.n_assign) for r in got if r.doc_id == 6) == [(6, 3)] and len(got) == len(sample())
    assert secret_scan.scan_secrets(empty).count() == 0


def test_bare_keys():
    """Keys after '=', with short lengths, over several lines, and armour with escaped line breaks."""
    import base64

    def der(n):
        size = bytes([n + 5]) if n + 5 < 128 else bytes([0x82]) + (n + 7).to_bytes(2, "big")
        inner = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
        return b"\x30" + size + b"\x02\x01\x00\x04" + inner + b"k" * n

    for n in (41, 60, 114, 600):
        t = base64.b64encode(der(n)).decode()
        wrapped = "\n".join(t[i : i + 64] for i in range(0, len(t), 64))
        for x in (t, wrapped, wrapped.replace("\n", "\r\n"), wrapped.replace("\n", "\\n")):
            for before, after in (("", ""), ("KEY=", ";"), ("a key: ", "\nnext line")):
                got = [s for s in secret_scan.added_spans(before + x + after) if s[0] == "der"]
                assert got == [("der", len(before), len(before + x))], (n, before, x[:20])
        assert not secret_scan.added_spans(t[:-6]) and not secret_scan.added_spans("x" + t)
        pem = "-----BEGIN PRIVATE KEY-----\n" + wrapped + "\n-----END PRIVATE KEY-----\n"
        assert ("pem", 0, len(pem.replace("\n", "\\n")) - 2) in secret_scan.added_spans(pem.replace("\n", "\\n"))


def tlv(tag, *parts):
    b = b"".join(parts)
    return bytes([tag]) + (bytes([len(b)]) if len(b) < 128 else b"\x82" + len(b).to_bytes(2, "big")) + b


def test_key_structure():
    """Private keys of all lengths are told from public keys, certificates and broken ones."""
    import base64

    number = lambda k: tlv(2, b"\1" * k)
    rsa_id = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d010101")), tlv(5))
    rsa = tlv(0x30, *map(number, (1, 128, 3, 128, 64, 64, 64, 64, 64)))
    zero = tlv(2, b"\0")
    keys = [rsa, tlv(0x30, zero, rsa_id, tlv(4, rsa)), tlv(0x30, zero, tlv(0x30, tlv(6, bytes.fromhex("2b6570"))), tlv(4, tlv(4, b"k" * 32))), tlv(0x30, number(1), tlv(4, b"k" * 32), tlv(0xA0, tlv(6, b"12345678"))), tlv(0x30, tlv(0x30, tlv(6, b"123456789")), tlv(4, b"c" * 64))]
    others = [tlv(0x30, zero, rsa_id, tlv(4, rsa[:-1])), tlv(0x30, rsa_id, tlv(3, b"\0" + tlv(0x30, number(128), number(3)))), tlv(0x30, tlv(0x30, number(1)), tlv(0x30, tlv(6, b"*")), tlv(3, b"\0" * 64)), tlv(0x30, number(128), number(3)), rsa[:-2]]
    for x in keys:
        t = base64.b64encode(x).decode()
        assert secret_scan.added_spans(f"k={t} z") == [("der", 2, 2 + len(t))] and [s[0] for s in secret_scan.added_spans(f"x {x.hex()} z")] == ["der"]
    for x in others:
        assert secret_scan.added_spans(f"k={base64.b64encode(x).decode()} z") == [] and secret_scan.added_spans(f"x {x.hex()} z") == []

    def armour(label, body, headers=""):
        t = base64.b64encode(body).decode()
        return f"-----BEGIN {label}-----\n{headers}" + "\n".join(t[i : i + 64] for i in range(0, len(t), 64)) + f"\n-----END {label}-----"

    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(field(b"ssh-ed25519") + field(b"k" * 32)) + field(b"p" * 128)
    sealed = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00AA\n\n"
    for t, found in ((armour("OPENSSH PRIVATE KEY", ssh), True), (armour("OPENSSH PRIVATE KEY", b"openssh-key-v1\0junk"), False), (armour("OPENSSH PRIVATE KEY", ssh[:-1]), False), (armour("RSA PRIVATE KEY", rsa), True), (armour("RSA PRIVATE KEY", b"z" * 256, sealed), True), (armour("RSA PRIVATE KEY", b"z" * 255, sealed), False), (armour("CERTIFICATE", others[2]), False), (armour("PUBLIC KEY", others[1]), False)):
        assert secret_scan.added_spans("a " + t + " b") == ([("pem", 2, 2 + len(t))] if found else [])


def test_secret_columns(spark):
    """spans and base_sha256 against spans that are known by where they were put."""
    import base64

    key = base64.b64encode(tlv(0x30, tlv(2, b"\0"), tlv(4, b"k" * 60))).decode()
    bits = [("plain é text ", None), ("token=abcdef12", "assign"), ("AKIA" + "A1" * 8, "access"), ("0123456789abcdef" * 2, "hex"), (key, "der"), ("password", None), ("AKIAshort", None)]
    r = np.random.default_rng(6)
    data, want = [(100, None), (101, "")], [(100, ""), (101, "")]
    for i in range(60):
        text, spans = "", []
        for j in r.integers(0, len(bits), 6).tolist():
            if bits[j][1]:
                spans.append((bits[j][1], len(text), len(text) + len(bits[j][0])))
            text += bits[j][0] + " \n"
        data.append((i, text))
        want.append((i, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)))
    got = {x.doc_id: x for x in secret_scan.scan_secrets(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, spans in want:
        base = ",".join(s for s in spans.split(",") if not s.startswith("der"))
        assert (got[i].spans, got[i].base_sha256) == (spans, hashlib.sha256(base.encode()).hexdigest())
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].n_added) == tuple(spans.count(k + ":") for k in ("assign", "access", "hex", "der"))


# --- 7 ---


def test_licenses(spark, empty):
    apache = "Copyright 2020 Someone.\nLicensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at:\nfoo bar\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and limitations under the License."
    d = spark.createDataFrame([(1, apache, "x"), (2, "Released under the MIT License. Released under the MIT License.", "x"), (3, None, "x"), (4, "", "x"), (None, "all rights reserved", "x"), (2, "Released under the MIT License. Released under the MIT License.", "x"), (5, "no such thing", "x")], "doc_id long, text string, norm string")
    got = [(r.doc_id, r.n_known, r.licenses, r.matches) for r in licenses.scan_licenses(d).collect()]
    mit = (2, 2, "MIT", "MIT:0:0,MIT:1:1")
    assert sorted(got, key=repr) == sorted([(1, 6, "Apache-2.0", "Apache-2.0:1:6"), mit, mit, (3, 0, "", ""), (4, 0, "", ""), (None, 1, "", ""), (5, 0, "", "")], key=repr)
    assert licenses.scan_licenses(empty).count() == 0
    assert all(any(h in s for h in licenses.HINTS) for s in licenses.SENTENCES.values())


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MIT = """Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""


def test_wrapped_licenses(spark):
    """Whole notices, wrapped at several widths, bare and behind comment marks, after lines without an end mark."""
    import textwrap

    notices = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD_HEAD + BSD_TAIL, "BSD-3-Clause": BSD_HEAD + BSD_THIRD + BSD_TAIL, "ISC": ISC, "MPL-2.0": MPL, "GPL-3.0-or-later": GPL, "LGPL-2.1-or-later": LGPL}
    cases = []
    for name, text in notices.items():
        for width in (40, 72, 79, 10_000):
            for mark in ("", "# ", "// ", " * ", "-- ", "dnl "):
                lines = [x for p in text.split("\n") for x in (textwrap.wrap(p, width) or [""])]
                cases.append((name, "import something\n" + "\n".join(mark + x for x in lines) + "\ncode = 1\n"))
    d = spark.createDataFrame([(i, t, "n", 1, "x") for i, (_, t) in enumerate(cases)], "doc_id long, text string, pieces string, n int, seq string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(d).collect()}
    wrong = [(cases[i][0], got[i], cases[i][1][:90]) for i in range(len(cases)) if got[i] != cases[i][0]]
    assert not wrong, wrong[:3]


def test_licenses_with_names_and_lists(spark):
    """Names in slots, items of lists that are not known, and expressions; the answers are written by hand."""
    third = lambda who: BSD_THIRD.replace("the copyright holder nor the names of its", f"{who} nor the names of its")
    by = lambda who, text: text.replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", f"{who.upper()} AND CONTRIBUTORS").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS", f"{who.upper()} OR CONTRIBUTORS")
    author = "\n3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n"
    other = "\n3. Users of this software must water the plants of the author every week.\n"
    advert = "\n3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Acme.\n"
    many = "a b c d e f g h i j k l m"
    cases = [
        ("BSD-3-Clause", BSD_HEAD + third("Acme Inc.") + BSD_TAIL),
        ("BSD-3-Clause", BSD_HEAD + third("the University of California, Berkeley") + by("the regents", BSD_TAIL)),
        ("BSD-3-Clause", BSD_HEAD + third("The Example Project") + by("Acme Inc.", BSD_TAIL)),
        ("BSD-3-Clause", BSD_HEAD + author + BSD_TAIL),
        ("BSD-3-Clause", BSD_HEAD + third("Acme Inc.")),
        ("", BSD_HEAD + third(many) + BSD_TAIL),
        ("", BSD_HEAD + other + BSD_TAIL),
        ("", BSD_HEAD + other),
        ("BSD-2-Clause", BSD_HEAD),
        ("BSD-2-Clause", BSD_HEAD + by("Acme Inc.", BSD_TAIL)),
        ("BSD-4-Clause", BSD_HEAD + advert + third("Acme").replace("3.", "4.") + BSD_TAIL),
        ("MIT", MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME INC.")),
        ("MIT", "1. Released under the MIT License\n2. Something else\n3. And more"),
        ("Apache-2.0,MIT", "// SPDX-License-Identifier: Apache-2.0 OR MIT\n"),
        ("GPL-2.0-or-later", "/* SPDX-License-Identifier: GPL-2.0+ */"),
        ("Apache-2.0,BSD-3-Clause,MIT", "# SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR Apache-2.0"),
        ("GPL-2.0-only", "SPDX-License-Identifier:GPL-2.0 WITH Linux-syscall-note"),
        ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only WITH MIT"),
        ("", "SPDX-License-Identifier: LicenseRef-own"),
        ("", "SPDX-License-Identifier:"),
        ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0"),
        ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
        ("CDDL-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'),
        ("MIT", MIT + "\nSPDX-License-Identifier: MIT"),
    ]
    d = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(d).collect()}
    wrong = [(i, want, got[i]) for i, (want, _) in enumerate(cases) if got[i] != want]
    assert not wrong, wrong


# --- 8 ---


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s: 2.0 * sizes[s] for s in rest if share[s] > 2 * sizes[s]}
        if not over:
            return {**share, **full}
        full |= over


def test_mixing(spark, empty):
    r = np.random.default_rng(1)
    data = [(i, "w " * int(r.integers(0, 40)), "en", None if i % 9 == 0 else f"s{min(i % 9, 4)}", 0) for i in range(400)] + [(7, "a b c", "en", "s4", 0)] * 3 + [(500, None, "en", "s1", 0)]
    d = spark.createDataFrame(data, DOCS)
    got = mixing.mix_sources(d).collect()
    sizes: dict = {}
    for x in data:
        sizes[x[3]] = sizes.get(x[3], 0) + len((x[1] or "").split())
    want = brute_targets(sizes)
    for s in sizes:
        mine = [g for g in got if g.source == s]
        assert abs(mine[0].target - want[s]) < 1e-6 and mine[0].source_size == sizes[s]
        assert abs(sum(g.taken for g in mine) - want[s]) < 1
    assert all(0 <= g.taken <= 2 * g.size for g in got) and len(got) == len(data)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = mixing.mix_sources(d.repartition(5)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    m = mixing.mixed_documents(d)
    assert m.columns == d.columns
    assert m.count() == sum(-(-g.taken // g.size) for g in got if g.taken)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# --- 9 ---


def test_urls(spark):
    urls = ["http://a.net/x", "http://NET", "http://net/", "https://example.net/en/1?q", "https://x.example.net/en", "http://example.com/de/a#f", "http://notexample.com/de/", "http://b.org/fr/", None, "nourl", "ftp://a.net?x/", "http://a.net/x", "http://net.:80/", "x://" + "a." * 300 + "net/" + "d/" * 500]
    d = spark.createDataFrame([(i, u, "path") for i, u in enumerate(urls)] + [(0, urls[0], "dup")], "page_id long, url string, path string")
    got = url_filter.judge_urls(d, url_filter.rule_table(spark, queries.URL_RULES)).collect()

    def brute(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fit = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    assert sorted(map(tuple, got), key=repr) == sorted([(i, *brute(u)) for i, u in enumerate(urls)] + [(0, *brute(urls[0]))], key=repr)
    assert url_filter.judge_urls(d, url_filter.rule_table(spark, queries.URL_RULES).limit(0)).where("rule IS NOT NULL").count() == 0


# --- 10 ---


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b\\"]), st.lists(st.sampled_from(["<turn", "</turn>", "\\", "\n", " ", "é", "😀", "the", "'s"]), max_size=6).map("".join)), min_size=1, max_size=4))
def test_template_round_trip(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    e = chat._model(queries.tokenizer_path()).encode(formatted, add_special_tokens=False)
    _, covered = chat.mask_spans(np.array(e.offsets).reshape(-1, 2), spans)
    assert [chat.unescape(formatted[a:b]) for a, b in covered] == [t for r, t in turns if r == "assistant" and t]
    assert e.ids == [i for t in turns for i in chat._model(queries.tokenizer_path()).encode(chat.render([t])[0], add_special_tokens=False).ids]


def test_chat(spark, monkeypatch):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, None, None, "x"), (3, 0, "user", ""), *queries.ADDED, *[(9, i, "assistant" if i % 2 else "user", f"text {i} " * 400) for i in range(400)]]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_output(d, queries.tokenizer_path()).collect()}
    for c in {x[0] for x in data}:
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in data if x[0] == c))
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.chat_output(d.limit(0), queries.tokenizer_path()).count() == 0
