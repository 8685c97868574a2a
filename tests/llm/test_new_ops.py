"""Resampling, sharding and centroid clustering against brute force, on hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docketry.llm import centroids, resampling, sharding
from docketry.llm.common import ranked, scratch_path
from tests.conftest import rows
from tests.llm.test_ops import DOCS, LOW, sample

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOCS)


def test_ranked(spark):
    """Places follow the order, whatever the partitions; ties among equal rows are any of them."""
    r = random.Random(1)
    data = [(r.choice([None, 1, 2, 3, 50]), r.random()) for _ in range(500)]
    from pyspark.sql import functions as F

    got = ranked(spark.createDataFrame(data, "a int, b double").repartition(7), [F.col("a").asc_nulls_last(), F.col("b").desc()], "ranks").collect()
    want = sorted(data, key=lambda x: (x[0] is None, x[0] or 0, -x[1]))
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x._rank)] == want and sorted(x._rank for x in got) == list(range(500))


# --- 11 ---


def features(text, runs=2):
    w = WORDS.findall((text or "").translate(LOW))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def drawn(data, target, runs=2, buckets=10_000, percent=25, least=20, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for d in data:
        s.update(map(bucket, features(d[1], runs)[1]))
    for x in target:
        t.update(map(bucket, features(x, runs)[1]))
    big, small = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets))))
    out = []
    for d in data:
        n, f = features(d[1], runs)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        out.append([d[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return out, able[: len(able) * percent // 100]


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_features(runs):
    pattern = resampling.run_pattern(runs)
    for text in (None, "", " ", "one", "One two", "a-b_c  3\té", "x y z x y z", "\x1c\x85  ÀB ſ\n", "nul\0nul", "w " * 3000, "İ Σς . 中文 文"):
        n, crcs = resampling.crcs_of(text, pattern, runs)
        want = features(text, runs)
        assert (n, sorted(crcs.tolist())) == (want[0], sorted(zlib.crc32(f.encode()) for f in want[1]))


@pytest.mark.parametrize(("runs", "buckets", "percent", "least"), [(2, 10_000, 25, 20), (3, 70_000, 100, 1), (1, 7, 50, 0)])
def test_resample(spark, docs, runs, buckets, percent, least):
    target = ["The lazy dog runs away", None, "", "noise in the old town"]
    t = spark.createDataFrame([(i, x, 1) for i, x in enumerate(target)], "item_id int, text string, weight int")
    got = resampling.resample(docs, t, runs, buckets, percent=percent, least_words=least).collect()
    want, first = drawn(sample(), target, runs, buckets, percent, least)
    assert sorted(([r.doc_id, r.n_features, r.weight, r.score, r.n_words] for r in got), key=repr) == sorted(want, key=repr)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(x[0], x[3]) for x in first]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(first) + 1))


def test_drawn_documents(spark, docs):
    """Rows as they came, clashing names too; of equal rows as many as were drawn; empty tables."""
    from pyspark.sql import functions as F

    t = spark.createDataFrame([("i", "the lazy dog")], "item_id string, text string")
    many = docs.unionByName(docs).withColumn("rank", F.lit("r")).withColumn("n", F.lit(1))
    got = resampling.drawn_documents(many, t, least_words=3, percent=40)
    ranks = resampling.resample(many, t, least_words=3, percent=40).where("rank IS NOT NULL")
    assert got.columns == many.columns and sorted(r.doc_id or -1 for r in got.collect()) == sorted(r.doc_id or -1 for r in ranks.collect())
    assert resampling.resample(docs.limit(0), t).count() == 0
    none = resampling.resample(docs, t.limit(0))
    assert none.count() == len(sample()) and none.where("rank IS NOT NULL").count() > 0


# --- 12 ---


def shard_rows(spark, n=3000):
    r = random.Random(3)
    base = [(i, "x" * r.choice([0, 10, 200, 900]) + "é", "a", 1) for i in range(n)]
    return spark.createDataFrame([*base, (None, None, "b", 2), (7, "", None, None)], "doc_id long, text string, shard string, slot int")


def balanced(got, shards):
    load = Counter({i: 0 for i in range(shards)})
    for r in got:
        load[r.shard] += r.size
    return max(load.values()) - min(load.values()), sum(load.values()) / shards


def test_shards(spark):
    d = shard_rows(spark)
    got = sharding.shard_documents(d, shards=24).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in d.collect()), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want
    for s in range(24):
        mine = sorted((r.slot, r.vslot, r.doc_id or -1) for r in got if r.shard == s)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    gap, mean = balanced(got, 24)
    assert gap < 0.02 * mean and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = sharding.shard_documents(d.repartition(5), shards=24).collect()
    assert sorted((r.doc_id or -1, r.shard, r.size) for r in again) == sorted((r.doc_id or -1, r.shard, r.size) for r in got)


def test_hot_slot(spark):
    """A third of all rows has one id, another third none: their slots are split, and sizes stay near."""
    d = spark.createDataFrame([(i if i % 3 == 0 else 5 if i % 3 == 1 else None, "t" * 100) for i in range(6000)], "doc_id long, text string")
    got = sharding.shard_documents(d, shards=8, slots=512).collect()
    gap, mean = balanced(got, 8)
    assert len(got) == 6000 and gap < 0.1 * mean and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in d.collect())
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_few_records(spark):
    """Fewer records than shards, one that is larger than a share, and none at all."""
    d = spark.createDataFrame([(1, "x" * 50_000), (2, "y"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.shard_documents(d).collect()}
    assert len({r.shard for r in got.values()}) == 3 and {r.slot for r in got.values()} == {0} and got[3].size == 8 and got[3].text_crc32 == 0
    assert sharding.shard_documents(d.limit(0)).count() == 0


def test_versions(spark):
    """Each edit is a version; one shard more takes slots into itself only, and about its share of bytes."""
    d, path = shard_rows(spark), scratch_path(spark, "versions")
    sizes = sharding.slot_sizes(sharding.keyed_records(d, 24, sharding.SLOTS, "doc_id", "text"))
    old = sharding.slot_map(spark, path, sizes, 24)
    new = sharding.grown_map(spark, path, old, 24)
    first, a, b = ({(r.slot, r.part): r for r in sharding.read_map(spark, path, v).collect()} for v in (0, old, new))
    assert {r.version for r in b.values()} == {new} == {2} and first.keys() == a.keys() == b.keys()
    moved = [b[k] for k in a if a[k].shard != b[k].shard]
    assert moved and {r.shard for r in moved} == {24}
    load = Counter()
    for r in b.values():
        load[r.shard] += r.bytes
    assert abs(load[24] - sum(load.values()) / 25) <= max(r.bytes for r in b.values())
    # Most slots stay where the first version put them.
    assert sum(first[k].shard != a[k].shard for k in a) < 0.5 * len(a)


def test_moves_by_brute_force():
    """No single slot can move any more and bring two shards closer."""
    r = random.Random(4)
    for _ in range(60):
        n, shards = r.randrange(0, 40), r.randrange(1, 6)
        sizes = {(i, 0): r.choice([0, 1, 2, 3, 10, 50]) for i in range(n)}
        owner = sharding.moved_slots(sizes, {k: r.randrange(shards) for k in sizes}, shards)
        load = [sum(sizes[k] for k in sizes if owner[k] == s) for s in range(shards)]
        low = min(load)
        assert all(not sizes[k] or sizes[k] >= load[owner[k]] - low for k in sizes)


# --- 13 ---


def lloyd(data, k, rounds, seed=2, dims=64):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], c


def vectors():
    r = np.random.default_rng(5)
    data = [(i, r.normal(0, 0.1, 64).astype("f4").tolist()) for i in range(150)]
    data += [(i, data[i % 7][1]) for i in range(150, 200)] + [(3, data[3][1]), (None, data[9][1]), (None, data[10][1])]
    zero = [0.0] * 64
    data += [(300, None), (301, []), (302, zero[:63]), (303, [None, *zero[1:]]), (304, [float("nan"), *zero[1:]]), (305, [float("inf"), *zero[1:]]), (306, [1e30, *zero[1:]]), (307, zero), (308, [-0.0, *zero[1:]]), (309, [1000.0, -1000.0, *zero[2:]])]
    return data


def test_tournament():
    """Against all distances, with many equal ones: the smaller number wins."""
    r = np.random.default_rng(6)
    for k in (1, 2, 7, 40):
        c, x = r.integers(-2, 3, (k, 3)), r.integers(-3, 4, (500, 3))
        want = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        assert (centroids.nearest(x, list(centroids.bisectors(c))) == want).all()


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (3, 2), (400, 1)])
def test_clusters(spark, k, rounds):
    d = spark.createDataFrame([(i, v, 0, 0) for i, v in vectors()], "vec_id long, embedding array<float>, cluster int, v int")
    assigned, c = centroids.cluster_vectors(d, k, rounds)
    want, centres = lloyd(vectors(), k, rounds)
    assert c == centres and rows(assigned) == sorted(want, key=repr)
    got = centroids.with_inertia(assigned, c).collect()
    inertia = Counter()
    for _, j, dist in want:
        inertia[j] += dist
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centres]
    assert len(got) == len(want) and all((r.cluster_inertia, r.inertia, r.centroid_sha256) == (inertia[r.cluster], sum(inertia.values()), sha[r.cluster]) for r in got)


def test_no_vectors(spark):
    d = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    for x in (d, d.limit(0)):
        out = centroids.with_inertia(*centroids.cluster_vectors(x))
        assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 0


def test_normals_made_anew(spark, monkeypatch):
    """More centroids than a task keeps normals of give the same result."""
    d = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    a = rows(centroids.cluster_vectors(d, 12, 2)[0])
    task = centroids._Task([[0] * 64] * 3)
    monkeypatch.setattr(centroids, "NORMALS", 0)
    assert task.kept is not None and centroids._Task([[0] * 64] * 3).kept is None
    assert a == rows(centroids.cluster_vectors(d, 12, 2)[0])
