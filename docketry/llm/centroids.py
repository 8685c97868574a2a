"""Centroid clustering (op 13): Lloyd's rounds over whole-number vectors, where a bisector tournament finds the nearest centroid.

For two centroids a < b the bisecting plane has the integer normal 2(b - a) and the threshold |b|^2 - |a|^2: a vector x lies
nearer to b if and only if x times the normal exceeds the threshold; equality favours the smaller number. Centroids meet in
ascending order, the winner so far against the next, so k - 1 sign tests leave the nearest one, and only its distance is
worked out. All numbers are whole, so results never depend on partitions, and a lost task is simply run again.

Each task sums up its own vectors by cluster; k rows a task are shuffled, and k centroids reach the driver in each round.

Cases: kept are vectors with exactly `dims` components, none null or non-finite; a null vector is not kept. A component whose
whole number exceeds 2^27 in size would not leave room for an exact distance in 64 bits: such vectors are not kept either.
Fewer kept vectors than k make fewer centroids, none an empty result. Rows with one vec_id are rows of their own, and equal
hashes are ordered by their components; a null vec_id counts as an empty text in the hash. Equal centroids: the smaller number
wins, the other stays as it is while it is empty. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, stored

#: A component's largest size: 64 squares of twice as much still fit in 64 bits.
LARGEST = 1 << 27
#: Bytes of normals that a task keeps; those of more centroids are made anew for each batch, one challenger at a time.
NORMALS = 64 << 20


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of longs: floor(scale * x) of each component x) of the vectors that are kept."""
    x = F.transform(F.col(vec_col), lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    sound = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * F.lit(float(scale)) < F.lit(float(LARGEST)))
    d = vectors.where((F.size(F.col(vec_col)) == dims) & F.forall(F.col(vec_col), sound))
    return d.select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<long>").alias("v"))


def bisectors(centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For challengers 1, 2, ...: the normals and thresholds of their planes against all centroids of smaller number."""
    square = (centroids * centroids).sum(1)
    for j in range(1, len(centroids)):
        yield 2 * (centroids[j] - centroids[:j]), square[j] - square[:j]


def nearest(x: np.ndarray, planes) -> np.ndarray:
    """The number of the centroid nearest to each row of x, by the tournament."""
    best = np.zeros(len(x), np.int64)
    for j, (normals, thresholds) in enumerate(planes, 1):
        best[np.einsum("ij,ij->i", x, normals[best]) > thresholds[best]] = j
    return best


class _Task:
    """The centroids and their planes in a task."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64)
        small = self.c.size * len(self.c) * 4 <= NORMALS
        self.kept = list(bisectors(self.c)) if small else None

    def assign(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, self.c.shape[1])
        return x, nearest(x, self.kept if self.kept is not None else bisectors(self.c))


def _sums(centroids: list[list[int]]):
    """Rows (cluster, n, sums) of a task: count and sum of its vectors for each cluster that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(centroids)
        total, count = np.zeros(task.c.shape, object), np.zeros(len(task.c), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, near = task.assign(b)
            order = np.argsort(near, kind="stable")
            there, at = np.unique(near[order], return_index=True)
            total[there] += np.add.reduceat(x[order], at, axis=0)  # a batch's sums fit in 64 bits; those of a task need not
            count += np.bincount(near, minlength=len(count))
        rows = np.flatnonzero(count)
        sums = pa.array([[str(v) for v in total[i]] for i in rows.tolist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(count[rows]), sums], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(centroids)
        for b in batches:
            if b.num_rows:
                x, near = task.assign(b)
                d = x - task.c[near]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array((d * d).sum(1))], names=["vec_id", "cluster", "distance"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id, in that order: a top-k report."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.v) for r in vectors.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floored mean of its vectors; an empty one stays."""
    s = vectors.mapInArrow(_sums(centroids), "cluster int, n long, sums array<string>").select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    s = s.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    new = [list(c) for c in centroids]
    for r in s.collect():  # k times dims numbers
        new[r.cluster][r.dim] = int(r.s) // r.n
    return new


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance (squared) of each kept vector after so many rounds, as a stored table; and the final centroids."""
    v = stored(whole_vectors(vectors, dims, scale, id_col, vec_col), "vectors")
    centroids = first_centroids(v, k, seed)
    if not centroids:
        return v.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        centroids = next_centroids(v, centroids)
    out = stored(v.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    discard(v)
    return out, centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distances) and centroid_sha256 to the rows of cluster_vectors."""
    spark = assigned.sparkSession
    text = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids)], "cluster int, c string")
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    every = sums.agg(F.sum("cluster_inertia").alias("inertia"))  # of one row a cluster
    about = F.broadcast(sums.join(text, "cluster").crossJoin(every).select("cluster", "cluster_inertia", "inertia", F.sha2("c", 256).alias("centroid_sha256")))
    return assigned.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
