"""Shared helpers: tables in the cluster's shared folder, word patterns, prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts, as Java/RE2/Python character classes.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset in local mode (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docketry-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docketry/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables that are no longer read."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        p.getFileSystem(conf).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches hold few rows, as one text may be very long. Results never depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def with_keys(docs: DataFrame, **keys: Column) -> DataFrame:
    """The keys beside `row`, a struct of all columns of docs: no name of docs can clash with a key. Undone by rows_of."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def rows_of(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def word_count(c: Column) -> Column:
    """Number of words of SPACE_WORD; null text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def join_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins on keys of the same names, null equal to null; other column names must differ."""
    r = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_r{i}"))
        same = c if same is None else same & c
    out = left.join(r, same, how)
    if how == "full":
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"_r{i}")) for i, k in enumerate(keys)})
    return out if "semi" in how or "anti" in how else out.drop(*[f"_r{i}" for i in range(len(keys))])


def spread(bits: int, *cols: Column) -> Column:
    """A uniform hash of cols cut to so many bits, never negative."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - bits)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Adds the exclusive running sum of value within group, in order; bucket must rise with order.

    Each (group, bucket) is summed by itself; only one total per bucket is summed across buckets,
    so a group that holds most rows is spread over as many tasks as it has buckets."""
    part = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_t"))
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_off", F.coalesce(F.sum("_t").over(over), F.lit(0))).drop("_t")
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(part), F.lit(0)))
    return join_rows(inner, totals, [*group, bucket]).withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df as a stored table with `_rank`, each row's place (from 0) in the given order: a range sort, whose partitions are
    counted, and only one count a partition is summed up in one task."""
    s = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Partition, then row in it: fixed by the sort, and kept in the stored table.
    s = stored(s.withColumn("_at", F.monotonically_increasing_id()), name)
    part, path = F.shiftright("_at", 33), s.stored_at
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = s.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    out = s.withColumn("_part", part).join(F.broadcast(parts), "_part")
    out = out.withColumn("_rank", F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_base")
    out.stored_at = path
    return out
