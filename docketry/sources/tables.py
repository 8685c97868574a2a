"""Sources and sinks: files, tables, links in pages, appends, reconciliation with an object listing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole objects as bytes: path, content, length, modificationTime."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(key, length, modificationTime) of the objects anywhere under path, without reading any: contents are no part of the scan.
    key: what follows path. Empty objects are not listed (an upload has one byte at least, see operators.cases.RULES); a folder that
    is not there is an empty listing."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, length long, modificationTime timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    root = path.split(":", 1)[-1].strip("/") + "/"
    key = F.substring(F.col("path"), F.instr("path", F.lit(root)) + len(root), F.length("path"))
    return files.select(key.alias("key"), "length", "modificationTime")


def save_bucketed(df: DataFrame, name: str, by: str, buckets: int, path: str | None = None) -> DataFrame:
    """df as a table of the catalog (in path, or in the warehouse), in buckets of a column, each one sorted file: tables in as many
    buckets of their keys are joined and grouped by them without a shuffle. All rows of a key are in one bucket, so keys must be
    spread; rows with a null key share one."""
    writer = df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(by)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def load_tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def append_rows(df: DataFrame, path: str, by: str = "listing_date") -> None:
    """Appends rows to a table in folders by a column."""
    df.write.mode("append").partitionBy(by).parquet(path)


def overwrite_parts(df: DataFrame, path: str, by: str = "listing_date") -> None:
    """Replaces the folders of a table that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_parts(spark: SparkSession, path: str, schema: StructType | str, values: list | None = None, by: str = "listing_date") -> DataFrame:
    """The table, or only the folders of the given values: they reach the scan as a partition filter. A table that is not there is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    return df if values is None else df.where(F.col(by).isin(values))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def once(df: Callable[[], DataFrame], path: str, spark: SparkSession) -> DataFrame:
    """df() as a table in path, written unless a run before has written it to its end (then that stands, and df is not asked)."""
    if not exists(spark, f"{path}/_SUCCESS"):
        df().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def touched(df: DataFrame, by: str = "listing_date") -> list:
    """The distinct values of a partition column, of which there are few."""
    return sorted(r[0] for r in df.select(by).where(F.col(by).isNotNull()).distinct().collect())


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): links of a page in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href=["']([^"']*)["']"""), F.lit(1))).alias("pos", "href"))


def pdf_links(pages: DataFrame) -> DataFrame:
    """The first link of a page that ends in .pdf, in either case."""
    return extract_links(pages).where(F.lower("href").like("%.pdf")).groupBy("page_id").agg(F.min_by("href", "pos").alias("href"))


def extract_form_inputs(pages: DataFrame) -> DataFrame:
    """(page_id, name, value): hidden inputs; of one name the last counts."""
    x = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)(<input\s[^>]*>)"), F.lit(1))).alias("pos", "tag")).where(F.col("tag").rlike(r"""(?i)type=["']hidden["']"""))
    attr = lambda n: F.regexp_extract("tag", rf"""(?i)\b{n}=["']([^"']*)["']""", 1)
    return x.select("page_id", "pos", attr("name").alias("name"), attr("value").alias("value")).where("name <> ''").groupBy("page_id", "name").agg(F.max_by("value", "pos").alias("value"))


def extract_options(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"""(?i)<option\s[^>]*value=["']([^"']*)["']"""), F.lit(1))).alias("pos", "value"))


def reconcile_uploads(docs: DataFrame, objects: DataFrame) -> DataFrame:
    """Documents not marked as uploaded: uploaded if their object exists, else failed."""
    o = objects.select(F.col("key").alias("storage_key"), F.lit(True).alias("_o")).distinct()
    x = docs.join(o, "storage_key", "left")
    open_ = F.col("upload_status") != "uploaded"
    new = F.when(~open_, F.col("upload_status")).when(F.col("_o"), "uploaded").otherwise("failed")
    return x.select("doc_id", "storage_key", new.alias("upload_status"), (open_ & F.col("_o").isNotNull()).alias("repaired"), (open_ & F.col("_o").isNull()).alias("missing"))


def write_upsert(new: DataFrame, keys: list[str], path: str, by: str = "listing_date", order: str | None = None, keep: list[str] = ()) -> list:
    """Puts the rows of new over a table in folders by a column that is one of the keys. Only folders that new has rows of are read
    and written again, the others keep their files. Returns the values of those folders.

    They are replaced when all of them have been written; a driver that is lost while it replaces them can leave one short. A job
    that must survive that writes the merged rows to a folder of its own first (streaming.jobs.cause_list_batch)."""
    from docketry.operators.cases import upsert

    if by not in keys:
        raise ValueError(f"{by} must be one of the keys, else a row could change its folder")
    days = touched(new, by)
    base = read_parts(new.sparkSession, path, new.schema, days, by)
    overwrite_parts(upsert(base, new.where(F.col(by).isNotNull()), keys, keep, order), path, by)
    return days


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the folder that spark.checkpoint.dir names; in a temporary one only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docketry-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that spark.checkpoint.dir names."""
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        shared_path(spark, "checkpoint")
    return df.checkpoint()
