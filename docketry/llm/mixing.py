"""Mixing sources to target weights (op 8): hash-random keys, range-sorted within each source, distributed prefix sums
of sizes, and a cut at each source's exact budget; whole epochs repeat where the budget exceeds the source.

Sources sort by code point, null last, and take the weights in turn. All budgets together are `share` times all sizes;
a source's target stops at `cap` times its own size, and what it leaves is dealt to the others by weight until none is above.

Cases: null text has size 0 and takes 0; null source is a source of its own; repeated rows are rows of their own, and
equal ones take words by turns of their order, which all runs agree on; an empty table gives an empty result; clashing
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import join_rows, prefix_sums, rows_of, spread, stored, with_keys, word_count

#: Buckets that the hash-random keys of a source are range-split into hold about so many rows.
BUCKET_ROWS = 2048


def ranked_sources(stats: DataFrame) -> DataFrame:
    """Adds `_i`, the place of each source (one row each) by code point, null last: a range sort, and a sum over its partitions."""
    at = F.monotonically_increasing_id()  # partition, then row in it: fixed by the sort, and kept in the stored table
    s = stats.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_at", at)
    s = stored(s, "sources")
    s = s.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    parts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return s.join(F.broadcast(parts), "_part").withColumn("_i", F.col("_base") + F.col("_row")).drop("_at", "_part", "_row", "_base")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float, max_rounds: int = 1000) -> DataFrame:
    """Adds target to sizes(source, source_size, ...): shares by weight, where sources above their cap stop at it and leave the
    rest to the others. Each round fills the sources that the level reaches: one aggregate of a few numbers, no sort over sources."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    s = ranked_sources(sizes).withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    level, every, n_full = 0.0, None, -1
    for _ in range(max_rounds):
        full = F.col("_cap") <= F.lit(level) * F.col("_w")
        # Whole numbers sum to the same value in every order.
        r = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("source_size"))).alias("full"), F.sum(F.when(~full, F.col("_w"))).alias("w"), F.count_if(full).alias("n")).first()
        every = r["all"] or 0
        if r["n"] == n_full or not r["w"]:
            break
        n_full, level = r["n"], (every * share - (r["full"] or 0) * float(cap)) / r["w"]
    else:
        raise RuntimeError(f"targets did not settle in {max_rounds} rounds")
    full = F.col("_cap") <= F.lit(level) * F.col("_w")
    return s.withColumn("target", F.when(full, F.col("_cap")).otherwise(F.lit(level) * F.col("_w"))).drop("_i", "_w", "_cap")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", seed: int = 8) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken: the words that the mix takes of each row, repeats counted."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    d = stored(d.withColumn("key", spread(62, F.lit(seed), "doc_id", "text_hash")), "mix")
    stats = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    # Keys are uniform, so equal key ranges are an even range split of each source, as fine as its rows need.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / BUCKET_ROWS))).cast("int")
    t = stored(source_targets(stats, list(weights), share, cap).select(F.col("source").alias("_source"), "source_size", "target", bits.alias("_bits")), "targets")
    # One small row a source: Spark broadcasts the table as long as its size allows it, and else splits what a large source holds.
    x = d.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    x = x.withColumn("bucket", F.expr("shiftright(key, 62 - _bits)"))
    x = prefix_sums(x, ["source"], ["key", "doc_id", "text_hash"], "bucket", "size", "_before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return x.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, the last time if only in part; those it takes nothing of go."""
    source, id_col, text_col = (options.get(k, v) for k, v in (("source_col", "source"), ("id_col", "doc_id"), ("text_col", "text")))
    mix = mix_sources(docs, **options)
    copies = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("long")
    key = ["doc_id", "text_hash", "source"]
    mix = mix.groupBy(*key).agg(F.sum(copies).alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    d = with_keys(docs, doc_id=F.col(id_col), text_hash=F.xxhash64(F.col(text_col)), source=F.col(source).cast("string"))
    one = join_rows(d, mix.where("rows = 1"), key, "inner").withColumn("n", F.col("copies"))
    # Equal rows (one id, text and source) deal their copies out among themselves.
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("text_hash"))
    many = join_rows(d, mix.where("rows > 1"), key, "inner").withColumn("n", F.floor(F.col("copies") / F.col("rows")) + F.when(turn <= F.col("copies") % F.col("rows"), 1).otherwise(0))
    return rows_of(one.unionByName(many).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))))
