"""Sharding (op 12) by fixed virtual slots: ids are hashed into thousands of slots, bytes are summed up by slot, and a stored,
versioned map says which shard holds a slot. Rebalancing and growing edit the map by moving as few slots as they need.

A record's slot never changes, so only records of moved slots move. A slot that alone holds more than an eighth of a shard
(equal ids, null ids) is split into parts by hashes of row numbers; the map then has a row for each part.

The law is `bytes`: by the latest map, no slot can move from a larger shard to a smaller one and bring their sizes closer,
so two shards differ by less than the smallest slot of the larger one.

Cases: a null text has 0 bytes and the CRC of nothing; a null id is a key like others; repeated rows are rows of their own; an
empty table gives empty shards; all other columns are kept, inside `row`, where no name can clash. One record that is larger
than a shard's share fills a shard by itself.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import discard, scratch_path, stored, with_keys

SLOTS = 8192
#: A slot of more than this part of a shard's share is split.
SPLIT = 8
MAP = "version int, slot int, part int, shard int, n long, bytes long"


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text and 8 for its id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_sizes(keyed: DataFrame) -> list[tuple[int, int, int, int]]:
    """(slot, part, records, bytes): as many rows as there are slots and parts."""
    s = keyed.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return sorted(map(tuple, s.collect()))


def moved_slots(sizes: dict, owner: dict, shards: int, into: int | None = None) -> dict:
    """The owner of each slot after slots have moved to smaller shards, or to shard `into` alone, for as long as that evens sizes."""
    owner, load = dict(owner), [0] * shards
    held: list[list] = [[] for _ in range(shards)]  # (bytes, slot), in ascending order
    for slot, shard in owner.items():
        load[shard] += sizes[slot]
        held[shard].append((sizes[slot], slot))
    for h in held:
        h.sort()
    done: set[int] = set()
    while len(done) < shards - 1:
        rest = [i for i in range(shards) if i not in done]
        hi = max((i for i in rest if i != into), key=lambda i: (load[i], -i), default=None)
        lo = into if into is not None else min(rest, key=lambda i: (load[i], i))
        if hi is None or hi == lo:
            break
        gap = load[hi] - load[lo]
        # The largest slot of at most half the gap, else the smallest that is less than the gap; empty slots stay.
        at = bisect.bisect_right(held[hi], (gap // 2, (1 << 62, 0))) - 1
        if at < 0 or not held[hi][at][0]:
            at = bisect.bisect_right(held[hi], (0, (1 << 62, 0)))
        if at >= len(held[hi]) or held[hi][at][0] >= gap:
            done.add(hi)  # nothing of this shard can move, now or later, as gaps only shrink
            continue
        size, slot = held[hi].pop(at)
        bisect.insort(held[lo], (size, slot))
        load[hi], load[lo], owner[slot] = load[hi] - size, load[lo] + size, lo
    return owner


def write_map(spark: SparkSession, path: str, version: int, sizes: list[tuple], owner: dict) -> None:
    rows = [(version, slot, part, owner[slot, part], n, size) for slot, part, n, size in sizes]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def slot_map(spark: SparkSession, path: str, sizes: list[tuple], shards: int) -> int:
    """Version 0 deals slots out in turn, version 1 is edited for even bytes. Returns the latest version."""
    by, first = {(s, p): b for s, p, _, b in sizes}, {(s, p): (s + p) % shards for s, p, _, _ in sizes}
    write_map(spark, path, 0, sizes, first)
    write_map(spark, path, 1, sizes, moved_slots(by, first, shards))
    return 1


def grown_map(spark: SparkSession, path: str, version: int, shards: int) -> int:
    """The next version, for one shard more: slots move into the new shard only, until it is no smaller than others."""
    rows = [tuple(r) for r in read_map(spark, path, version).collect()]
    by, owner = {(r[1], r[2]): r[5] for r in rows}, {(r[1], r[2]): r[3] for r in rows}
    write_map(spark, path, version + 1, [(r[1], r[2], r[4], r[5]) for r in rows], moved_slots(by, owner, shards + 1, into=shards))
    return version + 1


def keyed_records(docs: DataFrame, shards: int, slots: int, id_col: str, text_col: str) -> DataFrame:
    """row, vslot, part, size; part is 0 but in slots that are too large for one shard."""
    keyed = with_keys(docs, vslot=slot_of(F.col(id_col), slots), part=F.lit(0), size=record_size(F.col(text_col)))
    sizes = slot_sizes(keyed)
    share = sum(s[3] for s in sizes) / shards
    large = {slot: -(-SPLIT * size // max(1, int(share))) for slot, _, n, size in sizes if n > 1 and size * SPLIT > share}
    if not large:
        return keyed
    # Row numbers must stay the same however often a task is run, so they are stored.
    keyed = stored(with_keys(docs, vslot=slot_of(F.col(id_col), slots), number=F.monotonically_increasing_id(), size=record_size(F.col(text_col))), "numbered")
    parts = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(large.items()) for x in kv]), F.col("vslot"))
    part = F.when(parts.isNotNull(), F.pmod(F.xxhash64("number"), parts)).otherwise(0)
    out = keyed.withColumn("part", part.cast("int")).drop("number")
    out.stored_at = keyed.stored_at
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Writes the records, as `row`, in folders `data/shard=...` in the order of slot and id, and the map in `map/version=...`."""
    spark = docs.sparkSession
    keyed = keyed_records(docs, shards, slots, id_col, text_col)
    version = slot_map(spark, f"{path}/map", slot_sizes(keyed), shards)
    where = read_map(spark, f"{path}/map", version).select("shard", F.col("slot").alias("vslot"), "part")  # no more rows than slots and parts
    x = keyed.join(F.broadcast(where), ["vslot", "part"]).select("row", "shard", "vslot", "part")
    order = ["shard", "vslot", "part", F.col(f"row.`{id_col}`")]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    x.write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(f"{path}/data")
    if hasattr(keyed, "stored_at"):
        discard(keyed)
    return version


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """row, vslot, shard, slot (the record's place in its shard, from 0) of what write_shards wrote of `like`'s columns."""
    kind = with_keys(like).select("row", F.lit(0).alias("vslot"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("shard")).schema
    x = spark.read.schema(kind).parquet(f"{path}/data").withColumn("_task", F.shiftright("at", 33))
    # A shard's rows lie in tasks one after another, and in each one after another: one count a shard and task.
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = x.groupBy("shard", "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("at").alias("_first"))
    runs = runs.select("shard", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return x.join(F.broadcast(runs), ["shard", "_task"]).select("row", "vslot", "shard", (F.col("at") + F.col("_shift")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, vslot, read back from the shards; grown_shard is null, as the law is `bytes`."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    write_shards(docs, path, shards, slots, id_col, text_col)
    text = F.col(f"row.`{text_col}`")
    x = read_shards(spark, path, docs)
    return x.select(
        F.col(f"row.`{id_col}`").alias("doc_id"), record_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )
