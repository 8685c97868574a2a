"""Connected components of a links table, by rounds of alternating stars; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, stored


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node of its component. Nodes are longs.

    Large star: each node links its larger neighbours to the smallest of its neighbourhood. Small star: it does so
    with its smaller ones. Both keep components, and end in stars after about log(n) rounds. Minima are taken before
    rows meet, and joins are by node, so that Spark can split the rows of a node with very many links."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = stored(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "small")
        sums = [d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for d in (edges, new)]
        discard(large, edges)
        edges = new
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # In stars, v is the smallest node of each component.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
