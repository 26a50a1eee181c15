"""Connected components of a graph of links, with joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waybill.session import cut_lineage


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of a link ``a``, ``b``; the component is its smallest node.

    Alternates large and small stars: each node hangs its larger neighbours, then its smaller ones, under the
    smallest it knows, until nothing changes. That takes about log2(nodes) rounds of two shuffles; a star or a hub with many
    links is a grouping with partial results and a join, never a list in one task. Every round is written to the
    shared folder, so that a lost executor costs one round at most.
    """
    edges = links.select("a", "b").filter("a <> b")
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Nodes that are their neighbourhood's minimum hang under themselves and drop out here.
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
        state = now
    raise RuntimeError("components did not settle")
