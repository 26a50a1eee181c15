"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points (virtual nodes) on a ring of hashes; a document lies where the hash of its text puts it
and belongs to the next point clockwise. A shard holds at most its bound; what overflows continues clockwise to the next
point whose shard has room. Equal texts lie at one place of the ring and so stay in one shard unless it is full.

Only counts per arc (documents between two points; as many arcs as points) reach the driver, which fills the
shards there and sends back which ranks of each arc go where. The rank of a document in ring order comes from a
range-partitioned sort by (place, doc_id), so that a text with a third of all rows spreads over many tasks.

With ``slack`` 0 the bounds are floor or ceiling of the mean: row counts are at most one apart (law ``rows``). A positive slack
allows each shard ``ceil((1 + slack) * mean)`` rows and moves fewer documents when shards are added.

Null texts are empty; null doc_ids sort first; repeated rows each take a slot. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waybill.llm.common import mix
from waybill.session import cut_lineage

SHARDS = 24
VIRTUAL_NODES = 64


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every point, sorted by place; places are signed 64-bit hashes."""
    keys = np.arange(shards * virtual_nodes, dtype=np.uint64) + np.uint64(1)
    places = mix(mix(keys) + np.uint64(0x5851F42D4C957F2D)).astype(np.int64)
    return sorted(zip(places.tolist(), (i // virtual_nodes for i in range(shards * virtual_nodes))))


def fill(points: list[tuple[int, int]], counts: dict[int, int], bounds: list[int]) -> list[tuple[int, int, int, int]]:
    """Pieces (arc, first rank, shard, first slot): from that rank of the arc on, documents go to the shard from that slot on.

    Arcs keep their own documents as far as the shard's bound allows, in ring order; the rest moves clockwise.
    """
    n = len(points)
    left, slots = list(bounds), [0] * len(bounds)
    pieces: list[tuple[int, int, int, int]] = []
    over: list[tuple[int, int, int]] = []
    for arc in range(n + 1):  # arc n lies behind the last point and belongs to the first, where the ring closes
        count, shard = counts.get(arc, 0), points[arc % n][1]
        stay = min(count, left[shard])
        if stay:
            pieces.append((arc, 0, shard, slots[shard]))
            left[shard] -= stay
            slots[shard] += stay
        if count > stay:
            over.append((arc, stay, count))
    for arc, rank, count in over:
        at = arc
        while rank < count:
            at = (at + 1) % n
            shard = points[at][1]
            take = min(count - rank, left[shard])
            if take:
                pieces.append((arc, rank, shard, slots[shard]))
                left[shard] -= take
                slots[shard] += take
                rank += take
    return sorted(pieces)


def bounds_of(total: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-(-int(total * (1 + slack)) // shards) + 1] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def assign(documents: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard (null: it holds for law ``key`` only)."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    # Rows of one text and no id are told apart by a number that is written with them, so that they too are cut into ranges.
    placed = cut_lineage(documents.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_place"),
        F.xxhash64(F.monotonically_increasing_id()).alias("_spread")))
    # Written once, so that every later read sees the same partitions and the same order inside them.
    order = ["_place", "doc_id", "size", "_spread"]
    ranked = cut_lineage(
        placed.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))

    points = ring(shards, virtual_nodes)
    places = np.array([p for p, _ in points])

    @F.pandas_udf("int")
    def arc_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, place.to_numpy()).astype(np.int32))

    ranked = ranked.withColumn("_arc", arc_of("_place"))
    counted = ranked.groupBy("_part", "_arc").agg(F.count("*").alias("n"), F.min("_row").alias("low")).collect()
    # At most partitions + arcs rows: each partition is a range of places, hence of arcs.
    total = sum(r["n"] for r in counted)
    counts: dict[int, int] = {}
    offsets = []
    for r in sorted(counted, key=lambda r: (r["_part"], r["low"])):
        offsets.append((r["_part"], r["_arc"], r["low"], counts.get(r["_arc"], 0)))
        counts[r["_arc"]] = counts.get(r["_arc"], 0) + r["n"]
    pieces = fill(points, counts, bounds_of(total, shards, slack))

    begun = spark.createDataFrame(offsets, "_part int, _arc int, _low long, _base long")
    ends = {}
    for arc_no, rank, shard, slot in reversed(pieces):
        ends.setdefault(arc_no, []).append((rank, shard, slot))
    plan = spark.createDataFrame(
        [(a, [{"rank": r, "shard": s, "slot": t} for r, s, t in ps]) for a, ps in ends.items()],
        "_arc int, _pieces array<struct<rank: long, shard: int, slot: long>>")
    # Both tables have as many rows as there are partitions and arcs, whatever the documents.
    rank = F.col("_base") + F.col("_row") - F.col("_low")
    return (
        ranked.join(F.broadcast(begun), ["_part", "_arc"]).join(F.broadcast(plan), "_arc")
        .withColumn("_rank", rank)
        .withColumn("_piece", F.filter("_pieces", lambda p: p["rank"] <= F.col("_rank"))[0])
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law") if not slack else F.lit("bounded").alias("law"),
                F.col("_piece.shard").alias("shard"), (F.col("_piece.slot") + F.col("_rank") - F.col("_piece.rank")).alias("slot"),
                F.lit(None).cast("int").alias("grown_shard")))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write the documents as one folder per shard (``shard=N``), rows of a shard spread over its writing tasks.

    A document goes with its own assignment: both are joined by doc_id, which has to be unique and not null.
    """
    placed = assign(documents, shards, **options).select("doc_id", "shard", "slot")
    documents.drop("shard", "slot").join(placed, "doc_id").write.partitionBy("shard").parquet(path)
