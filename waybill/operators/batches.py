"""Polled batches: partition ranges, fingerprints, read and commit events, commit offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waybill.functions.columns import fingerprint
from waybill.operators.ordered import current_batch
from waybill.schemas import BATCH_READ, OFFSET_COMMITTED, RANGES


def partition_ranges(records: DataFrame, batch_cols: Sequence[str]) -> DataFrame:
    """First and last offset, count and latest timestamp per (batch, partition)."""
    return records.groupBy(*batch_cols, "topic", "partition").agg(
        F.min("offset").alias("offsetMin"),
        F.max("offset").alias("offsetMax"),
        F.count(F.lit(1)).cast("int").alias("recordCount"),
        F.max("timestamp").alias("lastTimestamp"),
    )


def batch_reads(
    records: DataFrame, batch_cols: Sequence[str], group: str, at: Column | None = None
) -> DataFrame:
    """One BATCH_READ event per batch, keyed by the batch fingerprint.

    The ranges of a batch are as many as the partitions it touches, so the list built here is
    bounded by the topic's partition count and not by the number of records. ``at`` is the time
    of the read; by default the batch's latest record timestamp, which repeats on a rerun.
    """
    ranges = partition_ranges(records, batch_cols)
    batches = ranges.groupBy(*batch_cols, "topic").agg(
        F.sort_array(F.collect_list(F.struct("partition", "offsetMin", "offsetMax", "recordCount")))
        .cast(RANGES)
        .alias("partitionRanges"),
        F.sum("recordCount").cast("int").alias("recordCount"),
        F.max("lastTimestamp").alias("lastTimestamp"),
    )
    event_id = fingerprint(F.lit(group), F.col("topic"), F.col("recordCount"), F.col("partitionRanges"))
    return batches.select(
        *batch_cols,
        event_id.alias("eventId"),
        F.lit(BATCH_READ).alias("stage"),
        F.lit(group).alias("consumerGroup"),
        F.col("topic").alias("sourceTopic"),
        (F.col("lastTimestamp") if at is None else at).alias("timestamp"),
        "recordCount",
        "partitionRanges",
    )


def commit_events(reads: DataFrame, at: Column | None = None) -> DataFrame:
    """The OFFSET_COMMITTED event that acknowledges each read; it carries no counts or ranges."""
    return reads.withColumns({
        "stage": F.lit(OFFSET_COMMITTED),
        "timestamp": F.col("timestamp") if at is None else at,
        "recordCount": F.lit(0),
        "partitionRanges": F.array().cast(RANGES),
    })


def committed_batches(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], **split
) -> DataFrame:
    """Batch form of the commit event: commits of a consumer's log with the batch they acknowledge.

    ``log`` holds reads (with ``eventId``) and bare commits in ``stage``. A commit with no batch read
    since the commit before it acknowledges nothing and gives no row.
    """
    found = current_batch(
        log, keys, order, "eventId", F.col("stage") == BATCH_READ, F.col("stage") == OFFSET_COMMITTED, **split
    )
    return found.where(F.col("currentBatch").isNotNull()).withColumn("eventId", F.col("currentBatch")).drop("currentBatch")


def commit_offsets(records: DataFrame) -> DataFrame:
    """Next offset to read per (topic, partition)."""
    return records.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("nextOffset"))
