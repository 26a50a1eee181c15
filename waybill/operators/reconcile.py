"""Correlation of reads with commits, and of a sink with its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from waybill.schemas import BATCH_READ, OFFSET_COMMITTED, SINK_KEY
from waybill.session import broadcast_if_small


def _by_event(audit: DataFrame) -> DataFrame:
    """Reads and commits per event id: one grouping, combined before the shuffle, in place of a
    many-to-many join of the two stages."""
    read, commit = F.col("stage") == BATCH_READ, F.col("stage") == OFFSET_COMMITTED
    return audit.where(read | commit).groupBy("eventId").agg(
        F.sum(read.cast("bigint")).alias("reads"),
        F.sum(commit.cast("bigint")).alias("commits"),
        F.min(F.when(read, F.col("timestamp"))).alias("first_read"),
        F.max(F.when(read, F.col("timestamp"))).alias("last_read"),
        F.min(F.when(commit, F.col("timestamp"))).alias("first_commit"),
        F.max(F.when(commit, F.col("timestamp"))).alias("last_commit"),
    )


def read_commit_pairs(audit: DataFrame) -> DataFrame:
    """Event ids that were both read and committed."""
    return _by_event(audit).where((F.col("reads") > 0) & (F.col("commits") > 0))


def unmatched_reads(audit: DataFrame) -> DataFrame:
    """Event ids read and never committed."""
    return _by_event(audit).where((F.col("reads") > 0) & (F.col("commits") == 0)).drop(
        "commits", "first_commit", "last_commit"
    )


def unknown_commits(audit: DataFrame) -> DataFrame:
    """Event ids committed without any read."""
    return _by_event(audit).where((F.col("reads") == 0) & (F.col("commits") > 0)).drop("reads", "first_read", "last_read")


def _place(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset")
    )


def sink_missing(records: DataFrame, sink: DataFrame) -> DataFrame:
    """Source places (topic, partition, offset) that the sink does not hold.

    The sink's keys are made distinct first, so a place written very often costs one row.
    """
    return _place(records).join(sink.select(*SINK_KEY).distinct(), list(SINK_KEY), "left_anti")


def sink_completeness(records: DataFrame, sink: DataFrame) -> DataFrame:
    """Missing places counted per topic and partition, with their range."""
    return sink_missing(records, sink).groupBy("kafka_topic", "kafka_partition").agg(
        F.count(F.lit(1)).alias("missing"),
        F.min("kafka_offset").alias("first_missing"),
        F.max("kafka_offset").alias("last_missing"),
    )


def sink_duplicates(sink: DataFrame, keys: Sequence[str] = SINK_KEY) -> DataFrame:
    """Keys held by more than one sink row."""
    return sink.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: Column, start: Column, end: Column, width: int,
    broadcast_rows: int = 0,
) -> DataFrame:
    """Inner join of points with the intervals holding them (``start <= at <= end``), without a cross join.

    Both sides are cut into buckets of ``width``: a point falls in one, an interval is repeated for
    each bucket it touches, and the join is an equality on keys and bucket. A point thus meets only
    the intervals of its bucket, and adaptive execution splits a bucket that turns out large. With
    ``broadcast_rows`` the repeated intervals are counted, and broadcast if there are no more of them,
    so that the points need no shuffle. ``at``, ``start`` and ``end`` are whole numbers.
    """
    step = F.lit(width)
    left = points.withColumns({"_at": at, "_bucket": F.floor(at / step)})
    right = intervals.withColumns({"_start": start, "_end": end}).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("_start") / step), F.floor(F.col("_end") / step)))
    )
    if broadcast_rows:
        right = broadcast_if_small(right, broadcast_rows)
    hit = F.col("_at").between(F.col("_start"), F.col("_end"))
    return left.join(right, [*keys, "_bucket"]).where(hit).drop("_bucket", "_at", "_start", "_end")


def partial_batches(batches: DataFrame, sink: DataFrame, batch_cols: Sequence[str], bucket: int = 4096) -> DataFrame:
    """Batches of which the sink holds only some records.

    Counts distinct places per batch range, so duplicated sink rows do not hide a gap. ``batches``
    is the output of ``batch_reads``.
    """
    ranges = batches.select(*batch_cols, F.col("sourceTopic").alias("kafka_topic"), F.explode("partitionRanges").alias("r")).select(
        *batch_cols, "kafka_topic", F.col("r.partition").alias("kafka_partition"),
        F.col("r.offsetMin").alias("lo"), F.col("r.offsetMax").alias("hi"),
    )
    places = sink.select(*SINK_KEY).distinct()
    written = interval_join(
        places, ranges, ["kafka_topic", "kafka_partition"], F.col("kafka_offset"), F.col("lo"), F.col("hi"), bucket
    ).groupBy(*batch_cols).agg(F.count(F.lit(1)).alias("written"))
    return (
        batches.select(*batch_cols, "eventId", F.col("recordCount").cast("bigint").alias("expected"))
        .join(written, list(batch_cols), "left")
        .withColumn("written", F.coalesce("written", F.lit(0)))
        .where(F.col("written") < F.col("expected"))
        .withColumn("written_share", F.col("written") / F.col("expected"))
    )


def sink_stats(write_log: DataFrame, start: Column, last_log: Column, now: Column) -> DataFrame:
    """Totals and rates of a write log with ``at, consumed, written, failed, partial`` per batch.

    Interval figures cover batches after ``last_log``; elapsed time is at least a millisecond; a failed
    batch counts as one error whatever its size.
    """
    recent = F.col("at") > last_log

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")

    def interval(name: str) -> Column:
        return F.coalesce(F.sum(F.when(recent, F.col(name))), F.lit(0)).cast("bigint")

    sums = write_log.agg(
        total("consumed").alias("total_consumed"), total("written").alias("total_written"),
        total("failed").alias("write_errors"), total("partial").alias("partial_writes"),
        interval("consumed").alias("interval_consumed"), interval("written").alias("interval_written"),
    )
    return with_rates(sums, start, last_log, now)


def with_rates(sums: DataFrame, start: Column, last_log: Column, now: Column) -> DataFrame:
    """Interval and lifetime rates of summed counts."""
    def elapsed(since: Column) -> Column:
        return F.greatest((F.unix_micros(now) - F.unix_micros(since)) / 1e6, F.lit(0.001))

    return sums.withColumns({
        "interval_consumed_rate": F.col("interval_consumed") / elapsed(last_log),
        "interval_write_rate": F.col("interval_written") / elapsed(last_log),
        "lifetime_consumed_rate": F.col("total_consumed") / elapsed(start),
        "lifetime_write_rate": F.col("total_written") / elapsed(start),
    })
