"""Batch lifecycles from the audit log: committed, replayed, timed out, committed late.

An event id's log is a sequence of reads and commits. A commit closes the current episode; the
next read opens another. Inside an episode every read after the first is a replay, and a read
that is followed by nothing until the first tick past its threshold counts as failed. Time is
event time in whole microseconds, ticks lie on multiples of the interval, and an event exactly at
a tick comes before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from waybill.operators.ordered import SEG, Ordered
from waybill.schemas import (
    BATCH_READ, COMMITTED, ESTIMATED_FAILED, LATE_COMMIT, OFFSET_COMMITTED, OUTCOME, RANGES, REPLAY_OBSERVED,
)
from waybill.session import micros

_SEEN = T.StructType([
    T.StructField("t", T.LongType()),
    T.StructField("rc", T.IntegerType()),
    T.StructField("ranges", RANGES),
])
_START = T.StructType([
    T.StructField("t", T.LongType()),
    T.StructField("grp", T.StringType()),
    T.StructField("topic", T.StringType()),
])


def next_tick(t: Column, threshold_us: int, tick_us: int) -> Column:
    """First tick strictly later than ``t`` plus the threshold."""
    past = t + F.lit(threshold_us)
    return (past - F.pmod(past, F.lit(tick_us))) + F.lit(tick_us)


def annotate(
    audit: DataFrame,
    timeout: str = "60 seconds",
    extra: str = "30 seconds",
    tick: str = "10 seconds",
    horizon: Column | None = None,
    order: Sequence[str] = ("timestamp", "stage"),
    **split,
) -> DataFrame:
    """Each read and commit with its place in its episode.

    Adds ``_n`` (reads so far in the episode), ``_tb`` (timeouts before the row), ``_fired`` and
    ``_tick`` (whether and when the read timed out), ``_start`` and ``_prev`` (first read, previous read).
    """
    threshold_us, tick_us = micros(timeout) + micros(extra), micros(tick)
    events = audit.where(F.col("stage").isin(BATCH_READ, OFFSET_COMMITTED)).withColumns({
        "_t": F.unix_micros("timestamp"),
        "_read": F.col("stage") == BATCH_READ,
    })
    o = Ordered(events, ["eventId"], list(order), **split)
    w = o.window
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = o.earlier_segments()

    rows = o.with_carry(
        o.rows,
        {"_first": F.min("_t")},
        [{"_next_seg": F.lead("_first").over(o.segments())}],
        {"_next_seg": T.LongType()},
    )
    seen = F.struct(F.col("_t").alias("t"), F.col("recordCount").alias("rc"), F.col("partitionRanges").cast(RANGES).alias("ranges"))
    opens = F.struct(F.col("_t").alias("t"), F.col("consumerGroup").alias("grp"), F.col("sourceTopic").alias("topic"))
    reads = F.col("_read").cast("bigint")
    rows = rows.withColumns({
        "_next": F.coalesce(F.lead("_t").over(w), F.col("_next_seg")),
        "_reads": F.sum(reads).over(upto),
        "_prev": F.last(F.when(F.col("_read"), seen), ignorenulls=True).over(before),
        "_tick": next_tick(F.col("_t"), threshold_us, tick_us),
    })
    # The horizon limits open tails only: a tick before a later event has run, whatever the horizon.
    ran = F.lit(True) if horizon is None else F.col("_tick") <= F.unix_micros(horizon)
    fired = F.col("_read") & F.when(F.isnull("_next"), ran).otherwise(F.col("_tick") < F.col("_next"))
    rows = rows.withColumn("_fired", fired)
    rows = rows.withColumns({
        "_fires": F.coalesce(F.sum(F.col("_fired").cast("bigint")).over(before), F.lit(0)),
        "_reads0": F.last(F.when(~F.col("_read"), F.col("_reads")), ignorenulls=True).over(before),
    })
    rows = rows.withColumn("_n", F.col("_reads") - F.coalesce("_reads0", F.lit(0)))
    rows = rows.withColumns({
        "_fires0": F.last(F.when(~F.col("_read"), F.col("_fires")), ignorenulls=True).over(before),
        "_start": F.last(F.when(F.col("_read") & (F.col("_n") == 1), opens), ignorenulls=True).over(upto),
    })
    rows = rows.withColumn("_tb", F.col("_fires") - F.coalesce("_fires0", F.lit(0)))

    # What a segment hands on: reads and timeouts of the episode it leaves open, that episode's first
    # read, and its latest read.
    commit = ~F.col("_read")
    at = o.position
    last_read = F.max_by(seen, F.when(F.col("_read"), at))
    rows = o.with_carry(
        rows,
        {
            "_open_n": F.sum(reads) - F.coalesce(F.max(F.when(commit, F.col("_reads"))), F.lit(0)),
            "_open_f": F.sum(F.col("_fired").cast("bigint")) - F.coalesce(F.max(F.when(commit, F.col("_fires"))), F.lit(0)),
            "_closes": F.max(commit),
            "_last_read": last_read,
            "_last_start": F.max_by("_start", at),
        },
        [
            {
                "_n_before": F.coalesce(F.sum("_open_n").over(earlier), F.lit(0)),
                "_f_before": F.coalesce(F.sum("_open_f").over(earlier), F.lit(0)),
                "_in_prev": F.last("_last_read", ignorenulls=True).over(earlier),
            },
            {
                "_in_n": F.col("_n_before") - F.coalesce(
                    F.last(F.when(F.col("_closes"), F.col("_n_before")), ignorenulls=True).over(earlier), F.lit(0)),
                "_in_f": F.col("_f_before") - F.coalesce(
                    F.last(F.when(F.col("_closes"), F.col("_f_before")), ignorenulls=True).over(earlier), F.lit(0)),
            },
            {
                "_in_start": F.last(
                    F.when((F.col("_open_n") > 0) & (F.col("_closes") | (F.col("_in_n") == 0)), F.col("_last_start")),
                    ignorenulls=True,
                ).over(earlier),
            },
        ],
        {"_in_n": T.LongType(), "_in_f": T.LongType(), "_in_prev": _SEEN, "_in_start": _START},
    )
    if not o.split:
        return rows.drop("_in_n", "_in_f", "_in_prev", "_in_start", "_next_seg", SEG)
    continues = F.isnull("_reads0") & (F.col("_in_n") > 0)
    return rows.withColumns({
        "_start": F.when(continues, F.col("_in_start")).otherwise(F.col("_start")),
        "_n": F.col("_n") + F.when(continues, F.col("_in_n")).otherwise(0),
        "_tb": F.col("_tb") + F.when(continues, F.col("_in_f")).otherwise(0),
        "_prev": F.coalesce("_prev", "_in_prev"),
    }).drop("_in_n", "_in_f", "_in_prev", "_in_start", "_next_seg", SEG)


def outcomes_of(rows: DataFrame) -> DataFrame:
    """Outcome rows of annotated events; a replay that also times out gives two."""

    def outcome(name: Column | str, last_seen: Column, observed: Column, rc: Column, timeouts: Column, ranges: Column):
        return F.struct(
            F.col("eventId"),
            (F.lit(name) if isinstance(name, str) else name).alias("outcome"),
            F.col("_start.grp").alias("consumerGroup"),
            F.col("_start.topic").alias("sourceTopic"),
            F.timestamp_micros("_start.t").alias("firstSeenAt"),
            F.timestamp_micros(last_seen).alias("lastSeenAt"),
            F.timestamp_micros(observed).alias("observedAt"),
            rc.cast("int").alias("recordCount"),
            (F.col("_n") - 1).cast("int").alias("replayCount"),
            timeouts.cast("int").alias("timeoutCount"),
            ranges.cast(RANGES).alias("partitionRanges"),
        )

    prev = F.col("_prev")
    replay = outcome(REPLAY_OBSERVED, prev["t"], F.col("_t"), prev["rc"], F.col("_tb"), prev["ranges"])
    closed = outcome(
        F.when(F.col("_tb") > 0, LATE_COMMIT).otherwise(COMMITTED),
        F.col("_t"), F.col("_t"), prev["rc"], F.col("_tb"), prev["ranges"],
    )
    failed = outcome(
        ESTIMATED_FAILED, F.col("_t"), F.col("_tick"), F.col("recordCount"), F.col("_tb") + 1, F.col("partitionRanges")
    )
    main = F.when(F.col("_read") & (F.col("_n") > 1), replay).when(~F.col("_read") & (F.col("_n") >= 1), closed)
    return rows.select(F.explode(F.array_compact(F.array(main, F.when(F.col("_fired"), failed)))).alias("o")).select(
        *[F.col(f"o.{f.name}") for f in OUTCOME.fields]
    )


def lifecycle_batch(audit: DataFrame, *args, **kwargs) -> DataFrame:
    """All outcomes of an audit log. Arguments as for :func:`annotate`.

    ``horizon`` is the time up to which ticks have run after an id's last event; without it every open read runs to its
    tick. By default a read comes before a commit of the same time.
    """
    return outcomes_of(annotate(audit, *args, **kwargs))


def open_episodes(audit: DataFrame, *args, **kwargs) -> DataFrame:
    """Entries that the log leaves open, timed out or not: ids whose latest event is a read. Arguments as for :func:`annotate`."""
    rows = annotate(audit, *args, **kwargs).where(F.col("_read") & F.isnull("_next"))
    fired = F.col("_fired")
    return rows.select(
        "eventId", F.col("_start.grp").alias("consumerGroup"), F.col("_start.topic").alias("sourceTopic"),
        F.timestamp_micros("_start.t").alias("firstSeenAt"), F.col("timestamp").alias("lastSeenAt"),
        F.when(fired, F.timestamp_micros("_tick")).alias("timedOutAt"), "recordCount", (F.col("_n") - 1).cast("int").alias("replayCount"),
        (F.col("_tb") + fired.cast("int")).cast("int").alias("timeoutCount"), F.col("partitionRanges").cast(RANGES).alias("partitionRanges"))


def lifecycle_summary(audit: DataFrame, *args, **kwargs) -> DataFrame:
    """One row: pending, replays, estimatedFailed, lateCommits, committed, unknownCommits.

    ``pending`` counts ids whose latest event is a read that has not timed out.
    """
    rows = annotate(audit, *args, **kwargs)
    read, n = F.col("_read"), F.col("_n")

    def count(test: Column, name: str) -> Column:
        return F.coalesce(F.sum(test.cast("bigint")), F.lit(0)).alias(name)

    return rows.agg(
        count(read & F.isnull("_next") & ~F.col("_fired"), "pending"),
        count(read & (n > 1), "replays"),
        count(F.col("_fired"), "estimatedFailed"),
        count(~read & (n >= 1) & (F.col("_tb") > 0), "lateCommits"),
        count(~read & (n >= 1) & (F.col("_tb") == 0), "committed"),
        count(~read & (n == 0), "unknownCommits"),
    )
