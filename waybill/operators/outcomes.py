"""Counters, rates and concentrations derived from outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from waybill.functions.columns import label_or_unknown
from waybill.schemas import BATCH_READ, COMMITTED, ESTIMATED_FAILED, LATE_COMMIT, OUTCOMES, REPLAY_OBSERVED

_LABELS = ("outcome", "consumer_group", "source_topic", "partition")


def outcome_counts(outcomes: DataFrame, at: Column | None = None) -> DataFrame:
    """All counters of the outcome log, one row per (metric, label values) and per ``at`` if given.

    Every outcome becomes a short list of increments, so one grouping, combined before its shuffle,
    serves all counters; the same plan runs on a stream. Labels a counter does not have are null.
    ``audit_batches_seen_total`` counts outcome messages. The replay and timeout counters add the
    running count carried by each outcome, so one batch may add 1, 2, ... ; the ``_events_total``
    counters count each replay and each timeout once.
    """
    outcome, group, topic = (label_or_unknown(F.col(c)) for c in ("outcome", "consumerGroup", "sourceTopic"))
    none = F.lit(None).cast("string")

    def step(metric: str, by: Column, inc: Column, partition: Column = none) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), by.alias("outcome"), group.alias("consumer_group"),
            topic.alias("source_topic"), partition.alias("partition"), inc.cast("bigint").alias("inc"),
        )

    one = F.lit(1)
    steps = F.array(
        step("audit_outcomes_total", outcome, one),
        step("audit_batches_seen_total", none, one),
        F.when(F.col("replayCount") > 0, step("audit_replay_count_total", none, F.col("replayCount"))),
        F.when(F.col("timeoutCount") > 0, step("audit_timeout_count_total", none, F.col("timeoutCount"))),
        F.when(F.col("outcome") == REPLAY_OBSERVED, step("audit_replay_events_total", none, one)),
        F.when(F.col("outcome") == ESTIMATED_FAILED, step("audit_timeout_events_total", none, one)),
    )
    per_range = F.transform(
        F.coalesce("partitionRanges", F.array().cast("array<struct<partition:int,offsetMin:bigint,offsetMax:bigint,recordCount:int>>")),
        lambda r: step("audit_partition_outcomes_total", outcome, one, r["partition"].cast("string")),
    )
    extra = {} if at is None else {"at": at}
    return (
        outcomes.select(F.explode(F.concat(F.array_compact(steps), per_range)).alias("s"), *[c.alias(n) for n, c in extra.items()])
        .groupBy("s.metric", *[f"s.{c}" for c in _LABELS], *extra)
        .agg(F.sum("s.inc").alias("value"))
    )


def counter_form(counts: DataFrame, at: Column) -> DataFrame:
    """Counters with a column per label as samples: ``metric, labels, ts, value, kind``."""
    pairs = [x for c in _LABELS for x in (F.lit(c), F.col(c))]
    labels = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    return counts.select(
        "metric", labels.alias("labels"), at.alias("ts"), F.col("value").cast("double").alias("value"), F.lit("counter").alias("kind"))


def outcome_counters(outcomes: DataFrame, at: Column | None = None) -> DataFrame:
    """The counters in sample form: ``metric, labels, ts, value, kind``."""
    return counter_form(outcome_counts(outcomes), F.current_timestamp() if at is None else at)


def counter_samples(outcomes: DataFrame, step: str) -> DataFrame:
    """Counters as a time series: the running value of each after every ``step`` that changed it."""
    counts = outcome_counts(outcomes, F.window("observedAt", step)["end"])
    running = Window.partitionBy("metric", *_LABELS).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pairs = [x for c in _LABELS for x in (F.lit(c), F.col(c))]
    return counts.select(
        "metric",
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("labels"),
        F.col("at").alias("ts"),
        F.sum("value").over(running).cast("double").alias("value"),
        F.lit("counter").alias("kind"),
    )


def outcome_rates(outcomes: DataFrame, audit: DataFrame) -> DataFrame:
    """Failure and replay rate over the batches read, late commits over failures, per group and topic."""
    by = {"consumer_group": label_or_unknown(F.col("consumerGroup")), "source_topic": label_or_unknown(F.col("sourceTopic"))}
    # Both logs are narrowed to the counted flags and grouped together: one shuffle, no join.
    seen = outcomes.select(
        *[c.alias(n) for n, c in by.items()],
        F.lit(0).alias("read"),
        *[(F.col("outcome") == o).cast("int").alias(a) for o, a in _RATE_INPUTS.items()],
    )
    reads = audit.where(F.col("stage") == BATCH_READ).select(
        *[c.alias(n) for n, c in by.items()], F.lit(1).alias("read"), *[F.lit(0).alias(a) for a in _RATE_INPUTS.values()]
    )
    sums = seen.unionByName(reads).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("read", *_RATE_INPUTS.values())])
    return sums.select(
        *by,
        F.col("read").alias("batches_read"),
        F.try_divide("failed", "read").alias("estimated_failure_rate"),
        F.try_divide("replayed", "read").alias("replay_rate"),
        F.try_divide("late", "failed").alias("late_commit_ratio"),
    )


_RATE_INPUTS = {ESTIMATED_FAILED: "failed", REPLAY_OBSERVED: "replayed", LATE_COMMIT: "late"}


def replay_severity(outcomes: DataFrame, by: Sequence[str] = ("consumerGroup", "sourceTopic")) -> DataFrame:
    """Summed replay counts by group, topic or ``partition``."""
    rows = outcomes.where(F.col("replayCount") > 0)
    if "partition" in by:
        rows = rows.withColumn("partition", F.explode("partitionRanges.partition"))
    return rows.groupBy(*by).agg(F.sum("replayCount").alias("replays"), F.max("replayCount").alias("worst"))


def timeout_pressure(outcomes: DataFrame, window: str) -> DataFrame:
    """Summed timeout counts and failed batches per time window."""
    return (
        outcomes.groupBy(F.window("observedAt", window).alias("w"))
        .agg(
            F.sum("timeoutCount").alias("timeouts"),
            F.sum((F.col("outcome") == ESTIMATED_FAILED).cast("bigint")).alias("failed"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "timeouts", "failed")
    )


def replay_concentration(outcomes: DataFrame) -> DataFrame:
    """Share of each partition in the replays of its group and topic."""
    counts = (
        outcomes.where(F.col("outcome") == REPLAY_OBSERVED)
        .select(
            label_or_unknown(F.col("consumerGroup")).alias("consumer_group"),
            label_or_unknown(F.col("sourceTopic")).alias("source_topic"),
            F.explode("partitionRanges.partition").alias("partition"),
        )
        .groupBy("consumer_group", "source_topic", "partition")
        .agg(F.count(F.lit(1)).alias("replays"))
    )
    whole = F.sum("replays").over(Window.partitionBy("consumer_group", "source_topic"))
    return counts.withColumn("share", F.col("replays") / whole)


def export_totals(counts: DataFrame) -> DataFrame:
    """One row: each outcome's total and the batches seen, over all label sets of ``outcome_counts``."""
    def total(test: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0)).alias(name)

    each = [
        total((F.col("metric") == "audit_outcomes_total") & (F.col("outcome") == o), f"audit_{o.lower()}_total")
        for o in OUTCOMES
    ]
    return counts.agg(*each, total(F.col("metric") == "audit_batches_seen_total", "audit_batches_seen_total"))


def observed(outcomes: DataFrame, name: str | Observation = "outcomes") -> DataFrame:
    """The same rows, with the lifecycle totals reported as they pass.

    On a stream they appear under ``name`` in each progress report, in batch through an ``Observation``.
    """
    totals = {
        REPLAY_OBSERVED: "replays", ESTIMATED_FAILED: "estimatedFailed", LATE_COMMIT: "lateCommits", COMMITTED: "committed",
    }
    return outcomes.observe(
        name, *[F.count(F.when(F.col("outcome") == o, 1)).alias(label) for o, label in totals.items()]
    )
