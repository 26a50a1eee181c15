"""Sink streams: persist first, acknowledge after."""

from __future__ import annotations

import logging
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from waybill.functions.columns import audit_json
from waybill.operators.batches import batch_reads, commit_events
from waybill.operators.outcomes import counter_form, outcome_counts
from waybill.sinks.tables import SinkSpec, to_sink_rows, write_sink
from waybill.session import newest_version, numbered, remove, run_of, written
from waybill.sinks.topics import AUDIT_PRODUCER, TopicSpec, keyed

_LOG = logging.getLogger(__name__)

EVERY_FIVE_SECONDS = {"processingTime": "5 seconds"}


def run_sink_stream(
    records: DataFrame,
    sink: SinkSpec,
    checkpoint: str,
    trigger: dict | None = None,
    audit: TopicSpec | None = None,
    group: str = "perf-group",
    write_log: str | None = None,
) -> StreamingQuery:
    """Write each micro-batch to the sink; its offsets count as read only after the write returned.

    A write that fails for good stops the query, and the next start repeats the same batch. Row ids
    are deterministic and each batch replaces its own files, so the repeat leaves no duplicates. A new checkpoint
    is a new run: its batches stand beside those of earlier runs and count as later.
    With ``audit`` a read event is published before the write and a commit event after it, at best effort: a
    failure to publish is logged and the sink goes on. The fingerprint of a repeated batch is the same, which
    is how a replay is recognised. With ``write_log`` every failed try and every written batch is a row that
    ``sink_stats`` understands.
    """
    spark = records.sparkSession
    earlier = numbered(spark, f"{sink.path}/generations", "run") if sink.path else []
    sink = replace(sink, run=run_of(spark, checkpoint, earlier))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = to_sink_rows(batch, deterministic_id=True, created_at=F.col("timestamp"))
        if audit is None and write_log is None:
            write_sink(rows, sink, batch_id)
            return
        batch.persist()
        try:
            if audit is not None:
                reads = batch_reads(batch.withColumn("_batch", F.lit(batch_id)), ["_batch"], group, F.current_timestamp())
                _publish(reads, audit, sink.run, batch_id, "read")
            try:
                write_sink(rows, sink, batch_id)
            except Exception:
                _log(batch, write_log, sink.run, batch_id, failed=True)
                raise
            _log(batch, write_log, sink.run, batch_id, failed=False)
            if audit is not None:
                _publish(commit_events(reads, F.current_timestamp()), audit, sink.run, batch_id, "commit")
        finally:
            batch.unpersist()

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_FIVE_SECONDS))
        .start()
    )


def _log(batch: DataFrame, path: str | None, run: int, batch_id: int, failed: bool) -> None:
    if path is None:
        return
    count = F.count(F.lit(1))
    row = batch.agg(
        F.current_timestamp().alias("at"), count.alias("consumed"), (F.lit(0).cast("bigint") if failed else count).alias("written"),
        F.lit(int(failed)).alias("failed"), F.lit(0).alias("partial"),
    )
    # A success replaces that of an earlier try of the batch, so a batch counts once; failures add up.
    row.coalesce(1).write.mode("append" if failed else "overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}/failure={int(failed)}")


def _publish(events: DataFrame, target: TopicSpec, run: int, batch_id: int, step: str) -> None:
    """Publish at best effort: whatever goes wrong is logged and never reaches the sink."""
    try:
        if target.format == "kafka":
            options = AUDIT_PRODUCER | target.writer_options()
            keyed(events, "eventId", audit_json()).write.format("kafka").options(**options).save()
        else:
            place = f"{target.path}/run={run}/batch_id={batch_id}/step={step}"
            keyed(events, "eventId", audit_json()).write.format(target.format).options(**target.writer_options()).mode("overwrite").save(place)
    except Exception as problem:
        _LOG.warning("audit event (%s) of batch %s of run %s was not published: %s", step, batch_id, run, problem)


def drain(records: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Read and acknowledge without processing: the throughput baseline."""
    return (
        records.writeStream.format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_FIVE_SECONDS))
        .start()
    )


#: Columns of a counter's label set.
_COUNTER = ["metric", "outcome", "consumer_group", "source_topic", "partition"]
_COUNTERS = ", ".join(f"{c} string" for c in _COUNTER) + ", value bigint, ts timestamp"


def run_counters(outcomes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, fold_every: int = 100) -> StreamingQuery:
    """Keep the outcome counters current under ``path``; ``read_counters`` reads them.

    A batch writes one row per label set that it changed, with the new value, beside the batches before it. Every
    ``fold_every`` batches the changes are folded into a table with one row per label set, so that a read opens that table and fewer
    than ``fold_every`` changes; what the fold before had taken in is removed, so readers that began before this one still find
    their files. A repeated batch replaces its own changes by equal ones. A new checkpoint is a new run and
    counts from 0 again; readers take the newest run that has written anything.
    """
    spark = outcomes.sparkSession
    place = f"{path}/run={run_of(spark, checkpoint, numbered(spark, path, 'run'))}"

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select(*_COUNTER, "value", F.current_timestamp().alias("ts"))
        changed.write.mode("overwrite").parquet(f"{place}/changes/batch_id={batch_id}")
        if batch_id % fold_every == fold_every - 1:
            _fold_counters(spark, place, batch_id)

    return (
        outcome_counts(outcomes)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_FIVE_SECONDS))
        .start()
    )


def _counters_of(spark: SparkSession, place: str, before: int | None = None) -> DataFrame:
    """Current counters of a run: the last value of each label set in the folded table and the changes behind it."""
    upto = newest_version(spark, f"{place}/folded", "upto")
    if before is not None and upto is not None and upto >= before:
        # The fold of this very batch, which is repeated.
        upto = max((n for n in numbered(spark, f"{place}/folded", "upto") if n < before), default=None)
    parts = [] if upto is None else [spark.read.schema(_COUNTERS).parquet(f"{place}/folded/upto={upto}").withColumn("batch_id", F.lit(-1).cast("bigint"))]
    later = [n for n in numbered(spark, f"{place}/changes", "batch_id") if (upto is None or n > upto) and (before is None or n <= before)]
    if later:
        reader = spark.read.schema(f"{_COUNTERS}, batch_id bigint").option("basePath", f"{place}/changes")
        parts.append(reader.parquet(*[f"{place}/changes/batch_id={n}" for n in later]))
    if not parts:
        return spark.createDataFrame([], _COUNTERS)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # Numbers only, so the grouping hashes and combines before its shuffle.
    return rows.groupBy(*_COUNTER).agg(F.max_by("value", "batch_id").alias("value"), F.max_by("ts", "batch_id").alias("ts"))


def _fold_counters(spark: SparkSession, place: str, batch_id: int) -> None:
    before = [n for n in numbered(spark, f"{place}/folded", "upto") if n < batch_id]
    _counters_of(spark, place, batch_id).write.mode("overwrite").parquet(f"{place}/folded/upto={batch_id}")
    if before:
        for n in numbered(spark, f"{place}/changes", "batch_id"):
            if n <= before[-1]:
                remove(spark, f"{place}/changes/batch_id={n}")
        for n in before[:-1]:
            remove(spark, f"{place}/folded/upto={n}")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """The counters in sample form: ``metric, labels, ts, value, kind``; ``ts`` is when a counter last changed."""
    runs = [n for n in numbered(spark, path, "run") if written(spark, f"{path}/run={n}/changes") or written(spark, f"{path}/run={n}/folded")]
    if not runs:
        raise ValueError(f"no counters at {path}")
    return counter_form(_counters_of(spark, f"{path}/run={runs[-1]}"), F.col("ts"))
