"""Recording rules as a stream: store samples, and record each rule at every grid time that the samples have passed.

A grid time is closed once a sample at or after it has come; the closed ones end at the *frontier*, the last grid time up to the latest
sample that earlier batches stored. It follows from the store, so a batch that is repeated finds the frontier it had. A batch
evaluates the grid times between the frontier and its own latest sample, wherever batches are cut, and again those closed ones whose
windows its late samples touch, over the stored samples that these windows can see and no others.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from waybill.functions import columns as C
from waybill.operators.series import Grid
from waybill.plans.rules import Evaluation, recorded
from waybill.schemas import SAMPLE
from waybill.session import broadcast_if_small, micros, run_of, written
from waybill.streaming.sinks import EVERY_FIVE_SECONDS

_STORED = T.StructType([
    *SAMPLE.fields, T.StructField("day", T.DateType()), T.StructField("run", T.LongType()), T.StructField("batch_id", T.LongType())])
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_DAY = 86_400_000_000


def run_rules(
    samples: DataFrame, store: str, out: str, checkpoint: str, names: list[str] | None = None, interval: str = "5 seconds",
    trigger: dict | None = None, **options,
) -> StreamingQuery:
    """Add each micro-batch to ``store`` (one folder per day, run and batch) and what it records to ``out``; ``read_recorded`` reads that.

    ``options`` are those of ``Evaluation``. A repeated batch replaces its own folders; a new checkpoint is a new run, whose batches
    stand beside those of earlier runs. Samples without a time are left out.
    """
    step = micros(interval)
    back = max(micros(options.get("rate_window", "5 minutes")), micros(options.get("lookback", "5 minutes")))
    run = run_of(samples.sparkSession, checkpoint)
    known: dict[int, int | None] = {}

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.where(F.col("ts").isNotNull()).persist()
        try:
            first, last = batch.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
            latest = known[batch_id - 1] if batch_id - 1 in known else _latest(spark, store, run, batch_id)
            known.clear()
            known[batch_id] = latest if last is None else max(last, latest or last)
            if last is None:
                return
            dated = batch.withColumns({"day": F.to_date("ts"), "run": F.lit(run), "batch_id": F.lit(batch_id)})
            dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "run", "batch_id").parquet(store)
            frontier = -(-first // step) * step - step if latest is None else latest // step * step
            closed = known[batch_id] // step * step
            rows = _evaluated(spark, batch, store, frontier, closed, step, back, names, interval, options)
            rows.write.mode("overwrite").parquet(f"{out}/run={run}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return (
        samples.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or EVERY_FIVE_SECONDS))
        .start()
    )


def _latest(spark: SparkSession, store: str, run: int, batch_id: int) -> int | None:
    """Time of the latest sample that batches before this one stored; looked up when a stream starts."""
    if not written(spark, store):
        return None
    earlier = spark.read.schema(_STORED).parquet(store).where((F.col("run") < run) | ((F.col("run") == run) & (F.col("batch_id") < batch_id)))
    day = earlier.agg(F.max("day")).first()[0]
    return None if day is None else earlier.where(F.col("day") == F.lit(day)).agg(F.unix_micros(F.max("ts"))).first()[0]


def _evaluated(spark, batch, store, frontier, closed, step, back, names, interval, options) -> DataFrame:
    """The rules at the grid times in (frontier, closed], and at earlier ones that a sample of the batch may be seen from."""

    def cell(ts: Column) -> Column:
        return F.floor(F.unix_micros(ts) / F.lit(back)).cast("bigint")

    # A sample is seen from less than a window on: from its own cell of the window's length and the next.
    late = batch.where(F.col("ts") <= F.timestamp_micros(F.lit(frontier))).select(cell(F.col("ts")).alias("c"))
    late = late.select(F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("_cell")).distinct()
    low = late.agg(F.min("_cell")).first()[0]
    start = frontier + step if low is None else min(frontier + step, -(-low * back // step) * step)
    if closed < start:
        return recorded(Evaluation(batch.limit(0), Grid(_EPOCH, _EPOCH, interval), **options), names)
    grid = Grid(_EPOCH + timedelta(microseconds=start), _EPOCH + timedelta(microseconds=closed), interval)
    days = range((start - back) // _DAY, closed // _DAY + 1)
    # The folders of these days alone; the batch's own are among them.
    folders = ",".join(f"day={(_EPOCH + timedelta(days=d)).date()}" for d in days)
    seen = spark.read.schema(_STORED).option("basePath", store).parquet(f"{store}/{{{folders}}}").select(*SAMPLE.fieldNames())
    new = F.col("ts") > F.timestamp_micros(F.lit(frontier))
    if low is None:
        return recorded(Evaluation(seen.where(F.col("ts") > F.timestamp_micros(F.lit(frontier + step - back))), grid, **options), names)
    # As many cells as late samples lie in, of a window's length each.
    cells = late.withColumn("_late", F.lit(True))
    needed = late.union(late.select(F.col("_cell") - 1)).distinct().withColumn("_late", F.lit(True))
    in_view = F.col("ts") > F.timestamp_micros(F.lit(frontier + step - back))
    seen = seen.withColumn("_cell", cell(F.col("ts"))).join(broadcast_if_small(needed), "_cell", "left").where(in_view | F.col("_late"))
    rows = recorded(Evaluation(seen.select(*SAMPLE.fieldNames()), grid, **options), names)
    touched = rows.withColumn("_cell", cell(F.col("ts"))).join(broadcast_if_small(cells), "_cell", "left").where(new | F.col("_late"))
    return touched.select(*rows.columns)


def read_recorded(spark: SparkSession, out: str) -> DataFrame:
    """Recorded samples, one per series and grid time: of evaluations repeated for late samples, the last."""
    schema = T.StructType([*SAMPLE.fields, T.StructField("run", T.LongType()), T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(schema).parquet(out).withColumn("_key", C.labels_key(F.col("labels")))
    newest = rows.groupBy("metric", "_key", "ts").agg(F.max(F.struct("run", "batch_id", "value", "kind")).alias("_last"))
    return newest.select("metric", C.labels_from_key(F.col("_key")).alias("labels"), "ts", "_last.value", "_last.kind")
