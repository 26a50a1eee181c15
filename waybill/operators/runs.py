"""Measured runs: phases, windows, idle subtraction and comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybill.operators.reconcile import interval_join
from waybill.session import BROADCAST_ROWS


def measured_window(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """Samples from ``start`` to ``end``, both included; the range reaches the scan."""
    return samples.where((F.col("ts") >= start) & (F.col("ts") <= end))


def phase_table(
    runs: DataFrame, idle: str = "120 seconds", warm_up: str = "180 seconds", measured: str = "1500 seconds"
) -> DataFrame:
    """Idle, warm-up and measured phase of each run (``run_label, start_ts``), one after the other.

    A phase ends a microsecond before the next begins, so no sample falls in two.
    """
    spans = [("idle", idle), ("warm_up", warm_up), ("measured", measured)]
    begin, parts = F.col("start_ts"), []
    for name, length in spans:
        stop = begin + F.expr(f"INTERVAL '{length.split()[0]}' {length.split()[1].rstrip('s').upper()}")
        parts.append(F.struct(
            F.lit(name).alias("phase"), begin.alias("start_ts"), (stop - F.expr("INTERVAL '0.000001' SECOND")).alias("end_ts")
        ))
        begin = stop
    return runs.select("run_label", F.explode(F.array(*parts)).alias("p")).select("run_label", "p.*")


def tag_phases(
    samples: DataFrame, phases: DataFrame, bucket_seconds: int = 600, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Samples with the run and phase whose span holds them; samples outside every phase are dropped."""
    spans = phases.select(
        "run_label", "phase", F.unix_micros("start_ts").alias("_lo"), F.unix_micros("end_ts").alias("_hi")
    )
    tagged = interval_join(
        samples, spans, [], F.unix_micros("ts"), F.col("_lo"), F.col("_hi"), bucket_seconds * 1_000_000, broadcast_rows
    )
    return tagged.drop("_lo", "_hi")


def run_means(tagged: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Mean and sample count of each metric in each run."""
    return tagged.groupBy("run_label", *by).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def subtract_idle(means: DataFrame, idle_run: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Each run's mean less the idle run's: the marginal cost of the run.

    One pass over the means, which have one row per run and metric; metrics the idle run lacks are dropped.
    """
    idle = F.max(F.when(F.col("run_label") == idle_run, F.col("mean"))).over(Window.partitionBy(*by))
    return (
        means.withColumn("idle_mean", idle)
        .where((F.col("run_label") != idle_run) & F.col("idle_mean").isNotNull())
        .withColumn("marginal", F.col("mean") - F.col("idle_mean"))
    )


def compare_runs(means: DataFrame, baseline: str, runs: Sequence[str], by: Sequence[str] = ("metric",)) -> DataFrame:
    """Means of the named runs side by side with their overhead over the baseline in percent."""
    table = means.groupBy(*by).pivot("run_label", [baseline, *runs]).agg(F.first("mean"))
    over = {
        f"{run}_overhead_percent": F.try_divide((F.col(f"`{run}`") - F.col(f"`{baseline}`")) * 100, F.col(f"`{baseline}`"))
        for run in runs
    }
    return table.withColumns(over)
