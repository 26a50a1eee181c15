"""Time the headline queries on ``$BENCH_SF_DIR`` and print one JSON line.

``queries`` holds seconds per query (each result is fully computed and dropped), ``rates`` rows per
second through the lifecycle in both forms and through the sink and drain streams.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from waybill.plans import views as V  # noqa: E402
from waybill.plans.catalog import QUERIES, _event_stream  # noqa: E402
from waybill.session import scratch_path  # noqa: E402
from waybill.sinks.tables import SinkSpec  # noqa: E402
from waybill.streaming.sinks import drain, run_sink_stream  # noqa: E402

HEADLINE = [
    "lifecycle_outcomes", "lifecycle_batches", "lifecycle_summary", "lifecycle_streamed",
    "outcome_counters", "outcome_rates", "timeout_pressure", "replay_concentration",
    "batch_reads", "commit_events", "commit_offsets", "chunk_sizes", "sink_stats",
    "audit_json_parse", "outcome_json_parse", "latest_write", "sink_upsert", "sink_missing", "sink_duplicates", "partial_batches",
    "read_commit_pairs", "unmatched_reads", "rate_5m", "increase_15m", "increase_6h", "instant_grid", "vector_or",
    "broker_throughput", "cluster_throughput", "broker_cpu", "cluster_cpu", "container_memory", "export_queries",
    "phase_tagging", "idle_subtraction", "run_comparison", "measured_window",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    V.events(spark, sf_dir).count()

    times: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)

    total = V.events(spark, sf_dir).count()
    log = V.audit_log(spark, sf_dir).count()
    rates = {
        "lifecycle_batch_rows_per_sec": round(log / times["lifecycle_outcomes"]),
        "lifecycle_stream_rows_per_sec": round(log / times["lifecycle_streamed"]),
    }
    now = {"availableNow": True}
    for name, start in {
        "drain_rows_per_sec": lambda: drain(V.records_of(_event_stream(spark, sf_dir)), scratch_path(spark, "state"), now),
        "sink_append_rows_per_sec": lambda: run_sink_stream(
            V.records_of(_event_stream(spark, sf_dir)), SinkSpec(path=scratch_path(spark, "sink")), scratch_path(spark, "state"), now),
        "sink_upsert_rows_per_sec": lambda: run_sink_stream(
            V.records_of(_event_stream(spark, sf_dir)), SinkSpec(path=scratch_path(spark, "sink"), mode="upsert"),
            scratch_path(spark, "state"), now),
    }.items():
        began = time.perf_counter()
        start().awaitTermination()
        rates[name] = round(total / (time.perf_counter() - began))

    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
