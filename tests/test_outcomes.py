from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tests.helpers import at, audit_rows
from waybill.operators import batches as B
from waybill.operators import outcomes as O
from waybill.operators import reconcile as R
from waybill.operators.lifecycle import lifecycle_batch
from waybill.schemas import OUTCOME, RECORD


def outcome(spark, *rows):
    full = [
        (f"e{i}", name, group, topic, at(0), at(5), at(when), 10, replays, timeouts, [(p, 0, 4, 5) for p in parts])
        for i, (name, group, topic, when, replays, timeouts, parts) in enumerate(rows)
    ]
    return spark.createDataFrame(full, OUTCOME)


def counts(df):
    return {
        (r["metric"], r["outcome"], r["consumer_group"], r["source_topic"], r["partition"]): r["value"]
        for r in O.outcome_counts(df).collect()
    }


def test_counters_of_one_event(spark):
    got = counts(outcome(spark, ("COMMITTED", "group-a", "topic-a", 5, 3, 2, (0, 1))))
    assert got == {
        ("audit_outcomes_total", "COMMITTED", "group-a", "topic-a", None): 1,
        ("audit_batches_seen_total", None, "group-a", "topic-a", None): 1,
        ("audit_replay_count_total", None, "group-a", "topic-a", None): 3,
        ("audit_timeout_count_total", None, "group-a", "topic-a", None): 2,
        ("audit_partition_outcomes_total", "COMMITTED", "group-a", "topic-a", "0"): 1,
        ("audit_partition_outcomes_total", "COMMITTED", "group-a", "topic-a", "1"): 1,
    }


def test_counters_add_up_and_name_blank_labels(spark):
    got = counts(outcome(
        spark, ("REPLAY_OBSERVED", " ", None, 1, 1, 0, ()), ("REPLAY_OBSERVED", "", None, 2, 2, 0, ()), ("COMMITTED", None, None, 3, 2, 0, ())))
    assert got[("audit_replay_count_total", None, "unknown", "unknown", None)] == 5
    assert got[("audit_replay_events_total", None, "unknown", "unknown", None)] == 2
    assert got[("audit_batches_seen_total", None, "unknown", "unknown", None)] == 3
    assert not any(k[0] == "audit_timeout_count_total" for k in got)


def test_counter_rows_are_samples(spark):
    rows = O.outcome_counters(outcome(spark, ("COMMITTED", "g", "t", 5, 0, 0, (3,)))).collect()
    labels = {r["metric"]: r["labels"] for r in rows}
    assert labels["audit_batches_seen_total"] == {"consumer_group": "g", "source_topic": "t"}
    assert labels["audit_partition_outcomes_total"] == {"outcome": "COMMITTED", "consumer_group": "g", "source_topic": "t", "partition": "3"}
    assert {r["kind"] for r in rows} == {"counter"}


def test_rates_and_concentration(spark):
    audit = reduce(DataFrame.unionByName, [
        audit_rows(spark, "a", [("R", 0), ("R", 5), ("C", 9)]), audit_rows(spark, "b", [("R", 0), ("C", 150)]), audit_rows(spark, "c", [("R", 0)])])
    out = lifecycle_batch(audit)
    row = O.outcome_rates(out, audit).first()
    assert row["batches_read"] == 4 and row["estimated_failure_rate"] == 0.5
    assert row["replay_rate"] == 0.25 and row["late_commit_ratio"] == 0.5
    none = O.outcome_rates(out.where("outcome = 'COMMITTED'"), audit).first()
    assert none["late_commit_ratio"] is None
    replays = outcome(spark, ("REPLAY_OBSERVED", "g", "t", 1, 1, 0, (0, 1)), ("REPLAY_OBSERVED", "g", "t", 2, 2, 0, (0,)), ("COMMITTED", "g", "t", 2, 2, 0, (7,)))
    share = {r["partition"]: r["share"] for r in O.replay_concentration(replays).collect()}
    assert share == {0: 2 / 3, 1: 1 / 3}
    assert {(r["partition"], r["replays"]) for r in O.replay_severity(replays, ["partition"]).collect()} == {(0, 3), (1, 1), (7, 2)}


def test_commit_offsets_and_batch_events(spark):
    rows = [("k", "v", "topic-a", p, o, at(o)) for p, o in [(0, 98), (0, 100), (0, 99), (1, 204)]]
    recs = spark.createDataFrame(rows, RECORD)
    assert {(r["partition"], r["nextOffset"]) for r in B.commit_offsets(recs).collect()} == {(0, 101), (1, 205)}
    reads = B.batch_reads(recs.withColumn("b", F.lit(1)), ["b"], "g")
    read = reads.first()
    assert read["recordCount"] == 4
    assert [tuple(r) for r in read["partitionRanges"]] == [(0, 98, 100, 3), (1, 204, 204, 1)]
    commit = B.commit_events(reads).first()
    assert commit["eventId"] == read["eventId"] and commit["recordCount"] == 0 and commit["partitionRanges"] == []
    assert B.batch_reads(recs.where("false").withColumn("b", F.lit(1)), ["b"], "g").count() == 0


def test_read_commit_correlation(spark):
    audit = reduce(DataFrame.unionByName, [
        audit_rows(spark, "both", [("R", 0), ("C", 5)]), audit_rows(spark, "read", [("R", 0), ("R", 1)]), audit_rows(spark, "commit", [("C", 5)])])
    assert [r["eventId"] for r in R.read_commit_pairs(audit).collect()] == ["both"]
    assert [(r["eventId"], r["reads"]) for r in R.unmatched_reads(audit).collect()] == [("read", 2)]
    assert [r["eventId"] for r in R.unknown_commits(audit).collect()] == ["commit"]


def test_sink_stats_rates(spark):
    log = spark.createDataFrame(
        [(at(12), 80, 65, 3, 1), (at(19), 20, 15, 0, 0)], "at timestamp, consumed bigint, written bigint, failed int, partial int")
    row = R.sink_stats(log, *[F.lit(at(t)).cast("timestamp") for t in (10, 18, 20)]).first()
    assert (row["total_consumed"], row["total_written"], row["write_errors"], row["partial_writes"]) == (100, 80, 3, 1)
    assert (row["interval_consumed"], row["interval_written"]) == (20, 15)
    assert (row["interval_consumed_rate"], row["interval_write_rate"]) == (10.0, 7.5)
    assert (row["lifetime_consumed_rate"], row["lifetime_write_rate"]) == (10.0, 8.0)
    empty = R.sink_stats(log.where("false"), *[F.lit(at(20)).cast("timestamp")] * 3).first()
    assert empty["total_consumed"] == 0 and empty["lifetime_write_rate"] == 0.0


def test_sink_reconciliation(spark):
    n = 1000
    recs = spark.range(n).select(
        F.lit("k").alias("key"), F.lit("v").alias("value"), F.lit("t").alias("topic"), (F.col("id") % 4).cast("int").alias("partition"),
        F.floor(F.col("id") / 4).alias("offset"), F.timestamp_seconds("id").alias("timestamp"))
    batches = B.batch_reads(recs.withColumn("b", F.floor(F.unix_seconds("timestamp") / 100)), ["b"], "g")
    sink = recs.select(F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"),
                       F.unix_seconds("timestamp").alias("id"))
    # Batch 3 is written in half, every hundredth record of the others is lost, every fiftieth is there twice.
    kept = sink.where("NOT (id BETWEEN 350 AND 399) AND (id % 100 <> 7 OR id BETWEEN 300 AND 399)")
    stored = kept.unionByName(kept.where("id % 50 = 1"))
    missing = R.sink_missing(recs, stored)
    assert missing.count() == 50 + 9
    assert R.sink_completeness(recs, stored).agg(F.sum("missing")).first()[0] == 59
    assert R.sink_duplicates(stored).count() == stored.count() - kept.count() == 19
    partial = {r["b"]: (r["written"], r["expected"]) for r in R.partial_batches(batches, stored, ["b"], bucket=16).collect()}
    assert partial[3] == (50, 100) and partial[0] == (99, 100) and len(partial) == 10
    assert R.partial_batches(batches, sink, ["b"]).count() == 0
    assert R.partial_batches(batches, sink.where("false"), ["b"]).count() == 10


def test_interval_join_matches_brute_force(spark):
    points = spark.range(200).select(F.col("id").alias("p"), (F.col("id") % 3).alias("k"))
    spans = spark.createDataFrame([(0, 5, 40), (0, 39, 41), (1, 100, 100), (2, 0, 199), (2, 250, 300)], "k bigint, lo bigint, hi bigint")
    want = {(p, lo) for p in range(200) for k, lo, hi in [tuple(r) for r in spans.collect()] if p % 3 == k and lo <= p <= hi}
    for rows in (0, 100_000):
        out = R.interval_join(points, spans, ["k"], F.col("p"), F.col("lo"), F.col("hi"), 7, rows)
        got = [(r["p"], r["lo"]) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_observed_totals(spark):
    from pyspark.sql import Observation

    seen = Observation("outcomes")
    rows = outcome(spark, ("COMMITTED", "g", "t", 1, 0, 0, ()), ("LATE_COMMIT", "g", "t", 1, 0, 1, ()), ("COMMITTED", "g", "t", 1, 0, 0, ()))
    assert O.observed(rows, seen).count() == 3
    assert seen.get == {"replays": 0, "estimatedFailed": 0, "lateCommits": 1, "committed": 2}
