import random
from functools import reduce

import pytest
from pyspark.sql import DataFrame, functions as F

from tests.helpers import at, audit_rows, collected, simulate
from waybill.operators.lifecycle import lifecycle_batch, lifecycle_summary

CASES = {
    "clean": ([("R", 0), ("C", 5)], 1000, [("COMMITTED", 0, 5, 5, 1, 0, 0)]),
    "replay": ([("R", 0), ("R", 5), ("C", 9)], 1000,
               [("REPLAY_OBSERVED", 0, 0, 5, 1, 1, 0), ("COMMITTED", 0, 9, 9, 2, 1, 0)]),
    "late": ([("R", 0), ("C", 150)], 1000, [("ESTIMATED_FAILED", 0, 0, 100, 1, 0, 1), ("LATE_COMMIT", 0, 150, 150, 1, 0, 1)]),
    "re-armed": ([("R", 0), ("R", 120), ("C", 130)], 1000, [
        ("ESTIMATED_FAILED", 0, 0, 100, 1, 0, 1), ("REPLAY_OBSERVED", 0, 0, 120, 1, 1, 1), ("LATE_COMMIT", 0, 130, 130, 2, 1, 1)]),
    "twice timed out": ([("R", 0), ("R", 120)], 300, [
        ("ESTIMATED_FAILED", 0, 0, 100, 1, 0, 1), ("REPLAY_OBSERVED", 0, 0, 120, 1, 1, 1), ("ESTIMATED_FAILED", 0, 120, 220, 2, 1, 2)]),
    "unknown": ([("C", 5)], 1000, []),
    "reuse": ([("R", 0), ("C", 5), ("R", 10), ("C", 12)], 1000,
              [("COMMITTED", 0, 5, 5, 1, 0, 0), ("COMMITTED", 10, 12, 12, 3, 0, 0)]),
    "strict edge": ([("R", 10)], 100, []),
    # The tick at 100 ran before the commit at 500, whatever the horizon.
    "horizon": ([("R", 0), ("C", 500)], 50, [("ESTIMATED_FAILED", 0, 0, 100, 1, 0, 1), ("LATE_COMMIT", 0, 500, 500, 1, 0, 1)]),
    "tie": ([("R", 0), ("C", 100)], 1000, [("COMMITTED", 0, 100, 100, 1, 0, 0)]),
}
CLOCK = {"timeout": "60 seconds", "extra": "30 seconds", "tick": "10 seconds"}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    log, end, want = CASES[name]
    got = collected(lifecycle_batch(audit_rows(spark, name, log), **CLOCK, horizon=F.lit(at(end)).cast("timestamp")))
    assert got == sorted(want) == simulate(log, 90, 10, end)


def random_logs(seed, keys, length):
    rng = random.Random(seed)
    logs = {}
    for k in range(keys):
        n = length * 12 if k == 0 else rng.randrange(1, length)
        times = sorted(rng.sample(range(n * 40), n))
        logs[f"k{k}"] = [(rng.choices("RC", (3 if k % 3 else 30, 1))[0], t) for t in times]
    return logs


@pytest.mark.parametrize("hot_rows", [4, 30, 1_000_000])
def test_random_logs_against_simulation(spark, hot_rows):
    logs = random_logs(11, 25, 20)
    audit = reduce(DataFrame.unionByName, [audit_rows(spark, k, log) for k, log in logs.items()]).repartition(4)
    out = lifecycle_batch(audit, **CLOCK, hot_rows=hot_rows, horizon=F.lit(at(9000)).cast("timestamp")).cache()
    for key, log in logs.items():
        assert collected(out.where(F.col("eventId") == key)) == simulate(log, 90, 10, 9000), key
    out.unpersist()


def test_group_topic_and_ranges_of_outcomes(spark):
    audit = audit_rows(spark, "k", [("R", 0), ("R", 5), ("C", 9)])
    audit = audit.withColumn("consumerGroup", F.concat(F.lit("g"), F.unix_seconds("timestamp").cast("string")))
    rows = lifecycle_batch(audit, **CLOCK).collect()
    # The group is that of the first read; a replay shows the ranges before it, the commit the latest read's.
    assert {r["consumerGroup"] for r in rows} == {"g0"}
    assert {r["outcome"]: r["partitionRanges"][0]["offsetMin"] for r in rows} == {"REPLAY_OBSERVED": 0, "COMMITTED": 1}


def test_summary(spark):
    logs = [("a", [("R", 0), ("C", 5)]), ("b", [("R", 0), ("R", 5)]), ("c", [("C", 1)]), ("d", [("R", 0), ("C", 150)]), ("e", [("R", 195)])]
    audit = reduce(DataFrame.unionByName, [audit_rows(spark, k, log) for k, log in logs])
    row = lifecycle_summary(audit, **CLOCK, horizon=F.lit(at(200)).cast("timestamp")).first()
    assert row.asDict() == {
        "pending": 1, "replays": 1, "estimatedFailed": 2, "lateCommits": 1, "committed": 1, "unknownCommits": 1}


def test_other_stages_are_ignored(spark):
    audit = audit_rows(spark, "k", [("R", 0), ("C", 5)])
    noise = audit.withColumn("stage", F.lit(None).cast("string"))
    assert collected(lifecycle_batch(audit.unionByName(noise), **CLOCK)) == [("COMMITTED", 0, 5, 5, 1, 0, 0)]
