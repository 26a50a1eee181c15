import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import EPOCH, at, seconds
from waybill.operators import series as S
from waybill.schemas import SAMPLE


def samples(spark, points, metric="m", labels=None, kind="counter"):
    return spark.createDataFrame([(metric, labels or {"i": "a"}, at(t), float(v), kind) for t, v in points], SAMPLE)


def grid(start, end, step):
    return S.Grid(EPOCH + timedelta(seconds=start), EPOCH + timedelta(seconds=end), f"{step} seconds")


def values(df):
    return {round(seconds(r["ts"]), 3): r["value"] for r in df.collect()}


def brute_increase(points, window, start, end, step):
    out, t = {}, start
    points = sorted(points)
    while t <= end:
        inside = [v for (x, v) in points if t - window < x <= t]
        if inside:
            out[t] = sum(b if b < a else b - a for a, b in zip(inside, inside[1:]))
        t += step
    return out


def test_increase_by_hand(spark):
    # Monotone, one restart, a gap longer than the window.
    points = [(10, 5), (20, 8), (30, 2), (40, 6), (100, 7)]
    got = values(S.increase(samples(spark, points), "30 seconds", grid(10, 110, 10)))
    assert got == {10: 0, 20: 3, 30: 5, 40: 6, 50: 4, 60: 0, 100: 0, 110: 0}
    assert values(S.rate(samples(spark, points), "30 seconds", grid(40, 40, 10))) == {40: 6 / 30}


def test_window_is_open_on_the_left(spark):
    got = values(S.increase(samples(spark, [(0, 1), (30, 4)]), "30 seconds", grid(30, 30, 10)))
    assert got == {30: 0}


@pytest.mark.parametrize("window,step", [(30, 10), (10, 30), (35, 10), (7, 7), (60, 45), (1, 100)])
@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_increase_against_brute_force(spark, window, step, hot_rows):
    rng = random.Random(window * step)
    points, v = [], 0
    for t in sorted(rng.sample(range(0, 600), 220)):
        v = rng.randrange(5) if rng.random() < 0.1 else v + rng.randrange(20)
        points.append((t + rng.choice([0, 0.25, 0.999999]), v))
    df = samples(spark, points).unionByName(samples(spark, [(t, 2 * v) for t, v in points[::3]], labels={"i": "b"}))
    out = S.increase(df, f"{window} seconds", grid(100, 520, step), hot_rows=hot_rows)
    assert values(out.where("labels['i'] = 'a'")) == brute_increase(points, window, 100, 520, step)
    assert values(out.where("labels['i'] = 'b'")) == brute_increase([(t, 2 * v) for t, v in points[::3]], window, 100, 520, step)


@pytest.mark.parametrize("range_slices", [1, 4, 30])
def test_long_series_in_ranges(spark, range_slices):
    rng = random.Random(range_slices)
    points, v = [], 0
    for t in sorted(rng.sample([*range(0, 200), *range(380, 600)], 150)):
        v = rng.randrange(5) if rng.random() < 0.2 else v + rng.randrange(20)
        points.append((t + rng.choice([0, 0.5]), v))
    df = samples(spark, points).withColumn("metric", F.lit(None).cast("string")).unionByName(samples(spark, points[::7], labels={"i": "b"}))
    g = grid(50, 560, 10)
    out = S.increase(df, "35 seconds", g, range_slices, hot_rows=5)
    assert values(out.where("labels['i'] = 'a'")) == brute_increase(points, 35, 50, 560, 10)
    assert values(out.where("labels['i'] = 'b'")) == brute_increase(points[::7], 35, 50, 560, 10)
    held, whole = S.instant(df, g, "45 seconds", range_slices), S.instant(df, g, "45 seconds")
    assert sorted(map(str, held.collect())) == sorted(map(str, whole.collect())) and held.count() > 50
    # The windows over pieces are partitioned by range; only those over ranges are partitioned by series.
    text = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in text.splitlines() if "Window [" in line and "_slice#" in line]
    assert windows and all("_range#" in line for line in windows)


def test_large_counters_stay_exact(spark):
    # Small steps of a very large counter survive, because values are subtracted and not summed up.
    points = [(t, 8e15 + t) for t in range(0, 65, 5)]
    assert values(S.increase(samples(spark, points), "20 seconds", grid(60, 60, 10))) == {60: 15.0}


def test_instant_takes_latest_within_lookback(spark):
    df = samples(spark, [(5, 1), (12, 2), (14, 3), (40, 4)], kind="gauge")
    assert values(S.instant(df, grid(10, 50, 10), "15 seconds")) == {10: 1, 20: 3, 40: 4, 50: 4}


def test_nulls_and_empty_inputs(spark):
    df = samples(spark, [(5, 1)]).withColumn("value", F.lit(None).cast("double"))
    assert S.instant(df, grid(0, 50, 10), "15 seconds").count() == 0
    assert S.increase(df, "15 seconds", grid(0, 50, 10)).count() == 0
    assert S.increase(samples(spark, [(5, 1)]), "15 seconds", grid(10, 0, 10)).count() == 0


def vector(spark, rows):
    return spark.createDataFrame([(labels, at(t), float(v)) for labels, t, v in rows], "labels map<string,string>, ts timestamp, value double")


def flat(df):
    return sorted((tuple(sorted(r["labels"].items())), seconds(r["ts"]), r["value"]) for r in df.collect())


def test_or_prefers_left(spark):
    a = vector(spark, [({"x": "1"}, 0, 10), ({"x": "2"}, 0, 20)])
    b = vector(spark, [({"x": "1"}, 0, 99), ({"x": "3"}, 0, 30), ({"x": "1"}, 5, 11)])
    assert flat(S.vector_or(a, b)) == [((("x", "1"),), 0, 10), ((("x", "1"),), 5, 11), ((("x", "2"),), 0, 20), ((("x", "3"),), 0, 30)]


def test_arithmetic_matching(spark):
    a = vector(spark, [({"x": "1", "y": "1"}, 0, 10), ({"x": "2", "y": "1"}, 0, 20), ({"x": "2", "y": "1"}, 5, 1)])
    b = vector(spark, [({"y": "1", "x": "1"}, 0, 4), ({"x": "9"}, 0, 5)])
    assert flat(S.vector_op(a, b, "+")) == [((("x", "1"), ("y", "1")), 0, 14)]
    one = vector(spark, [({}, 0, 2), ({}, 5, 0)])
    assert [r[2] for r in flat(S.vector_op(a, one, "/", on=[], points=2))] == [5.0, 10.0, math.inf]
    assert [r[2] for r in flat(S.vector_op(a, b, "*", on=["x"]))] == [40.0]


def test_aggregates(spark):
    a = vector(spark, [({"x": "1", "c": "0"}, 0, 10), ({"x": "1", "c": "1"}, 0, 20), ({"c": "1"}, 0, 5)])
    assert flat(S.agg_by(a, "sum", ["x"])) == [((), 0, 5), ((("x", "1"),), 0, 30)]
    assert flat(S.agg_by(a, "avg")) == [((), 0, 35 / 3)]
    assert flat(S.count_groups(a, "c")) == [((), 0, 2)]


def test_fallback_order(spark):
    rows = [
        ({"id": "/d/1"}, 0, 1), ({"id": "/x", "svc": "kafka-2"}, 0, 2), ({"id": "/x", "name": "kafka-2"}, 0, 4),
        ({"id": "/d/1", "svc": "kafka-1", "name": "kafka-1"}, 0, 8), ({"name": "other"}, 0, 16),
    ]
    chosen = [S.Selector("id", "/d/1", "kafka-1"), S.Selector("svc", "kafka-[0-9]+", "$1", "(kafka-[0-9]+)"),
              S.Selector("name", "kafka-[0-9]+", "$1", "(kafka-[0-9]+)")]
    out = S.agg_by(S.relabelled_or(vector(spark, rows), chosen, "broker"), "sum", ["broker"])
    # The container that three selectors find counts once, because the rewritten label sets are equal.
    assert flat(out) == [((("broker", "kafka-1"),), 0, 9), ((("broker", "kafka-2"),), 0, 6)]


def test_metric_names_and_last_value(spark):
    df = samples(spark, [(1, 1)], "b").unionByName(samples(spark, [(1, 1), (2, 5)], "a")).unionByName(samples(spark, [(1, 1)], ""))
    assert [r[0] for r in S.metric_names(df).collect()] == ["a", "b"]
    df = df.withColumn("value", F.when(F.col("value") < 5, F.col("value")))
    assert {r["metric"]: r["value"] for r in S.last_not_null(df).collect()} == {"": 1, "a": 1, "b": 1}
    assert S.keep_metrics(df, "a|").select("metric").distinct().count() == 2
