import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import ordered
from waybill.operators.ordered import SEG, Ordered, chunk, current_batch, running_number


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, many of them with equal order values."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", rng.randrange(30), i) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t bigint, seq bigint").repartition(5)


def test_hot_key_is_cut_and_others_are_not(spark, skewed):
    o = Ordered(skewed, ["k"], ["t", "seq"], hot_rows=200)
    assert o.split
    sizes = {(r["k"], r[SEG]): r["count"] for r in o.rows.groupBy("k", SEG).count().collect()}
    hot = [n for (k, s), n in sizes.items() if k == "hot"]
    assert len(hot) > 5 and max(hot) < 600 and sum(sizes.values()) == 3000
    assert all(s == -1 for (k, s) in sizes if k != "hot")
    # Segments follow the order: no row of a later segment comes before one of an earlier one.
    edges = o.rows.where("k = 'hot'").groupBy(SEG).agg(F.min(F.struct("t", "seq")).alias("a"), F.max(F.struct("t", "seq")).alias("b"))
    rows = sorted(edges.collect(), key=lambda r: r[SEG])
    assert all(x["b"] < y["a"] for x, y in zip(rows, rows[1:]))


def test_thousands_of_segments(spark):
    """Numbers rise with the order and no segment is left out, however many there are."""
    rows = spark.range(9000).select(F.lit("k").alias("k"), (F.col("id") * 7919 % 9000).alias("t"))
    o = Ordered(rows, ["k"], ["t"], hot_rows=3)
    found = {r["t"]: r[SEG] for r in o.rows.collect()}
    assert len(set(found.values())) > 1000
    assert all(found[t] <= found[t + 1] for t in range(8999))
    assert [r["n"] for r in running_number(rows, ["k"], ["t"], "n", hot_rows=3).orderBy("t").collect()] == list(range(1, 9001))


def test_segments_are_bounded_and_placed_without_a_task_for_each(spark, monkeypatch):
    """However low the threshold, segments get larger and not more, and no shuffle has a partition for each."""
    monkeypatch.setattr(ordered, "MAX_SEGMENTS", 40)
    rows = spark.range(6000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 6000).alias("t"))
    o = Ordered(rows, ["k"], ["t"], hot_rows=2)
    sizes = [r["count"] for r in o.rows.groupBy("k", SEG).count().collect()]
    assert sum(sizes) == 6000 and 30 <= len(sizes) <= 46 and max(sizes) < 400
    assert "_blocks" not in o.rows._jdf.queryExecution().optimizedPlan().toString()
    want = {t: i for k in range(3) for i, t in enumerate(sorted(n * 7919 % 6000 for n in range(k, 6000, 3)), 1)}
    assert {r["t"]: r["n"] for r in running_number(rows, ["k"], ["t"], "n", hot_rows=2).collect()} == want


def test_no_hot_key_is_a_plain_window(skewed):
    assert not Ordered(skewed, ["k"], ["t", "seq"]).split


@pytest.mark.parametrize("hot_rows", [50, 400, 1_000_000])
def test_running_number(skewed, hot_rows):
    got = running_number(skewed, ["k"], ["t", "seq"], "n", hot_rows=hot_rows).collect()
    want = {}
    for k, t, seq in sorted((r["k"], r["t"], r["seq"]) for r in got):
        want.setdefault(k, []).append(seq)
    assert len(got) == 3000
    assert all(want[r["k"]][r["n"] - 1] == r["seq"] for r in got)


def test_null_key_can_be_hot(spark):
    df = spark.range(500).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("t"))
    got = running_number(df, ["k"], ["t"], "n", hot_rows=50)
    assert {(r["t"], r["n"]) for r in got.collect()} == {(i, i + 1) for i in range(500)}


def test_chunk_sizes(spark):
    def sizes(n, size):
        df = spark.range(n).select(F.lit("p").alias("p"), "id")
        rows = chunk(df, ["id"], size, ["p"]).groupBy("chunk").count().orderBy("chunk").collect()
        return [r["count"] for r in rows]

    assert sizes(7, 3) == [3, 3, 1]
    assert sizes(2, 0) == [1, 1]
    assert sizes(2, -5) == [1, 1]


@pytest.mark.parametrize("hot_rows", [5, 40, 1_000_000])
def test_current_batch(spark, hot_rows):
    rng = random.Random(hot_rows)
    log = [("c", i, rng.choice("RRC")) for i in range(400)]
    df = spark.createDataFrame(log, "c string, t bigint, kind string").withColumn(
        "eventId", F.when(F.col("kind") == "R", F.concat(F.lit("e"), "t")))
    got = current_batch(df, ["c"], ["t"], "eventId", F.col("kind") == "R", F.col("kind") == "C", hot_rows=hot_rows)
    want, held = {}, None
    for _, t, kind in log:
        if kind == "R":
            held = f"e{t}"
        else:
            want[t], held = held, None
    assert {r["t"]: r["currentBatch"] for r in got.collect()} == want
