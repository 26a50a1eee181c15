import zlib
from collections import Counter, defaultdict

from tests.llm.helpers import SF, numbered, texts
from waybill.llm import ring
from waybill.llm.catalog import QUERIES


def check(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))


def test_counts_are_one_apart_and_slots_gapless(spark):
    docs = numbered(spark, texts(2, 60))
    rows = ring.assign(docs).collect()
    assert len(rows) == docs.count()
    check(rows, 24)
    source = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == source
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    assert ring.assign(docs.limit(0)).count() == 0
    check(ring.assign(docs.limit(3)).collect(), 24)


def test_query(spark):
    check(QUERIES["op4_ring_shards"](spark, SF).collect(), 24)


def test_a_text_with_a_third_of_all_rows_spreads_clockwise(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(600)], "doc_id long, text string").repartition(5)
    rows = ring.assign(docs, shards=5).collect()
    check(rows, 5)
    same = Counter(r["shard"] for r in rows if r["doc_id"] % 3 == 0)
    assert max(same.values()) <= 120 and len(same) >= 2
    others = defaultdict(set)
    for r in ring.assign(docs.filter("doc_id % 3 > 0").union(docs.filter("doc_id % 3 > 0")), shards=5, slack=0.5).collect():
        others[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in others.values()) < 40  # equal texts stay together but where a shard is full


def test_fill_follows_the_ring():
    points = [(0, 0), (10, 1), (20, 2)]
    # Arc 0 overflows to the next points; arc 3 closes the ring and belongs to shard 0.
    assert ring.fill(points, {0: 5, 3: 1}, [2, 2, 2]) == [(0, 0, 0, 0), (0, 2, 1, 0), (0, 4, 2, 0), (3, 0, 2, 1)]


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4000)], "doc_id long, text string")
    before, after = ({r["doc_id"]: r["shard"] for r in ring.assign(docs, shards=n, slack=0.25).collect()} for n in (10, 11))
    assert sum(before[i] != after[i] for i in before) < 1200  # a modulus would move nine tenths


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "x") for i in range(100)], "doc_id long, text string, shard string")
    ring.write_shards(docs, str(tmp_path / "out"), shards=4)
    assert Counter(r["shard"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == {0: 25, 1: 25, 2: 25, 3: 25}


def test_rows_of_one_text_without_id_are_cut_into_ranges(spark, monkeypatch):
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, "same" if i % 3 == 0 else f"t{i}") for i in range(6000)], "doc_id long, text string").repartition(6)
    written = []
    real = ring.cut_lineage
    monkeypatch.setattr(ring, "cut_lineage", lambda df: written.append(real(df)) or written[-1])
    # Small ranges would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = ring.assign(docs, shards=5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(rows, 5)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    sizes = [r["count"] for r in written[-1].groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * 6000 / len(sizes)
