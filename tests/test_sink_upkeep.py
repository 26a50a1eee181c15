from dataclasses import replace

from pyspark.sql import functions as F

from tests.helpers import at
from tests.test_sinks_and_streams import NOW, payloads, sink_rows
from waybill.operators.outcomes import outcome_counts
from waybill.schemas import OUTCOME
from waybill.session import newest_version, numbered, remove, run_of, scratch_path, subfolders, written
from waybill.sinks import tables as T
from waybill.streaming import sinks as stream_sinks


def one_file(spark, offsets, value="v"):
    return sink_rows(spark, offsets, value).coalesce(1)


def test_lookup_opens_only_files_that_can_hold_the_keys(spark, tmp_path):
    target = T.SinkSpec(path=str(tmp_path / "s"), mode="upsert")
    for batch in range(6):
        T.write_sink(one_file(spark, range(batch * 500, batch * 500 + 500)), target, batch)
    wanted = sink_rows(spark, [3, 4, 1700, 99_999])
    everything = T.files_with(spark, target, wanted)
    assert len(everything[0]) == everything[1] >= 6
    T.index_sink(spark, target)
    chosen, of = T.files_with(spark, target, wanted)
    assert of == everything[1] and {f.split("/")[2] for f in chosen} == {"batch_id=0", "batch_id=3"}
    found = T.lookup_upserted(spark, target, wanted)
    assert payloads(found) == {3: "v3", 4: "v4", 1700: "v1700"} and found.columns == T.read_upserted(spark, target).columns
    # The scan itself names these files and no others.
    assert {f.split("/")[-2] for f in found.inputFiles()} == {"batch_id=0", "batch_id=3"}
    # What is not indexed is opened; a repeated batch has new files and leaves its old entries without effect.
    T.write_sink(one_file(spark, [4, 7], "w"), target, 6)
    T.write_sink(one_file(spark, range(0, 500), "r"), target, 0)
    assert payloads(T.lookup_upserted(spark, target, wanted)) == {3: "r3", 4: "w4", 1700: "v1700"}
    T.index_sink(spark, target)
    assert {f.split("/")[2] for f in T.files_with(spark, target, wanted)[0]} == {"batch_id=0", "batch_id=3", "batch_id=6"}
    before = T.files_with(spark, target, wanted)
    T.index_sink(spark, target)  # nothing is left to do
    assert T.files_with(spark, target, wanted) == before
    assert T.lookup_upserted(spark, target, wanted.limit(0)).count() == 0
    assert T.lookup_upserted(spark, T.SinkSpec(path=str(tmp_path / "none")), wanted).count() == 0


def test_lookup_equals_the_whole_table_through_upkeep(spark, tmp_path):
    target = T.SinkSpec(path=str(tmp_path / "s"), mode="upsert")
    wanted = sink_rows(spark, range(0, 9000, 7))
    for batch in range(7):
        T.write_sink(sink_rows(spark, range(batch * 900, batch * 900 + 3000), f"b{batch}-"), target, batch)
        if batch in (2, 4, 6):
            T.compact_sink(spark, target)
            T.index_sink(spark, target)
            T.vacuum_sink(spark, target)
        table = payloads(T.read_upserted(spark, target))
        assert payloads(T.lookup_upserted(spark, target, wanted)) == {k: v for k, v in table.items() if k % 7 == 0}
    assert len(table) == 8400


def test_null_keys_are_looked_up(spark, tmp_path):
    target = T.SinkSpec(path=str(tmp_path / "s"), mode="upsert")
    rows = one_file(spark, range(5)).withColumn("kafka_partition", F.lit(None).cast("int"))
    T.write_sink(rows, target, 0)
    T.write_sink(one_file(spark, range(100, 105)), target, 1)
    T.index_sink(spark, target)
    assert len(T.files_with(spark, target, rows.where("kafka_offset = 3"))[0]) == 1
    assert payloads(T.lookup_upserted(spark, target, rows.where("kafka_offset = 3"))) == {3: "v3"}


def test_filters_seldom_take_a_file_for_another(spark):
    """One file of many bitmaps: all its keys are found, and about one of 400 other keys."""
    path = scratch_path(spark, "keys")
    target = T.SinkSpec(path=path, mode="upsert")
    keys = spark.range(120_000).select(
        F.lit("e").alias("event_id"), F.lit("t").alias("kafka_topic"), F.lit(0).alias("kafka_partition"), (F.col("id") * 2).alias("kafka_offset"),
        F.lit("p").alias("payload"), F.lit(at(0)).cast("timestamp").alias("created_at"))
    T._write_batch(keys.coalesce(1), target, 0)
    T.index_sink(spark, target)
    index = T._index(spark, target, -1)
    assert index.select("bitmaps").distinct().collect()[0][0] == 64 and index.count() == 64
    asked = keys.select("kafka_topic", "kafka_partition", F.explode(F.array("kafka_offset", F.col("kafka_offset") + 1)).alias("kafka_offset"))
    asked = asked.select(F.xxhash64(*T.SINK_KEY).alias("h"), (F.col("kafka_offset") % 2).alias("odd"))
    joined = asked.withColumn("bitmap", F.pmod("h", F.lit(64))).withColumn("probes", T._probes(F.col("h"))).join(index, "bitmap")
    hit = F.forall("probes", lambda p: T._has_bit(F.col("bits"), p)).cast("int")
    hits = {r["odd"]: r["n"] for r in joined.groupBy("odd").agg(F.sum(hit).alias("n")).collect()}
    assert hits[0] == 120_000 and hits[1] < 120_000 / 200


def test_vacuum_keeps_what_the_last_manifest_but_one_needs(spark, tmp_path):
    target = T.SinkSpec(path=str(tmp_path / "s"), mode="upsert")
    for batch in range(3):
        T.write_sink(one_file(spark, range(batch, batch + 4), f"b{batch}-"), target, batch)
    assert T.vacuum_sink(spark, target) == 0
    T.compact_sink(spark, target)
    T.index_sink(spark, target)
    assert T.vacuum_sink(spark, target) == 0
    reader = T.read_upserted(spark, target)  # planned on the first manifest
    T.write_sink(one_file(spark, [9], "x"), target, 3)
    T.write_sink(one_file(spark, [0], "y"), replace(target, run=5), 0)
    T.compact_sink(spark, target)
    assert T.vacuum_sink(spark, target) == 2  # batches 0 and 1; the first manifest still reads batch 2
    want = {0: "y0", 1: "b1-1", 2: "b2-2", 3: "b2-3", 4: "b2-4", 5: "b2-5", 9: "x9"}
    assert payloads(reader) == {k: v for k, v in want.items() if k not in (0, 9)} | {0: "b0-0"}
    assert payloads(T.read_upserted(spark, target)) == want
    assert numbered(spark, f"{target.path}/generations/run=0", "batch_id") == [2, 3]
    T.write_sink(one_file(spark, [0, 1], "late"), target, 1)  # folded and removed, repeated: changes nothing
    T.compact_sink(spark, target)
    T.compact_sink(spark, target)
    assert T.vacuum_sink(spark, target) > 0
    assert numbered(spark, f"{target.path}/manifest") == numbered(spark, f"{target.path}/base") and len(numbered(spark, f"{target.path}/base")) == 2
    assert payloads(T.read_upserted(spark, target)) == want


def test_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not written(spark, path) and subfolders(spark, path) == [] and newest_version(spark, path) is None
    for v in (2, 10):
        spark.range(1).write.parquet(f"{path}/version={v}")
    (tmp_path / "t" / "version=11" / "_temporary").mkdir(parents=True)
    (tmp_path / "t" / "version=x").mkdir()
    assert numbered(spark, path) == [2, 10, 11] and newest_version(spark, path) == 10
    remove(spark, f"{path}/version=10")
    remove(spark, f"{path}/version=10")
    assert newest_version(spark, path) == 2


def test_a_run_is_later_than_the_runs_before_it(spark, tmp_path):
    ahead = 9_000_000_000_000
    first = run_of(spark, str(tmp_path / "a"), [3, ahead])
    assert first == ahead + 1 == run_of(spark, str(tmp_path / "a"), [ahead + 7])
    assert run_of(spark, str(tmp_path / "b")) < ahead


def outcome(i):
    return (f"e{i}", ["COMMITTED", "LATE_COMMIT"][i % 2], f"g{i // 10}", "t", at(0), at(1), at(i), 5, i % 3, i % 2, [(i % 2, 0, 1, 2)])


def flat(df):
    return {tuple(r[c] for c in stream_sinks._COUNTER) + (r["value"],) for r in df.collect()}


def test_counters_cost_what_changes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []

    def step(rows, checkpoint="ck"):
        seen.extend(rows)
        spark.createDataFrame(rows, OUTCOME).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OUTCOME).parquet(source)
        stream_sinks.run_counters(stream, out, str(tmp_path / checkpoint), NOW, fold_every=2).awaitTermination()
        run = numbered(spark, out, "run")[-1]
        assert flat(stream_sinks._counters_of(spark, f"{out}/run={run}")) == flat(outcome_counts(spark.createDataFrame(seen, OUTCOME)))
        return f"{out}/run={run}"

    step([outcome(i) for i in range(100)])
    place = step([outcome(i) for i in range(100, 110)])
    # One group of ten changed: its label sets alone are written.
    changed = spark.read.parquet(f"{place}/changes/batch_id=1").count()
    assert changed == outcome_counts(spark.createDataFrame([outcome(i) for i in range(100, 110)], OUTCOME)).count()
    assert changed * 5 < stream_sinks.read_counters(spark, out).count()
    for i in range(110, 150, 10):
        step([outcome(j) for j in range(i, i + 10)])
    assert numbered(spark, f"{place}/folded", "upto") == [3, 5] and numbered(spark, f"{place}/changes", "batch_id") == [4, 5]
    # Folding a batch again, as after a crash behind the fold, gives the same table.
    before = flat(spark.read.schema(stream_sinks._COUNTERS).parquet(f"{place}/folded/upto=5"))
    stream_sinks._fold_counters(spark, place, 5)
    assert flat(spark.read.schema(stream_sinks._COUNTERS).parquet(f"{place}/folded/upto=5")) == before
    # A new checkpoint reads everything again, as a run of its own.
    assert step([outcome(200)], "other") != place
