import time
from dataclasses import replace
from functools import reduce

import pytest
from pyspark.sql import DataFrame, Row, functions as F

from tests.helpers import at, audit_rows, seconds
from tests.test_lifecycle import random_logs
from waybill.operators.lifecycle import lifecycle_batch, open_episodes
from waybill.operators.outcomes import outcome_counters
from waybill.operators.reconcile import sink_stats
from waybill.schemas import OUTCOME, RECORD, SAMPLE
from waybill.sinks import tables as T
from waybill.sinks.topics import AUDIT_PRODUCER, TopicSpec, publish, publish_stream
from waybill.functions import columns as C
from waybill.sources import records as src
from waybill.streaming import sinks as stream_sinks
from waybill.streaming.lifecycle import LifecycleProcessor, lifecycle_stream, pending_batches
from waybill.operators.series import Grid
from waybill.plans.rules import Evaluation, recorded
from waybill.streaming.rules import read_recorded, run_rules

NOW = {"availableNow": True}


def records(spark, offsets, value="v"):
    return spark.createDataFrame([("k", f"{value}{o}", "t", o % 3, o, at(o)) for o in offsets], RECORD)


def sink_rows(spark, offsets, value="v"):
    return T.to_sink_rows(records(spark, offsets, value), deterministic_id=True, created_at=F.col("timestamp"))


def payloads(df):
    return {r["kafka_offset"]: r["payload"] for r in df.collect()}


def test_source_options():
    spec = src.SourceSpec(topic="events", servers="b:9092", max_per_batch=3000, min_partitions=24, options={"failOnDataLoss": "true"})
    assert spec.reader_options(True) == {
        "kafka.bootstrap.servers": "b:9092", "subscribe": "events", "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed", "maxOffsetsPerTrigger": "3000", "minPartitions": "24", "failOnDataLoss": "true"}
    assert "maxOffsetsPerTrigger" not in spec.reader_options(False)
    assert src.SourceSpec(format="json", path="p", max_per_batch=2).reader_options(True) == {"maxFilesPerTrigger": "2"}
    with pytest.raises(ValueError):
        src.SourceSpec().reader_options(False)
    out = TopicSpec(topic="audit", servers="b:9092", options=AUDIT_PRODUCER).writer_options()
    assert out["topic"] == "audit" and out["kafka.acks"] == "1" and out["kafka.compression.type"] == "lz4"


def test_sink_row_ids(spark):
    recs = records(spark, range(5))
    fixed = [r["event_id"] for r in T.to_sink_rows(recs, "t", True).collect()]
    assert fixed == [r["event_id"] for r in T.to_sink_rows(recs, "t", True).collect()] and len(set(fixed)) == 5
    assert len(fixed[0]) == 64
    fresh = [{r["event_id"] for r in T.to_sink_rows(recs).collect()} for _ in range(2)]
    assert len(fresh[0]) == 5 and not fresh[0] & fresh[1]
    assert T.to_sink_rows(recs, "other").count() == 0


def test_upsert_replaces_payload_and_id(spark):
    old, new = sink_rows(spark, range(6)), sink_rows(spark, [4, 5, 6], "w").withColumn("event_id", F.lit("new"))
    rows = {r["kafka_offset"]: (r["payload"], r["event_id"] == "new") for r in T.upsert(old, new).collect()}
    assert rows[3] == ("v3", False) and rows[4] == ("w4", True) and rows[6] == ("w6", True) and len(rows) == 7


def test_latest_with_a_hot_key(spark):
    many = spark.range(2000).select(F.lit("t").alias("kafka_topic"), F.lit(0).alias("kafka_partition"), F.lit(7).alias("kafka_offset"), F.col("id").alias("seq"))
    last = T.latest(many.repartition(8), T.SINK_KEY, ["seq"])
    assert [r["seq"] for r in last.collect()] == [1999]


def test_file_upsert_generations(spark, tmp_path):
    target = T.SinkSpec(path=str(tmp_path / "s"), mode="upsert")
    T.write_sink(sink_rows(spark, range(5)), target, 0)
    T.write_sink(sink_rows(spark, [3, 5], "w"), target, 1)
    T.write_sink(sink_rows(spark, [3, 5], "w"), target, 1)  # the same batch again
    want = {0: "v0", 1: "v1", 2: "v2", 3: "w3", 4: "v4", 5: "w5"}
    assert payloads(T.read_upserted(spark, target)) == want
    T.compact_sink(spark, target)
    assert payloads(T.read_upserted(spark, target)) == want
    T.write_sink(sink_rows(spark, range(5)), target, 0)  # folded batches, repeated, change nothing
    T.write_sink(sink_rows(spark, [3, 5], "w"), target, 1)
    assert payloads(T.read_upserted(spark, target)) == want
    T.write_sink(sink_rows(spark, [0], "x"), target, 2)
    T.compact_sink(spark, target)
    assert payloads(T.read_upserted(spark, target)) == want | {0: "x0"}
    # A later run counts its batches from 0 again and is newer all the same.
    T.write_sink(sink_rows(spark, [1], "y"), replace(target, run=7), 0)
    assert payloads(T.read_upserted(spark, target)) == want | {0: "x0", 1: "y1"}
    T.compact_sink(spark, target)
    T.write_sink(sink_rows(spark, [3, 5], "w"), target, 1)
    assert payloads(T.read_upserted(spark, target)) == want | {0: "x0", 1: "y1"}
    with pytest.raises(ValueError):
        T.upsert_sink(sink_rows(spark, [1]), target)


def test_file_append(spark, tmp_path):
    target = T.SinkSpec(path=str(tmp_path / "s"))
    for batch in (0, 0, 1):
        T.write_sink(sink_rows(spark, range(3)), target, batch)
    assert T.read_appended(spark, target).count() == 6
    T.compact_sink(spark, target)
    for batch in (0, 1):
        T.write_sink(sink_rows(spark, range(3)), target, batch)
    assert T.read_appended(spark, target).count() == 6
    T.write_sink(sink_rows(spark, range(3)), replace(target, run=1), 0)
    assert T.read_appended(spark, target).count() == 9
    assert T.read_appended(spark, T.SinkSpec(path=str(tmp_path / "none"))).count() == 0
    plain = T.SinkSpec(path=str(tmp_path / "p"))
    for _ in range(2):
        T.append_sink(sink_rows(spark, range(3)), plain)
    assert src.read_sink(spark, "parquet", plain.path).count() == 6


def test_sink_table_and_schema_check(spark):
    assert T.ensure_sink_table(spark, "sink_events").count() == 0
    sink_rows(spark, [1, 1, 2]).write.mode("append").insertInto("sink_events")
    assert [r["kafka_offset"] for r in T.ensure_sink_table(spark, "sink_events").collect()] == [1]
    assert T.ensure_sink_table(spark, "sink_events", unique=False).count() == 0
    rows = sink_rows(spark, [1])
    with pytest.raises(ValueError, match="lacks"):
        src.check_sink(rows.drop("payload"))
    with pytest.raises(ValueError, match="kafka_offset is"):
        src.check_sink(rows.withColumn("kafka_offset", F.lit("x")))
    spark.sql("DROP TABLE sink_events")


def test_database_statements():
    merge = T.merge_statement("sink_events", "stage_1")
    assert merge == (
        "INSERT INTO sink_events (event_id, kafka_topic, kafka_partition, kafka_offset, payload, created_at) "
        "SELECT event_id, kafka_topic, kafka_partition, kafka_offset, payload, created_at FROM stage_1 "
        "ON CONFLICT (kafka_topic, kafka_partition, kafka_offset) DO UPDATE SET payload = EXCLUDED.payload, event_id = EXCLUDED.event_id")
    assert len(T.sink_ddl("s")) == 2 and len(T.sink_ddl("s", unique=False)) == 1
    # The statements run as written on a database that knows ON CONFLICT.
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE SEQUENCE ids; CREATE TYPE SERIAL AS INTEGER")
    for statement in T.sink_ddl("s"):
        con.execute(statement.replace("PRIMARY KEY", "DEFAULT nextval('ids')"))
    con.execute("CREATE TABLE st AS SELECT 'a' AS event_id, 't' AS kafka_topic, 0 AS kafka_partition, 1 AS kafka_offset, 'p' AS payload, now()::TIMESTAMP AS created_at")
    for payload in ("p", "q"):
        con.execute(f"UPDATE st SET payload = '{payload}'")
        con.execute(T.merge_statement("s", "st"))
    assert con.execute("SELECT payload, count(*) OVER () FROM s").fetchall() == [("q", 1)]


def test_append_statements_add_a_batch_once():
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE TABLE s (event_id VARCHAR, kafka_topic VARCHAR, kafka_partition INT, kafka_offset BIGINT, payload VARCHAR, created_at TIMESTAMP)")
    con.execute("CREATE TABLE st AS SELECT 'a' AS event_id, 't' AS kafka_topic, 0 AS kafka_partition, 1 AS kafka_offset, 'p' AS payload, now()::TIMESTAMP AS created_at")
    for run, batch in ((1, 0), (1, 0), (2, 0), (1, 1), (2, 0)):
        for statement in T.append_statements("s", "st", run, batch):
            con.execute(statement)
    assert con.execute("SELECT count(*) FROM s").fetchone() == (3,)


def test_a_failing_publication_leaves_the_sink_whole(spark, tmp_path, caplog):
    records(spark, range(10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = src.read_records(spark, src.SourceSpec(format="parquet", topic="t", path=str(tmp_path / "in")), streaming=True)
    sink = T.SinkSpec(path=str(tmp_path / "sink"))
    broken = TopicSpec(format="no-such-format", path=str(tmp_path / "audit"))
    stream_sinks.run_sink_stream(stream, sink, str(tmp_path / "ck"), NOW, broken, write_log=str(tmp_path / "log")).awaitTermination()
    assert T.read_appended(spark, sink).count() == 10
    assert "was not published" in caplog.text


def test_shared_folder_is_needed_off_this_machine(spark, monkeypatch):
    from waybill import session

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_publish_files(spark, tmp_path):
    target = TopicSpec(format="json", path=str(tmp_path / "t"))
    publish(audit_rows(spark, "e", [("R", 0), ("C", 1)]), target, "eventId", C.audit_json())
    good, bad = src.parse_audit(spark.read.json(target.path))
    assert good.count() == 2 and bad.count() == 0
    out = TopicSpec(format="json", path=str(tmp_path / "o"))
    stream = spark.readStream.schema("key string, value string").json(target.path)
    publish_stream(stream, out, "key", F.col("value"), str(tmp_path / "ck"), NOW).awaitTermination()
    assert spark.read.json(out.path).count() == 2


def test_sink_stream_survives_a_failed_write(spark, tmp_path, monkeypatch):
    source, sink = str(tmp_path / "in"), T.SinkSpec(path=str(tmp_path / "sink"), mode="upsert")
    trail = TopicSpec(format="parquet", path=str(tmp_path / "audit"))
    spec = src.SourceSpec(format="parquet", topic="t", path=source, max_per_batch=1)

    def run():
        stream = src.read_records(spark, spec, streaming=True)
        stream_sinks.run_sink_stream(
            stream, sink, str(tmp_path / "ck"), NOW, trail, write_log=str(tmp_path / "log")).awaitTermination()

    def events():
        good, _ = src.parse_audit(spark.read.parquet(trail.path))
        return {(r["stage"], r["n"]) for r in good.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).collect()}

    records(spark, range(10)).coalesce(1).write.mode("append").parquet(source)
    run()
    assert events() == {("BATCH_READ", 1), ("OFFSET_COMMITTED", 1)}
    records(spark, range(10, 15)).coalesce(1).write.mode("append").parquet(source)
    real = stream_sinks.write_sink

    def broken(rows, target, batch_id):
        real(rows.limit(2), target, batch_id)
        raise RuntimeError("database is away")

    monkeypatch.setattr(stream_sinks, "write_sink", broken)
    with pytest.raises(Exception, match="database is away"):
        run()
    # Half a batch was written and read, but not committed.
    assert events() == {("BATCH_READ", 2), ("OFFSET_COMMITTED", 1)}
    monkeypatch.setattr(stream_sinks, "write_sink", real)
    run()
    assert set(payloads(T.read_upserted(spark, sink))) == set(range(15))
    assert T.read_appended(spark, sink).count() == 15
    # The repeated batch has the fingerprint it had, so the trail still holds one read of it.
    assert events() == {("BATCH_READ", 2), ("OFFSET_COMMITTED", 2)}
    stats = sink_stats(spark.read.parquet(str(tmp_path / "log")), *[F.current_timestamp()] * 3).first()
    assert (stats["total_consumed"], stats["total_written"], stats["write_errors"]) == (20, 15, 1)


def test_drain(spark, tmp_path):
    records(spark, range(10)).write.parquet(str(tmp_path / "in"))
    stream = src.read_records(spark, src.SourceSpec(format="parquet", path=str(tmp_path / "in")), streaming=True)
    q = stream_sinks.drain(stream, str(tmp_path / "ck"), NOW)
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 10


def test_streamed_counters_equal_batch(spark, tmp_path):
    def outcome(i):
        return (f"e{i}", ["COMMITTED", "LATE_COMMIT"][i % 2], "g", "t", at(0), at(1), at(i), 5, i % 3, i % 2, [(i % 2, 0, 1, 2)])

    parts = [spark.createDataFrame([outcome(i) for i in range(a, a + 20)], OUTCOME) for a in (0, 20)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OUTCOME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_sinks.run_counters(stream, str(tmp_path / "out"), str(tmp_path / "ck"), NOW).awaitTermination()

    def flat(df):
        return {(r["metric"], tuple(sorted(r["labels"].items())), r["value"]) for r in df.collect()}

    assert flat(stream_sinks.read_counters(spark, str(tmp_path / "out"))) == flat(outcome_counters(parts[0].unionByName(parts[1])))


def test_streamed_lifecycle_equals_batch(spark, tmp_path):
    logs = random_logs(5, 8, 12)
    audit = reduce(DataFrame.unionByName, [audit_rows(spark, k, log) for k, log in logs.items()])
    # Files in time order, rows in any order inside a file; equal times do not occur within a key.
    cuts = [0, 300, 900, 1500, 10_000]
    for lo, hi in zip(cuts, cuts[1:]):
        part = audit.where((F.col("timestamp") >= F.lit(at(lo)).cast("timestamp")) & (F.col("timestamp") < F.lit(at(hi)).cast("timestamp")))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(audit.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = lifecycle_stream(stream, late="0 seconds")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(**NOW).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 4
    end = audit.agg(F.max("timestamp")).first()[0]
    want = lifecycle_batch(audit, horizon=F.lit(end))
    got = spark.read.schema(OUTCOME).parquet(str(tmp_path / "out"))
    assert got.count() == want.count() > 100
    assert got.exceptAll(want).count() == 0


def streamed(spark, folder, audit_parts, **options):
    """Outcomes of a lifecycle stream that is started anew for each part."""
    for part in audit_parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = lifecycle_stream(spark.readStream.schema(part.schema).parquet(f"{folder}/in"), **options)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(**NOW).start().awaitTermination()
    return spark.read.schema(OUTCOME).parquet(f"{folder}/out")


def test_events_behind_the_watermark_are_applied(spark, tmp_path):
    beat = audit_rows(spark, "clock", [("C", 20_000)]).withColumn("stage", F.lit("HEARTBEAT"))
    parts = [audit_rows(spark, f"at {t}", [("R", t)]) for t in (10_000, 10_100, 100)]
    # After the clock has passed them all: a late replay does not arm the entry again, a late commit closes it.
    parts += [beat, audit_rows(spark, "at 10000", [("R", 50)]), audit_rows(spark, "at 10100", [("C", 60)])]
    got = {(r["eventId"], r["outcome"], seconds(r["firstSeenAt"]), seconds(r["lastSeenAt"]), seconds(r["observedAt"]))
           for r in streamed(spark, str(tmp_path), parts).collect()}
    assert got == {
        ("at 100", "ESTIMATED_FAILED", 100, 100, 200), ("at 10000", "ESTIMATED_FAILED", 10_000, 10_000, 10_100),
        ("at 10100", "ESTIMATED_FAILED", 10_100, 10_100, 10_200), ("at 10000", "REPLAY_OBSERVED", 10_000, 10_000, 50),
        ("at 10100", "LATE_COMMIT", 10_100, 10_100, 60)}


def test_disorder_within_the_delay_and_the_state_read_back(spark, tmp_path):
    logs = random_logs(9, 6, 10)
    audit = reduce(DataFrame.unionByName, [audit_rows(spark, k, log) for k, log in logs.items()])
    end = max(t for log in logs.values() for _, t in log)
    # Rows of any time in any part; the last part passes the end.
    parts = [audit.where(F.pmod(F.xxhash64("eventId", "timestamp"), F.lit(3)) == k) for k in range(3)]
    beat = audit_rows(spark, "clock", [("C", end + 10_000)]).withColumn("stage", F.lit("HEARTBEAT"))
    got = streamed(spark, str(tmp_path), [*parts, beat], late="10000 seconds")
    horizon = F.lit(at(end))
    want = lifecycle_batch(audit, horizon=horizon)
    assert got.count() == want.count() > 30 and got.exceptAll(want).count() == 0
    left = open_episodes(audit, horizon=horizon)
    found = pending_batches(spark, str(tmp_path / "ck"))
    assert found.columns == left.columns and found.count() == left.count() > 2 and found.exceptAll(left).count() == 0


def test_processing_clock_and_ttl(spark, tmp_path):
    audit_rows(spark, "a", [("R", 0), ("R", 5), ("C", 9)]).unionByName(audit_rows(spark, "b", [("R", 0)])).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("eventId string, stage string, consumerGroup string, sourceTopic string, timestamp timestamp, "
                                     "recordCount int, partitionRanges array<struct<partition:int,offsetMin:bigint,offsetMax:bigint,recordCount:int>>").parquet(str(tmp_path / "in"))
    out = lifecycle_stream(stream, clock="processing", ttl="1 day")
    # A query on the wall clock never runs out of work, so it is stopped once its first batch is written.
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
    deadline = time.time() + 60
    while time.time() < deadline and not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.5)
    q.stop()
    rows = {(r["eventId"], r["outcome"]) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    assert {("a", "REPLAY_OBSERVED"), ("a", "COMMITTED")} <= rows
    with pytest.raises(ValueError):
        lifecycle_stream(stream, clock="other")


def test_rules_stream(spark, tmp_path):
    def scrape(lo, hi):
        rows = [("kafka_broker_messages_in_total", {"instance": "kafka-1"}, at(t), 10.0 * t, "counter") for t in range(lo, hi, 5)]
        spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    scrape(0, 300)
    scrape(300, 600)
    stream = spark.readStream.schema(SAMPLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_rules(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "ck"),
              ["kafka_cluster_messages_per_sec"], trigger=NOW).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()
    assert len(rows) == 120 and spark.read.parquet(str(tmp_path / "store")).count() == 120
    # Full windows, also those that reach back into the batch before.
    assert all(r["value"] == pytest.approx(10 * 295 / 300) for r in rows[61:])


def test_rules_stream_records_each_grid_time_once(spark, tmp_path):
    def scraped(times, offset=0.0):
        return [("kafka_broker_messages_in_total", {"instance": f"kafka-{k}"}, at(t + offset), 10.0 * t + k, "counter") for t in times for k in (1, 2)]

    batches = [scraped(range(13)), scraped(range(13, 22)), scraped([60]), scraped([61, 400, 1000]), scraped([28, 33], 0.5), scraped([3], 0.25)]
    names = ["kafka_cluster_messages_per_sec"]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SAMPLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SAMPLE).parquet(str(tmp_path / "in"))
        # The last batch comes with a checkpoint of its own, which reads all of them again.
        run_rules(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / f"ck{k // 5}"), names, trigger=NOW).awaitTermination()
        every = spark.createDataFrame([r for b in batches[: k + 1] for r in b], SAMPLE)
        last = max(r[2] for b in batches[: k + 1] for r in b)
        want = sorted((seconds(r["ts"]), round(r["value"], 9)) for r in recorded(Evaluation(every, Grid(at(0), last, "5 seconds")), names).collect())
        got = sorted((seconds(r["ts"]), round(r["value"], 9)) for r in read_recorded(spark, str(tmp_path / "out")).collect())
        assert got == want
        if k == 3:
            # Each time was written by one batch only, as nothing was late so far.
            assert spark.read.parquet(str(tmp_path / "out")).count() == len(got) and {15, 30, 55} <= {t for t, _ in got}
        if k == 4:
            again = spark.read.parquet(str(tmp_path / "out")).where("batch_id = 4").select(F.unix_seconds("ts")).collect()
            # Late samples at 28.5 and 33.5 touch two cells of 300 s; the later times are left as they are.
            assert {t // 300 for t, in again} == {0, 1} and max(t for t, _ in got) == 1000


class _Fake:
    """Value and list states and timers of one key, with a count of what is read."""

    def __init__(self):
        self.value, self.items, self.reads = None, [], 0

    def exists(self):
        return self.value is not None or bool(self.items)

    def get(self):
        if isinstance(self, _FakeList):
            self.reads += len(self.items)
            return iter(self.items)
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value, self.items = None, []


class _FakeList(_Fake):
    def appendValue(self, value):
        self.items.append(value)

    def appendList(self, values):
        self.items.extend(values)

    def put(self, values):
        self.items = list(values)


class _Handle:
    def __init__(self):
        self.timers, self.watermark = set(), 0

    def getValueState(self, name, schema):
        return _Fake()

    def getListState(self, name, schema):
        return _FakeList()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def _feed(processor, handle, events, watermark):
    """One micro-batch, with its timers behind the rows as Spark runs them; (outcome, time) in seconds."""
    handle.watermark = watermark * 1000
    rows = [Row(eventId="k", us=s * 1_000_000, seq=0, stage=stage, grp="g", topic="t", records=1, ranges="[]", _clock=None) for stage, s in events]
    out = list(processor.handleInputRows(("k",), iter(rows), handle)) if rows else []
    for at in sorted(t for t in handle.timers if t <= handle.watermark):
        handle.timers.discard(at)
        out += processor.handleExpiredTimer(("k",), handle, None)
    return [(o["outcome"], o["observed"] // 1_000_000) for o in out]


def test_waiting_events_are_not_read_before_they_are_due():
    handle, processor = _Handle(), LifecycleProcessor(90_000_000, 10_000_000, None, True, True)
    processor.init(handle)
    for batch in range(20):
        assert _feed(processor, handle, [("BATCH_READ", 1000 + 10 * batch + i) for i in range(10)], 0) == []
    assert processor.early.reads == 0 and len(processor.early.items) <= 20 and handle.timers == {1_000_000}
    assert _feed(processor, handle, [], 1199) == [("REPLAY_OBSERVED", s) for s in range(1001, 1200)]
    assert processor.early.reads <= 20


def test_due_events_are_taken_before_a_timeout_when_later_ones_arrive():
    handle, processor = _Handle(), LifecycleProcessor(90_000_000, 10_000_000, None, True, True)
    processor.init(handle)
    assert _feed(processor, handle, [("BATCH_READ", 100), ("OFFSET_COMMITTED", 150)], 120) == []
    # The watermark passes the waiting commit and the read's tick in the micro-batch that brings a later event.
    assert _feed(processor, handle, [("BATCH_READ", 900)], 500) == [("COMMITTED", 150)]
    assert _feed(processor, handle, [], 2000) == [("ESTIMATED_FAILED", 1000)]
