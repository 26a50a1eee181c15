"""Named queries over the given tables, one per operator or small group of operators.

Every query takes ``(spark, sf_dir)``, reads whole tables and returns a DataFrame. Times come back
without a zone (UTC) and label sets as sorted JSON text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.functions import columns as C
from waybill.operators import batches as B
from waybill.operators import lifecycle as L
from waybill.operators import ordered as N
from waybill.operators import outcomes as O
from waybill.operators import reconcile as R
from waybill.operators import runs
from waybill.operators import series as S
from waybill.plans import rules, views as V
from waybill.schemas import BATCH_READ, OFFSET_COMMITTED
from waybill.session import cut_lineage, run_of, scratch_path
from waybill.sinks import export, tables as T
from waybill.sinks.topics import TopicSpec, publish
from waybill.sources import records as src
from waybill.sources.matrix import parse_matrix, read_matrix
from waybill.streaming import intake, sinks as stream_sinks
from waybill.streaming.lifecycle import lifecycle_stream, pending_batches as read_pending
from waybill.streaming.rules import read_recorded, run_rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CLOCK = {"timeout": "5 hours", "extra": "1 hour", "tick": "1 hour"}
GRID = S.Grid("2024-01-01", "2024-01-31", "1 hour")
FINE = S.Grid("2024-01-01", "2024-01-31", "5 minutes")
WINDOW = "6 hours"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: _zoneless(fn(spark, sf_dir))
    return fn


def _zoneless(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if kind == "timestamp" else F.col(f"`{n}`") for n, kind in df.dtypes
    ])


def _rounded(value: str = "value") -> Column:
    """Six digits; the nudge takes exact halves the same way whatever the order of a sum was."""
    return F.round(F.col(value) + 1e-9, 6)


def _flat(vector: DataFrame, *more: str) -> DataFrame:
    return vector.select(*more, C.labels_key(F.col("labels")).alias("labels"), "ts", _rounded().alias("value"))


def _flat_outcomes(df: DataFrame) -> DataFrame:
    return df.withColumn("partitionRanges", C.ranges_text(F.col("partitionRanges"))).withColumnRenamed("partitionRanges", "ranges")


def _user_outcomes(spark, sf_dir) -> DataFrame:
    return L.lifecycle_batch(V.audit_log(spark, sf_dir), **CLOCK, order=("timestamp", "seq"))


def _batch_outcomes(spark, sf_dir) -> DataFrame:
    # A fingerprint has at most three events here, so no key can be hot.
    return L.lifecycle_batch(V.batch_audit(spark, sf_dir), **CLOCK, hot_rows=None)


# --- lifecycle ----------------------------------------------------------------------------------

@query
def lifecycle_outcomes(spark, sf_dir):
    return _flat_outcomes(_user_outcomes(spark, sf_dir))


@query
def lifecycle_outcomes_by_type(spark, sf_dir):
    return _user_outcomes(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def lifecycle_hot_keys(spark, sf_dir):
    """Few ids with very many events each: every id is cut into segments."""
    log = V.audit_log(spark, sf_dir).withColumn("eventId", (F.col("eventId").cast("bigint") % 4).cast("string"))
    return _flat_outcomes(L.lifecycle_batch(log, **CLOCK, order=("timestamp", "seq"), hot_rows=500))


@query
def lifecycle_batches(spark, sf_dir):
    return _flat_outcomes(_batch_outcomes(spark, sf_dir))


@query
def lifecycle_summary(spark, sf_dir):
    log = V.audit_log(spark, sf_dir)
    return L.lifecycle_summary(log, **CLOCK, order=("timestamp", "seq"), horizon=F.lit("2024-01-29 12:00:00").cast("timestamp"))


@query
def lifecycle_streamed(spark, sf_dir):
    """The stateful stream over the events file; ticks run up to the last event."""
    log = V.audit_log_of(_event_stream(spark, sf_dir))
    out = lifecycle_stream(log, **CLOCK, late="0 seconds", seq="seq")
    path = scratch_path(spark, "outcomes")
    _run(out.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "state")))
    return _flat_outcomes(spark.read.schema(out.schema).parquet(path))


def _in_parts(spark, rows: DataFrame, parts: list[Column], step: Callable[[DataFrame], None]) -> None:
    """Write each part of ``rows`` to a folder when the one before it was streamed; every part is a start of its own."""
    source = scratch_path(spark, "source")
    for part in parts:
        rows.where(part).write.mode("append").parquet(source)
        step(spark.readStream.schema(rows.schema).parquet(source))


def _out_of_order(spark, sf_dir) -> tuple[DataFrame, list[Column]]:
    """The audit log in four parts of disturbed time order, and a last row that only moves the clock."""
    log = V.audit_log(spark, sf_dir)
    beat = log.agg(F.max("timestamp").alias("timestamp")).select(
        F.lit("clock").alias("eventId"), F.lit("HEARTBEAT").alias("stage"), (F.col("timestamp") + F.expr("INTERVAL '25 00:00:00.001' DAY TO SECOND")).alias("timestamp"))
    week = F.floor(F.dayofmonth("timestamp") / 8)
    parts = [(F.col("stage") != "HEARTBEAT") & (week == w) for w in (2, 0, 3, 1)]
    return log.unionByName(beat, allowMissingColumns=True), [*parts, F.col("stage") == "HEARTBEAT"]


@query
def lifecycle_late_events(spark, sf_dir):
    """Weeks streamed out of order, with a restart before each: outcomes are those of the batch operator, and no event is lost."""
    log, parts = _out_of_order(spark, sf_dir)
    path, state = scratch_path(spark, "outcomes"), scratch_path(spark, "state")

    def step(stream: DataFrame) -> None:
        out = lifecycle_stream(stream, **CLOCK, late="25 days", seq="seq")
        _run(out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state))

    _in_parts(spark, log, parts, step)
    return _flat_outcomes(spark.read.parquet(path))


@query
def open_episodes(spark, sf_dir):
    """Ids that are read and not committed when the log ends, with ticks up to its last event."""
    log = V.audit_log(spark, sf_dir)
    end = log.agg(F.max("timestamp") + F.expr("INTERVAL '0.001' SECOND")).first()[0]
    return _flat_outcomes(L.open_episodes(log, **CLOCK, order=("timestamp", "seq"), horizon=F.lit(end)))


@query
def pending_batches(spark, sf_dir):
    """The same, read from the state of a stream that was stopped and started four times."""
    log, parts = _out_of_order(spark, sf_dir)
    state = scratch_path(spark, "state")

    def step(stream: DataFrame) -> None:
        _run(lifecycle_stream(stream, **CLOCK, late="25 days", seq="seq").writeStream.format("noop").option("checkpointLocation", state))

    _in_parts(spark, log, parts, step)
    return _flat_outcomes(read_pending(spark, state))


def _event_stream(spark, sf_dir) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # As a pattern, because a file stream takes a folder or a pattern but not one plain file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _run(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


@query
def lifecycle_summary_streamed(spark, sf_dir):
    """Outcomes counted as they pass, over the same parts and restarts, and the entries left in the state."""
    log, parts = _out_of_order(spark, sf_dir)
    state, totals = scratch_path(spark, "state"), intake.Totals("lifecycle")
    spark.streams.addListener(totals)

    def step(stream: DataFrame) -> None:
        out = intake.observed_outcomes(lifecycle_stream(stream, **CLOCK, late="25 days", seq="seq"))
        totals.wait(out.writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start())

    try:
        _in_parts(spark, log, parts, step)
    finally:
        spark.streams.removeListener(totals)
    counted = [F.lit(totals.totals.get(n, 0)).cast("bigint").alias(n) for n in ("replays", "estimatedFailed", "lateCommits", "committed")]
    return read_pending(spark, state).agg(F.count(F.when(F.isnull("timedOutAt"), 1)).alias("pending")).select("pending", *counted)


@query
def read_commit_pairs_streamed(spark, sf_dir):
    """Reads joined with commits over ten-day parts of the log, with a restart before each, and a last pair that moves the clock."""
    log = V.batch_audit(spark, sf_dir).select("eventId", "stage", "timestamp")
    clock = log.agg(F.max("timestamp").alias("timestamp")).select(
        F.lit("clock").alias("eventId"), F.explode(F.array(F.lit(BATCH_READ), F.lit(OFFSET_COMMITTED))).alias("stage"),
        (F.col("timestamp") + F.expr("INTERVAL 3 DAYS")).alias("timestamp"))
    path, state = scratch_path(spark, "pairs"), scratch_path(spark, "state")
    span = F.when(F.col("eventId") == "clock", 9).otherwise(F.least(F.floor((F.dayofyear("timestamp") - 1) / 10), F.lit(3)))

    def step(stream: DataFrame) -> None:
        out = intake.pair_stream(stream, "1 day", "2 hours")
        _run(out.writeStream.format("parquet").option("path", path).option("checkpointLocation", state))

    _in_parts(spark, log.unionByName(clock), [span == p for p in (0, 1, 2, 3, 9)], step)
    return intake.pairs_of(spark.read.parquet(path).where(F.col("eventId") != "clock"))


@query
def audit_intake_streamed(spark, sf_dir):
    """Audit texts split by a stream over three parts: what was written, set aside and counted on the way."""
    raw = _audit_text(spark, sf_dir)
    good, bad, state = (scratch_path(spark, n) for n in ("good", "quarantine", "state"))
    totals = intake.Totals("intake")
    spark.streams.addListener(totals)
    third = F.pmod(F.xxhash64(*raw.columns), F.lit(3))
    try:
        _in_parts(spark, raw, [third == k for k in range(3)], lambda stream: totals.wait(
            intake.run_intake(stream, good, bad, state, trigger={"availableNow": True})))
    finally:
        spark.streams.removeListener(totals)
    counts = [("counted_" + k, F.lit(totals.totals.get(k, 0)).cast("bigint")) for k in ("read", "good", "quarantined")]
    counted = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("rows"), n.alias("n")) for k, n in counts))).alias("x")).select("x.*")
    stored = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("rows"), "n") for k, p in (("good", good), ("quarantined", bad))]
    return reduce(DataFrame.unionByName, [counted, *stored])


# --- outcome counters and rates -----------------------------------------------------------------

@query
def outcome_counters(spark, sf_dir):
    return O.outcome_counts(_batch_outcomes(spark, sf_dir))


@query
def outcome_counter_samples(spark, sf_dir):
    return _flat(O.counter_samples(_batch_outcomes(spark, sf_dir), "1 hour"), "metric")


@query
def outcome_counters_streamed(spark, sf_dir):
    """Counters kept by a stream that reads outcome JSON as the exporter does."""
    source, table = scratch_path(spark, "outcome-json"), scratch_path(spark, "counters")
    publish(_batch_outcomes(spark, sf_dir), TopicSpec(format="parquet", path=source), "eventId", C.outcome_json())
    stream = spark.readStream.schema("key string, value string").parquet(source)
    good, _ = src.parse_outcomes(stream)
    stream_sinks.run_counters(good, table, scratch_path(spark, "state"), {"availableNow": True}).awaitTermination()
    return stream_sinks.read_counters(spark, table).select("metric", C.labels_key(F.col("labels")).alias("labels"), F.col("value").cast("bigint").alias("value"))


@query
def counters_incremental(spark, sf_dir):
    """The same counters from four streams over one checkpoint, each over the outcomes of a week, folded after every second batch."""
    table, state = scratch_path(spark, "counters"), scratch_path(spark, "state")
    week = F.floor((F.dayofmonth("observedAt") - 1) / 8)

    def step(stream: DataFrame) -> None:
        stream_sinks.run_counters(stream, table, state, {"availableNow": True}, fold_every=2).awaitTermination()

    _in_parts(spark, _batch_outcomes(spark, sf_dir), [week == w for w in range(4)], step)
    return stream_sinks.read_counters(spark, table).select("metric", C.labels_key(F.col("labels")).alias("labels"), F.col("value").cast("bigint").alias("value"))


@query
def export_totals(spark, sf_dir):
    return O.export_totals(O.outcome_counts(_batch_outcomes(spark, sf_dir)))


@query
def outcome_rates(spark, sf_dir):
    rates = O.outcome_rates(_batch_outcomes(spark, sf_dir), V.batch_audit(spark, sf_dir))
    return rates.select(
        "consumer_group", "source_topic", "batches_read",
        *[F.round(c, 6).alias(c) for c in ("estimated_failure_rate", "replay_rate", "late_commit_ratio")],
    )


@query
def replay_severity(spark, sf_dir):
    return O.replay_severity(_user_outcomes(spark, sf_dir))


@query
def replay_severity_by_partition(spark, sf_dir):
    return O.replay_severity(_batch_outcomes(spark, sf_dir), ("sourceTopic", "partition"))


@query
def timeout_pressure(spark, sf_dir):
    return O.timeout_pressure(_user_outcomes(spark, sf_dir), "6 hours")


@query
def replay_concentration(spark, sf_dir):
    return O.replay_concentration(_batch_outcomes(spark, sf_dir)).withColumn("share", F.round("share", 6))


# --- batches and commits --------------------------------------------------------------------------

@query
def batch_ranges(spark, sf_dir):
    return B.partition_ranges(V.batched(V.records(spark, sf_dir)), ["batch_no"])


@query
def batch_reads(spark, sf_dir):
    out = V.batches(spark, sf_dir)
    return out.select("batch_no", "eventId", "stage", "consumerGroup", "sourceTopic", "timestamp", "recordCount",
                      C.ranges_text(F.col("partitionRanges")).alias("ranges"))


def _consumer_log(spark, sf_dir) -> DataFrame:
    """A consumer's log: clicks and views are polls of that id, purchases are bare commits."""
    log = V.audit_log(spark, sf_dir)
    read = F.col("stage") == BATCH_READ
    return log.withColumn("eventId", F.when(read, F.concat(F.lit("batch-"), F.col("seq").cast("string"))))


@query
def commit_events(spark, sf_dir):
    found = B.committed_batches(_consumer_log(spark, sf_dir), ["consumerGroup"], ["timestamp", "seq"])
    return found.select("consumerGroup", "eventId", "timestamp", "seq")


@query
def commit_events_hot(spark, sf_dir):
    found = B.committed_batches(_consumer_log(spark, sf_dir), ["consumerGroup"], ["timestamp", "seq"], hot_rows=500)
    return found.select("consumerGroup", "eventId", "timestamp", "seq")


@query
def commit_offsets(spark, sf_dir):
    return B.commit_offsets(V.records(spark, sf_dir))


@query
def chunk_sizes(spark, sf_dir):
    chunks = N.chunk(V.records(spark, sf_dir), ["offset"], 200, ["topic", "partition"])
    return chunks.groupBy("topic", "partition", "chunk").agg(
        F.count(F.lit(1)).alias("size"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query
def chunk_sizes_hot(spark, sf_dir):
    chunks = N.chunk(V.records(spark, sf_dir), ["offset"], 200, ["topic"], hot_rows=1000)
    return chunks.groupBy("topic", "chunk").agg(
        F.count(F.lit(1)).alias("size"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


@query
def sink_stats(spark, sf_dir):
    """Write log of batches: every seventh failed, every eleventh was written in half."""
    n, size = F.col("batch_no"), F.col("recordCount").cast("bigint")
    failed, half = n % 7 == 3, (n % 11 == 4) & (n % 7 != 3)
    log = V.batches(spark, sf_dir).select(
        F.col("timestamp").alias("at"), size.alias("consumed"),
        F.when(failed, 0).when(half, F.greatest(F.lit(1), F.floor(size / 2))).otherwise(size).alias("written"),
        failed.cast("int").alias("failed"), half.cast("int").alias("partial"),
    )
    at = [F.lit(t).cast("timestamp") for t in ("2024-01-01", "2024-01-20", "2024-01-31")]
    out = R.sink_stats(log, *at)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_rate") else c for c in out.columns])


# --- sources and parsing ----------------------------------------------------------------------------

@query
def records_scan(spark, sf_dir):
    return src.only_topic(V.records(spark, sf_dir), "events").groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"),
        F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query
def records_read_back(spark, sf_dir):
    """Records written to files and read through a source spec."""
    path = scratch_path(spark, "records")
    V.records(spark, sf_dir).write.parquet(path)
    return src.read_records(spark, src.SourceSpec(format="parquet", topic="events", path=path)).select(
        "key", "value", "topic", "partition", "offset", "timestamp")


def _audit_text(spark, sf_dir) -> DataFrame:
    """Audit JSON in twelve forms, good and bad, one per event."""
    i = F.col("event_id").cast("string")
    head = F.concat(F.lit('"stage":"BATCH_READ","consumerGroup":"g","sourceTopic":"t","eventId":"e'), i, F.lit('"'))
    at = F.lit('"timestamp":"2024-02-03T04:05:06.5Z"')
    one = F.concat(F.lit('"partitionRanges":[{"partition":3,"offsetMin":'), i, F.lit(',"offsetMax":'), i, F.lit(',"recordCount":1}]'))

    def doc(*parts) -> Column:
        return F.concat(F.lit("{"), F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit("}"))

    forms = [
        doc(head, at, '"recordCount":5', one),
        doc(F.regexp_replace(head, "BATCH_READ", "OFFSET_COMMITTED"), at, '"recordCount":0'),
        doc('"stage":"BATCH_READ","consumerGroup":"g","sourceTopic":"t"', at, '"recordCount":5', one),
        doc(F.regexp_replace(head, '"g"', "null"), at, '"recordCount":5', one),
        doc(F.regexp_replace(head, "BATCH_READ", "OTHER"), at, '"recordCount":5', one),
        doc(head, '"timestamp":"yesterday"', '"recordCount":5', one),
        doc(head, at, '"recordCount":5'),
        doc(head, at, '"recordCount":5', '"partitionRanges":[{"partition":3,"offsetMin":1,"recordCount":1}]'),
        F.lit("{bad-json}"),
        doc(head, at, '"recordCount":"7"', one),
        doc(head, at, '"recordCount":5', one, '"other":{"a":[1]}'),
        doc(head, at, '"recordCount":5', '"partitionRanges":{"partition":3}'),
    ]
    form = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    return V.events(spark, sf_dir).select(F.col("event_id").alias("offset"), form.alias("value"))


@query
def audit_json_parse(spark, sf_dir):
    good, _ = src.parse_audit(_audit_text(spark, sf_dir), carry=["offset"])
    return good.select("offset", "eventId", "stage", "consumerGroup", "sourceTopic", "timestamp", "recordCount",
                       C.ranges_text(F.col("partitionRanges")).alias("ranges"))


@query
def audit_json_rejects(spark, sf_dir):
    _, bad = src.parse_audit(_audit_text(spark, sf_dir))
    return bad.groupBy((F.col("offset") % 12).alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query
def audit_json_round_trip(spark, sf_dir):
    """Batch audit written as JSON and parsed again, by stage."""
    text = V.batch_audit(spark, sf_dir).select("batch_no", C.audit_json().alias("value"))
    good, _ = src.parse_audit(text, carry=["batch_no"])
    reads = src.route(good, BATCH_READ).select("batch_no", "eventId", "stage", "timestamp", "recordCount", "partitionRanges")
    commits = src.route(good, OFFSET_COMMITTED).select(*reads.columns)
    return reads.unionByName(commits).withColumn("partitionRanges", C.ranges_text(F.col("partitionRanges"))).withColumnRenamed(
        "partitionRanges", "ranges")


def _outcome_text(spark, sf_dir) -> DataFrame:
    """Outcome JSON in eight forms, good and bad, one per event."""
    i = F.col("event_id").cast("string")
    head = F.concat(F.lit('{"eventId":"e'), i, F.lit('","outcome":"COMMITTED","consumerGroup":"g","sourceTopic":"t"'))
    iso = F.lit(',"firstSeenAt":"2026-03-20T00:00:00Z","lastSeenAt":"2026-03-20T00:00:05Z","observedAt":"2026-03-20T00:00:05Z"')
    epoch = F.lit(',"firstSeenAt":1773964800.000000000,"lastSeenAt":1773964805.250000000,"observedAt":1773964805.250000000')
    counts = F.lit(',"recordCount":10,"replayCount":2,"timeoutCount":1')
    one = F.concat(F.lit(',"partitionRanges":[{"partition":0,"offsetMin":'), i, F.lit(',"offsetMax":104,"recordCount":5}]'))
    end = F.lit("}")
    forms = [
        F.concat(head, iso, counts, one, end),
        F.concat(head, epoch, counts, one, end),
        F.concat(head, iso, one, end),
        F.concat(head, iso, counts, F.lit(',"partitionRanges":null}')),
        F.concat(F.regexp_replace(head, '"outcome":"COMMITTED",', ""), iso, counts, one, end),
        F.lit("{bad-json}"),
        F.concat(head, iso, counts, one, F.lit(',"unknown":{"x":1}}')),
        F.concat(F.regexp_replace(head, '"g"', '"  "'), iso, counts, one, end),
    ]
    form = F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int"))
    return V.events(spark, sf_dir).select(F.col("event_id").alias("offset"), form.alias("value"))


@query
def outcome_json_parse(spark, sf_dir):
    good, _ = src.parse_outcomes(_outcome_text(spark, sf_dir), carry=["offset"])
    return _flat_outcomes(good.withColumn("consumerGroup", C.label_or_unknown(F.col("consumerGroup"))))


@query
def outcome_json_rejects(spark, sf_dir):
    _, bad = src.parse_outcomes(_outcome_text(spark, sf_dir))
    return bad.groupBy((F.col("offset") % 8).alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query
def outcome_json_round_trip(spark, sf_dir):
    text = _user_outcomes(spark, sf_dir).select(C.outcome_json().alias("value"))
    return _flat_outcomes(src.parse_outcomes(text)[0])


@query
def matrix_scan(spark, sf_dir):
    """Range-query documents, one per event, parsed into samples."""
    at = (F.unix_micros("ts") / 1e6).cast("decimal(20,6)").cast("string")
    doc = F.concat(
        F.lit('{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"__name__":"m_'), F.col("event_type"),
        F.lit('","user":"'), F.col("user_id").cast("string"), F.lit('"},"values":[['), at, F.lit(',"'),
        F.col("value").cast("string"), F.lit('"],['), at, F.lit(',"1"]]}]}}'),
    )
    parsed = parse_matrix(V.events(spark, sf_dir).select(doc.alias("value")))
    return _flat(parsed, "metric")


# --- sinks and reconciliation --------------------------------------------------------------------------

@query
def sink_rows(spark, sf_dir):
    return T.to_sink_rows(V.records(spark, sf_dir), "events", deterministic_id=True, created_at=F.col("timestamp"))


def _versions(spark, sf_dir) -> DataFrame:
    """Every record, and a second write a minute later for every third: the later payload must win."""
    first = T.to_sink_rows(V.records(spark, sf_dir), deterministic_id=True, created_at=F.col("timestamp"))
    again = first.where(F.col("kafka_offset") % 3 == 0).withColumns({
        "payload": F.concat(F.lit("v2-"), F.col("payload")),
        "created_at": F.col("created_at") + F.expr("INTERVAL '1' MINUTE"),
    })
    return first.unionByName(again)


@query
def latest_write(spark, sf_dir):
    return T.latest(_versions(spark, sf_dir), T.SINK_KEY, ["created_at", "event_id"])


@query
def sink_upsert(spark, sf_dir):
    rows = V.sink_rows(spark, sf_dir)
    patch = rows.where(F.col("kafka_offset") % 5 == 0).withColumn("payload", F.lit("patched"))
    return T.upsert(rows, patch)


@query
def sink_upsert_files(spark, sf_dir):
    """Two generations written to files; the later one wins per key. Read after compaction."""
    target = T.SinkSpec(path=scratch_path(spark, "upsert"), mode="upsert")
    rows = V.sink_rows(spark, sf_dir)
    T.write_sink(rows, target, batch_id=0)
    T.write_sink(rows.where(F.col("kafka_offset") % 5 == 0).withColumn("payload", F.lit("patched")), target, batch_id=1)
    T.compact_sink(spark, target)
    return T.read_upserted(spark, target)


@query
def sink_compact_repeat(spark, sf_dir):
    """Three generations, compaction, a repeat of each batch, one more generation and compaction again."""
    target = T.SinkSpec(path=scratch_path(spark, "upsert"), mode="upsert")
    rows = V.sink_rows(spark, sf_dir)

    def write(batch_id: int) -> None:
        chosen = rows.where(F.col("kafka_offset") % (batch_id + 1) == 0)
        T.write_sink(chosen.withColumn("payload", F.concat(F.lit(f"g{batch_id}-"), "payload")), target, batch_id)

    for batch_id in range(3):
        write(batch_id)
    T.compact_sink(spark, target)
    for batch_id in range(4):
        write(batch_id)
    T.compact_sink(spark, target)
    write(3)
    return T.read_upserted(spark, target)


@query
def sink_lookup(spark, sf_dir):
    """Current rows of the places that the source delivered more than once, looked up in an indexed base and two generations, one of them not indexed."""
    target = T.SinkSpec(path=scratch_path(spark, "upsert"), mode="upsert")
    rows = V.sink_rows(spark, sf_dir)
    weeks = F.floor((F.dayofmonth("created_at") - 1) / 8)
    for week in range(4):
        T.write_sink(rows.where(weeks == week), target, week)
        if week % 2:
            T.compact_sink(spark, target)
            T.vacuum_sink(spark, target)
    T.index_sink(spark, target)
    twice = R.sink_duplicates(rows)
    T.write_sink(rows.join(twice, list(T.SINK_KEY), "left_semi").withColumn("payload", F.concat(F.lit("again-"), "payload")), target, 4)
    return T.lookup_upserted(spark, target, twice)


@query
def sink_two_streams(spark, sf_dir):
    """Two streams with checkpoints of their own write to one append sink: the second adds to the first."""
    sink = T.SinkSpec(path=scratch_path(spark, "append"))
    for rest in (0, 1):
        stream = V.records_of(_event_stream(spark, sf_dir)).where(F.col("offset") % 2 == rest)
        stream_sinks.run_sink_stream(stream, sink, scratch_path(spark, "state"), {"availableNow": True}).awaitTermination()
    return T.read_appended(spark, sink).groupBy("kafka_topic", "kafka_partition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("kafka_offset").alias("offset_sum"))


@query
def sink_streamed_restart(spark, sf_dir):
    """A stream over four files stops after two batches, fails in the middle of a write, and goes on where it was."""
    source, state = scratch_path(spark, "records"), scratch_path(spark, "state")
    sink, log = T.SinkSpec(path=scratch_path(spark, "sink"), mode="upsert"), scratch_path(spark, "log")
    recs = V.records(spark, sf_dir)

    def run(*quarters: int, breaks: bool = False) -> None:
        for q in quarters:
            recs.where(F.col("offset") % 4 == q).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        if breaks:
            # The write of half a batch is what a crash leaves behind.
            half = T.to_sink_rows(recs.where("offset % 8 = 2"), deterministic_id=True, created_at=F.col("timestamp"))
            T.write_sink(half, replace(sink, run=run_of(spark, state)), 2)
        stream_sinks.run_sink_stream(stream, sink, state, {"availableNow": True}, write_log=log).awaitTermination()

    run(0, 1)
    run(2, breaks=True)
    run(3)
    return T.read_upserted(spark, sink).select("event_id", "kafka_partition", "kafka_offset", "payload")


@query
def sink_append_files(spark, sf_dir):
    """The same batch delivered twice under one batch id is held once; other copies stay."""
    target = T.SinkSpec(path=scratch_path(spark, "append"))
    rows = V.sink_rows(spark, sf_dir)
    for _ in range(2):
        T.write_sink(rows, target, batch_id=0)
    return src.check_sink(T.read_appended(spark, target)).groupBy("kafka_topic", "kafka_partition").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("kafka_offset").alias("places"))


@query
def sink_streamed(spark, sf_dir):
    """Records streamed into an upsert sink with its audit trail; the trail says the batch was committed."""
    sink = T.SinkSpec(path=scratch_path(spark, "sink"), mode="upsert")
    trail = TopicSpec(format="parquet", path=scratch_path(spark, "audit"))
    stream = V.records_of(_event_stream(spark, sf_dir))
    stream_sinks.run_sink_stream(stream, sink, scratch_path(spark, "state"), {"availableNow": True}, trail).awaitTermination()
    events, _ = src.parse_audit(spark.read.parquet(trail.path))
    stored = T.read_upserted(spark, sink).select("kafka_offset", F.lit(None).cast("int").alias("recordCount"), F.lit("STORED").alias("stage"))
    both = stored.unionByName(events.select(F.lit(None).cast("bigint").alias("kafka_offset"), "recordCount", "stage"))

    def count(stage: str, name: str):
        return F.sum((F.col("stage") == stage).cast("bigint")).alias(name)

    return both.agg(
        count("STORED", "stored"), F.sum("kafka_offset").alias("offset_sum"), F.sum("recordCount").alias("audited"),
        count(BATCH_READ, "reads"), count(OFFSET_COMMITTED, "commits"))


@query
def sink_missing(spark, sf_dir):
    return R.sink_missing(V.records(spark, sf_dir), V.sink_rows(spark, sf_dir))


@query
def sink_completeness(spark, sf_dir):
    return R.sink_completeness(V.records(spark, sf_dir), V.sink_rows(spark, sf_dir))


@query
def sink_duplicates(spark, sf_dir):
    return R.sink_duplicates(V.sink_rows(spark, sf_dir))


@query
def partial_batches(spark, sf_dir):
    out = R.partial_batches(V.batches(spark, sf_dir), V.sink_rows(spark, sf_dir), ["batch_no"])
    return out.withColumn("written_share", F.round("written_share", 6))


@query
def read_commit_pairs(spark, sf_dir):
    return R.read_commit_pairs(V.batch_audit(spark, sf_dir))


@query
def unmatched_reads(spark, sf_dir):
    return R.unmatched_reads(V.batch_audit(spark, sf_dir))


@query
def unknown_commits(spark, sf_dir):
    """Ids per user and day, so that some ids are committed without having been read."""
    log = V.audit_log(spark, sf_dir)
    return R.unknown_commits(log.withColumn("eventId", F.concat_ws("-", "eventId", F.date_format("timestamp", "yyyyMMdd"))))


# --- labels ---------------------------------------------------------------------------------------------

def _counted(df: DataFrame) -> DataFrame:
    return df.groupBy("metric", C.labels_key(F.col("labels")).alias("labels")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def metric_names(spark, sf_dir):
    return S.metric_names(V.samples(spark, sf_dir))


@query
def keep_metrics(spark, sf_dir):
    samples = V.samples(spark, sf_dir)
    kept = [S.keep_metrics(samples, regex).select(F.lit(job).alias("job"), "metric") for job, regex in rules.KEEP_LISTS.items()]
    return kept[0].unionByName(kept[1]).groupBy("job", "metric").agg(F.count(F.lit(1)).alias("n"))


@query
def attach_labels(spark, sf_dir):
    samples = V.samples(spark, sf_dir).where(F.col("metric") == "kafka_consumergroup_lag")
    return _counted(S.attach_labels(samples, {**rules.JOB_LABELS["kafka-exporter"], "cluster": "kafka-research"}))


@query
def match_labels(spark, sf_dir):
    return _counted(S.match_labels(V.samples(spark, sf_dir), eq={"broker_id": "2"}, regex={"instance": "kafka-[0-9]+"}))


@query
def label_replace(spark, sf_dir):
    samples = V.samples(spark, sf_dir).where(F.col("metric") == "container_memory_usage_bytes")
    return _counted(S.label_replace(samples, "broker", "$1", "name", "(kafka-[0-9]+)"))


@query
def bean_metrics(spark, sf_dir):
    return rules.project_beans(V.bean_samples(spark, sf_dir)).groupBy(
        "metric", "kind", C.labels_key(F.col("labels")).alias("labels")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def file_names(spark, sf_dir):
    raw = F.concat(F.lit("._"), "event_type", F.lit(" /é:"), (F.col("user_id") % 3).cast("string"), F.lit("."))
    blank = F.when(F.col("user_id") % 10 == 0, F.lit("._.")).otherwise(raw)
    return V.events(spark, sf_dir).select(C.file_name(blank).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query
def series_names(spark, sf_dir):
    samples = V.samples(spark, sf_dir).withColumn(
        "labels", F.when(F.col("metric") == "jvm_process_cpu_load_ratio", F.create_map().cast("map<string,string>")).otherwise(F.col("labels")))
    return samples.select("metric", C.series_name(F.col("labels")).alias("series")).groupBy("metric", "series").agg(
        F.count(F.lit(1)).alias("n"))


@query
def last_values(spark, sf_dir):
    rows = V.samples(spark, sf_dir).withColumn("value", F.when(F.unix_micros("ts") % 2 == 0, F.col("value")))
    return S.last_not_null(rows).withColumn("value", F.round("value", 6))


# --- series and rules ------------------------------------------------------------------------------------

@query
def increase_6h(spark, sf_dir):
    return _flat(S.increase(V.samples(spark, sf_dir), WINDOW, GRID), "metric")


@query
def increase_hot_series(spark, sf_dir):
    """The same with slices so long and a threshold so low that slices are cut into several pieces."""
    daily = replace(GRID, step="1 day")
    return _flat(S.increase(V.samples(spark, sf_dir), "3 days", daily, hot_rows=15), "metric")


def _one_series(spark, sf_dir) -> DataFrame:
    """Every event as a sample of one counter."""
    return V.events(spark, sf_dir).select(
        F.lit("events_total").alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), "ts",
        (F.col("event_id") % 4001).cast("double").alias("value"))


@query
def increase_long_series(spark, sf_dir):
    """One series in ranges of a day, each ordered by itself."""
    return _flat(S.increase(_one_series(spark, sf_dir), "15 minutes", FINE, range_slices=288), "metric")


@query
def instant_long_series(spark, sf_dir):
    return _flat(S.instant(_one_series(spark, sf_dir), FINE, "1 hour", range_slices=288), "metric")


@query
def increase_15m(spark, sf_dir):
    return _flat(S.increase(V.samples(spark, sf_dir), "15 minutes", FINE), "metric")


@query
def rate_5m(spark, sf_dir):
    return _flat(S.rate(V.samples(spark, sf_dir), "5 minutes", FINE), "metric")


@query
def rate_uneven_step(spark, sf_dir):
    """Window and step without a common multiple at hand: 50 minutes every 2 hours leaves gaps."""
    return _flat(S.rate(V.samples(spark, sf_dir), "50 minutes", replace(GRID, step="2 hours")), "metric")


@query
def instant_grid(spark, sf_dir):
    return _flat(S.instant(V.samples(spark, sf_dir), GRID, "90 minutes"), "metric")


@query
def sum_by_instance(spark, sf_dir):
    heap = S.instant(V.samples(spark, sf_dir).where(F.col("metric") == "jvm_heap_used_bytes"), GRID, WINDOW)
    return _flat(S.agg_by(heap, "sum", ["instance"]))


@query
def average_load(spark, sf_dir):
    load = S.instant(V.samples(spark, sf_dir).where(F.col("metric") == "jvm_process_cpu_load_ratio"), GRID, WINDOW)
    return _flat(S.agg_by(load, "avg"))


def _evaluation(spark, sf_dir, keep: bool = False) -> rules.Evaluation:
    return rules.Evaluation(V.samples(spark, sf_dir), GRID, WINDOW, WINDOW, keep=keep)


def _rules(spark, sf_dir, *names: str, keep: bool = False) -> DataFrame:
    return _flat(rules.evaluate(_evaluation(spark, sf_dir, keep), rules.RULES, list(names)), "query")


@query
def vector_add(spark, sf_dir):
    e = _evaluation(spark, sf_dir)
    return _flat(S.vector_op(e.rate("kafka_broker_bytes_in_total"), e.rate("kafka_broker_bytes_out_total"), "+"))


@query
def vector_or(spark, sf_dir):
    e = _evaluation(spark, sf_dir)
    left = S.match_labels(e.rate("kafka_broker_bytes_in_total"), regex={"instance": "kafka-[12]"})
    return _flat(S.vector_or(left, e.rate("kafka_broker_bytes_out_total")))


@query
def broker_throughput(spark, sf_dir):
    return _rules(spark, sf_dir, "kafka_broker_bytes_in_kb_per_sec", "kafka_broker_bytes_out_kb_per_sec",
                  "kafka_broker_throughput_kb_per_sec", keep=True)


@query
def cluster_throughput(spark, sf_dir):
    return _rules(spark, sf_dir, "kafka_cluster_bytes_in_kb_per_sec", "kafka_cluster_bytes_out_kb_per_sec",
                  "kafka_cluster_throughput_bytes_per_sec", "kafka_cluster_messages_per_sec", keep=True)


@query
def consumer_lag(spark, sf_dir):
    return _rules(spark, sf_dir, "kafka_cluster_consumer_lag_messages")


@query
def broker_cpu(spark, sf_dir):
    return _rules(spark, sf_dir, "kafka_broker_cpu_percent")


@query
def cluster_cpu(spark, sf_dir):
    return _rules(spark, sf_dir, "kafka_cluster_cpu_percent", "kafka_cluster_cpu_cores", "kafka_host_cpu_cores",
                  "kafka_cluster_cpu_host_percent", "kafka_cluster_jvm_cpu_percent", keep=True)


@query
def container_memory(spark, sf_dir):
    return _rules(spark, sf_dir, "kafka_broker_container_memory_mb", "kafka_cluster_container_memory_gb", keep=True)


@query
def jvm_memory(spark, sf_dir):
    return _rules(spark, sf_dir, "jvm_heap_used_gb", "jvm_non_heap_used_gb")


@query
def host_usage(spark, sf_dir):
    return _rules(spark, sf_dir, "host_cpu_busy_percent", "host_memory_used_percent")


def _counter_samples(spark, sf_dir, step: str) -> DataFrame:
    """Audit counters as stored samples: several evaluations read them, the lifecycle runs once."""
    return cut_lineage(O.counter_samples(_batch_outcomes(spark, sf_dir), step))


def _all_samples(spark, sf_dir) -> DataFrame:
    """Scraped samples and the audit counters."""
    return V.samples(spark, sf_dir).unionByName(_counter_samples(spark, sf_dir, "1 hour"))


@query
def recorded_rules(spark, sf_dir):
    """Rules recorded as samples, then read again through the recorded series."""
    recorded = rules.recorded(_evaluation(spark, sf_dir, keep=True))
    return _flat(S.instant(recorded, GRID, "1 hour"), "metric")


@query
def rules_streamed(spark, sf_dir):
    """All rules recorded by a stream over uneven batches: two days, one without half its hours, the rest, and then the hours left out."""
    store, out, state = (scratch_path(spark, n) for n in ("samples", "recorded", "state"))
    day, hour = F.dayofmonth("ts"), F.hour("ts")
    missing = (day >= 3) & (day <= 9) & (hour % 2 == 1)
    parts = [day <= 2, (day == 3) & ~missing, ((day > 3) & ~missing), missing]

    def step(stream: DataFrame) -> None:
        run_rules(stream, store, out, state, interval="1 hour", trigger={"availableNow": True}, rate_window=WINDOW, lookback=WINDOW,
                  keep=True).awaitTermination()

    _in_parts(spark, V.samples(spark, sf_dir), parts, step)
    return _flat(read_recorded(spark, out), "metric")


@query
def export_queries(spark, sf_dir):
    e = rules.Evaluation(_all_samples(spark, sf_dir), GRID, WINDOW, WINDOW, keep=True)
    return _flat(rules.evaluate(e, rules.EXPORT_QUERIES), "query")


@query
def dashboard_panels(spark, sf_dir):
    e = rules.Evaluation(_all_samples(spark, sf_dir), GRID, WINDOW, WINDOW, keep=True)
    return _flat(rules.evaluate(e, rules.PANELS), "query")


@query
def failure_rate_panel(spark, sf_dir):
    e = rules.Evaluation(_counter_samples(spark, sf_dir, "5 minutes"), FINE)
    return _flat(rules.PANELS["estimated_failure_rate"](e))


@query
def series_export(spark, sf_dir):
    """The month as a run: every selected query and every metric, exported and read back from its CSV files and JSON documents."""
    folder = export.export_run(
        _all_samples(spark, sf_dir), "baseline", GRID.start, GRID.end, GRID.step, scratch_path(spark, "export"), all_metrics=True,
        rows=20_000, points=500, rate_window=WINDOW, lookback=WINDOW)
    name = F.col("labels")["__name__"]
    labels = F.map_filter(F.col("labels"), lambda k, _: k != "__name__")
    parts = []
    for part in ("selected", "all_metrics"):
        documents = read_matrix(spark, f"{folder}/{part}/json", lines=True)
        table = export.read_csv(spark, f"{folder}/{part}/csv").select(F.coalesce(name, F.lit("")).alias("metric"), labels.alias("labels"), "ts", "value")
        for form, rows in (("json", documents), ("csv", table)):
            parts.append(rows.select(F.lit(part).alias("part"), F.lit(form).alias("form"), "metric", C.labels_key(F.col("labels")).alias("labels"), "ts", _rounded().alias("value")))
    return reduce(DataFrame.unionByName, parts)


@query
def export_files(spark, sf_dir):
    """What stands beside the series: the run's metadata, its expressions and the metrics' names."""
    folder = export.export_run(
        V.samples(spark, sf_dir), "baseline", "2024-01-05", "2024-01-08", "1 hour", scratch_path(spark, "export"), all_metrics=True,
        rate_window=WINDOW, lookback=WINDOW)
    meta = spark.read.json(f"{folder}/metadata").select(F.explode(F.array(*(
        F.struct(F.lit("metadata").alias("file"), F.concat_ws("=", F.lit(c), F.col(c).cast("string")).alias("line"))
        for c in ("run_label", "start_ts", "end_ts", "step_seconds", "export_all_metrics")))).alias("x")).select("x.*")
    lines = spark.read.text(f"{folder}/selected/promql").select(F.lit("promql").alias("file"), F.col("value").alias("line"))
    names = spark.read.json(f"{folder}/all_metrics/metric_names").select(F.lit("metric_names").alias("file"), F.col("metric").alias("line"))
    return meta.unionByName(lines).unionByName(names)


@query
def export_csv_rows(spark, sf_dir):
    e = _evaluation(spark, sf_dir, keep=True)
    return export.series_rows(rules.evaluate(e, rules.RULES)).withColumn("value", _rounded())


# --- runs ---------------------------------------------------------------------------------------------------

@query
def measured_window(spark, sf_dir):
    at = [F.lit(t).cast("timestamp") for t in ("2024-01-10 06:00:00", "2024-01-12 18:30:00")]
    return _counted(runs.measured_window(V.samples(spark, sf_dir), *at))


def _phases(spark, sf_dir) -> DataFrame:
    """One run per day that has events: 2 h idle, 3 h warm-up, 15 h measured."""
    days = V.events(spark, sf_dir).select(F.date_trunc("day", "ts").alias("start_ts")).distinct()
    return runs.phase_table(
        days.select(F.date_format("start_ts", "yyyy-MM-dd").alias("run_label"), "start_ts"), "2 hours", "3 hours", "15 hours")


@query
def phase_tagging(spark, sf_dir):
    tagged = runs.tag_phases(V.samples(spark, sf_dir), _phases(spark, sf_dir), bucket_seconds=3600)
    return tagged.groupBy("run_label", "phase", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def phase_tagging_bucketed(spark, sf_dir):
    """The same without the broadcast, as for a phase table too large for one."""
    tagged = runs.tag_phases(V.samples(spark, sf_dir), _phases(spark, sf_dir), bucket_seconds=3600, broadcast_rows=0)
    return tagged.groupBy("run_label", "phase", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _run_means(spark, sf_dir) -> DataFrame:
    label = F.concat(F.lit("run-"), (F.dayofmonth("ts") % 3).cast("string"))
    return runs.run_means(V.samples(spark, sf_dir).withColumn("run_label", label))


@query
def idle_subtraction(spark, sf_dir):
    out = runs.subtract_idle(_run_means(spark, sf_dir), "run-0")
    return out.select("run_label", "metric", "n", *[F.round(c, 4).alias(c) for c in ("mean", "idle_mean", "marginal")])


@query
def run_comparison(spark, sf_dir):
    out = runs.compare_runs(_run_means(spark, sf_dir), "run-0", ["run-1", "run-2"])
    return out.select("metric", *[
        F.round(f"`{c}`", 4).alias(c.replace("-", "_")) for c in out.columns if c != "metric"
    ])
