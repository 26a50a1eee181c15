"""Schemas of the records, audit events, outcomes, sink rows and metric samples."""

from __future__ import annotations

from pyspark.sql import types as T

RANGE = T.StructType([
    T.StructField("partition", T.IntegerType()),
    T.StructField("offsetMin", T.LongType()),
    T.StructField("offsetMax", T.LongType()),
    T.StructField("recordCount", T.IntegerType()),
])
RANGES = T.ArrayType(RANGE)

RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

AUDIT = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("consumerGroup", T.StringType()),
    T.StructField("sourceTopic", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("recordCount", T.IntegerType()),
    T.StructField("partitionRanges", RANGES),
])

OUTCOME = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("consumerGroup", T.StringType()),
    T.StructField("sourceTopic", T.StringType()),
    T.StructField("firstSeenAt", T.TimestampType()),
    T.StructField("lastSeenAt", T.TimestampType()),
    T.StructField("observedAt", T.TimestampType()),
    T.StructField("recordCount", T.IntegerType()),
    T.StructField("replayCount", T.IntegerType()),
    T.StructField("timeoutCount", T.IntegerType()),
    T.StructField("partitionRanges", RANGES),
])

# One entry per eventId that has been read and not yet committed.
PENDING = T.StructType([
    T.StructField("consumerGroup", T.StringType()),
    T.StructField("sourceTopic", T.StringType()),
    T.StructField("firstSeenAt", T.TimestampType()),
    T.StructField("lastSeenAt", T.TimestampType()),
    T.StructField("timedOutAt", T.TimestampType()),
    T.StructField("recordCount", T.IntegerType()),
    T.StructField("replayCount", T.IntegerType()),
    T.StructField("timeoutCount", T.IntegerType()),
    T.StructField("partitionRanges", RANGES),
])

SINK_ROW = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("kafka_topic", T.StringType()),
    T.StructField("kafka_partition", T.IntegerType()),
    T.StructField("kafka_offset", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
SINK_KEY = ("kafka_topic", "kafka_partition", "kafka_offset")

SAMPLE = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("kind", T.StringType()),
])

PHASE = T.StructType([
    T.StructField("run_label", T.StringType()),
    T.StructField("phase", T.StringType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
])

BATCH_READ = "BATCH_READ"
OFFSET_COMMITTED = "OFFSET_COMMITTED"
STAGES = (BATCH_READ, OFFSET_COMMITTED)

COMMITTED = "COMMITTED"
REPLAY_OBSERVED = "REPLAY_OBSERVED"
ESTIMATED_FAILED = "ESTIMATED_FAILED"
LATE_COMMIT = "LATE_COMMIT"
OUTCOMES = (COMMITTED, REPLAY_OBSERVED, ESTIMATED_FAILED, LATE_COMMIT)
