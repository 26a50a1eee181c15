"""The model's inputs built from an ``events`` table (event_id, ts, user_id, event_type, value, props).

Every view is a row-by-row mapping of events except ``batch_audit``, which groups records into
batches. Offsets are event ids: unique, rising inside a partition and, as on a compacted or
transactional topic, not dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.functions.columns import sink_event_id
from waybill.operators.batches import batch_reads
from waybill.plans.rules import BEAN_METRICS, BROKER_CONTAINERS, SERVICE_LABEL
from waybill.schemas import BATCH_READ, OFFSET_COMMITTED, RANGES

PARTITIONS = 12
BATCH_SIZE = 50
GROUP = "perf-group"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``ts`` as an instant (the files hold zoneless UTC times)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def records_of(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.concat(F.lit("key-"), F.col("event_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        F.lit("events").alias("topic"),
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").alias("timestamp"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records_of(events(spark, sf_dir))


def batched(recs: DataFrame) -> DataFrame:
    return recs.withColumn("batch_no", F.expr(f"offset div {BATCH_SIZE}"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_reads(batched(records(spark, sf_dir)), ["batch_no"], GROUP)


def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and commits of batches: some are read again after 1 h, committed after 2 h or 8 h, or never."""
    n, at = F.col("batch_no"), F.col("timestamp")

    def event(stage: str, hours: int, test) -> Column:
        reads = stage == BATCH_READ
        return F.when(test, F.struct(
            F.lit(stage).alias("stage"),
            (at + F.expr(f"INTERVAL '{hours}' HOUR")).alias("timestamp"),
            (F.col("recordCount") if reads else F.lit(0)).alias("recordCount"),
            (F.col("partitionRanges") if reads else F.array().cast(RANGES)).alias("partitionRanges"),
        ))

    plan = F.array(
        event(BATCH_READ, 0, F.lit(True)),
        event(BATCH_READ, 1, n % 5 == 2),
        event(OFFSET_COMMITTED, 2, (n % 7 != 3) & (n % 11 != 4)),
        event(OFFSET_COMMITTED, 8, (n % 7 != 3) & (n % 11 == 4)),
    )
    return batches(spark, sf_dir).select(
        "batch_no", "eventId", "consumerGroup", "sourceTopic", F.explode(F.array_compact(plan)).alias("e")
    ).select("batch_no", "eventId", "e.stage", "consumerGroup", "sourceTopic", "e.timestamp", "e.recordCount", "e.partitionRanges")


def audit_log_of(ev: DataFrame) -> DataFrame:
    """Users as event ids: clicks and views read, purchases commit. ``seq`` orders equal times."""
    read = F.col("event_type").isin("click", "view")
    count = (F.col("event_id") % 50 + 1).cast("int")
    one = F.array(F.struct(
        (F.col("user_id") % PARTITIONS).cast("int").alias("partition"),
        F.col("event_id").alias("offsetMin"),
        (F.col("event_id") + count - 1).alias("offsetMax"),
        count.alias("recordCount"),
    ))
    return ev.where(F.col("event_type").isin("click", "view", "purchase")).select(
        F.col("user_id").cast("string").alias("eventId"),
        F.when(read, BATCH_READ).otherwise(OFFSET_COMMITTED).alias("stage"),
        F.concat(F.lit("group-"), (F.col("user_id") % 3).cast("string")).alias("consumerGroup"),
        F.lit("events").alias("sourceTopic"),
        F.col("ts").alias("timestamp"),
        F.when(read, count).otherwise(0).alias("recordCount"),
        F.when(read, one).otherwise(F.array()).cast(RANGES).alias("partitionRanges"),
        F.col("event_id").alias("seq"),
    )


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log_of(events(spark, sf_dir))


def sink_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sink that lost every 97th record and holds every 101st twice."""
    copies = F.when(F.col("offset") % 97 == 0, 0).when(F.col("offset") % 101 == 0, 2).otherwise(1)
    return (
        records(spark, sf_dir)
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
        .select(
            sink_event_id(True).alias("event_id"),
            F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"),
            F.col("offset").alias("kafka_offset"), F.col("value").alias("payload"), F.col("timestamp").alias("created_at"),
        )
    )


def samples_of(ev: DataFrame) -> DataFrame:
    """One counter and one gauge sample per event. Counters climb with the event id and restart every 4001."""
    broker = (F.col("user_id") % 3 + 1).cast("string")
    name = F.concat(F.lit("kafka-"), broker)
    kind = F.col("event_type")
    text = "map<string,string>"

    def labels(**pairs) -> Column:
        return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).cast(text)

    by_broker = labels(instance=name, broker_id=broker)
    paths = F.create_map(*[F.lit(x) for item in BROKER_CONTAINERS.items() for x in item])
    form = F.col("user_id") % 5
    container = (
        F.when(form == 0, labels(id=paths[name]))
        .when(form == 1, labels(**{"id": F.lit("/docker/other"), SERVICE_LABEL: name}))
        .when(form == 2, labels(id=F.lit("/docker/other"), name=name))
        .when(form == 3, labels(**{"id": paths[name], SERVICE_LABEL: name, "name": name}))
        .otherwise(labels(id=F.lit("/docker/other"), name=F.lit("postgres")))
    )
    even = F.col("user_id") % 2 == 0
    climbing = (F.col("event_id") % 4001).cast("double")

    def sample(metric, labels_, value, kind_) -> Column:
        metric = F.lit(metric) if isinstance(metric, str) else metric
        return F.struct(metric.alias("metric"), labels_.alias("labels"), value.alias("value"), F.lit(kind_).alias("kind"))

    counter = (
        F.when(kind == "click", sample("kafka_broker_bytes_in_total", by_broker, climbing * 512, "counter"))
        .when(kind == "view", sample("kafka_broker_bytes_out_total", by_broker, climbing * 512, "counter"))
        .when(kind == "purchase", sample("kafka_broker_messages_in_total", by_broker, climbing, "counter"))
        .when(kind == "error", sample("container_cpu_usage_seconds_total", container, climbing, "counter"))
        .when(kind == "signup", sample(
            "node_cpu_seconds_total",
            labels(cpu=(F.col("user_id") % 4).cast("string"), mode=F.when(even, "idle").otherwise("user")), climbing, "counter"))
    )
    value = F.col("value")
    gauge = (
        F.when(kind == "click", sample(
            "kafka_consumergroup_lag", labels(partition=(F.col("user_id") % PARTITIONS).cast("string")), value, "gauge"))
        .when(kind == "view", sample(
            F.when(even, "jvm_heap_used_bytes").otherwise("jvm_non_heap_used_bytes"), labels(instance=name), value * 1048576, "gauge"))
        .when(kind == "purchase", sample("jvm_process_cpu_load_ratio", labels(instance=name), value / 1024, "gauge"))
        .when(kind == "error", sample("container_memory_usage_bytes", container, value * 1048576, "gauge"))
        .when(kind == "signup", sample(
            F.when(even, "node_memory_MemAvailable_bytes").otherwise("node_memory_MemTotal_bytes"),
            labels(instance=F.lit("host")), F.when(even, value).otherwise(value + 1000), "gauge"))
    )
    return ev.select("ts", F.explode(F.array(counter, gauge)).alias("s")).select(
        "s.metric", "s.labels", "ts", "s.value", "s.kind"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(events(spark, sf_dir))


def bean_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bean attributes, one per event, with a fifteenth name that no rule keeps."""
    names = F.array(*[F.lit(n) for n, _, _ in BEAN_METRICS], F.lit("java.lang<type=Runtime><>Uptime"))
    return events(spark, sf_dir).select(
        F.element_at(names, (F.col("event_id") % (len(BEAN_METRICS) + 1) + 1).cast("int")).alias("source_name"),
        F.create_map(F.lit("instance"), F.concat(F.lit("kafka-"), (F.col("user_id") % 3 + 1).cast("string"))).alias("labels"),
        "ts", "value",
    )
