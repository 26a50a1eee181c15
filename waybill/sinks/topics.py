"""Publishing rows to a topic, or to files in the same form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

# Producer settings for audit events (fast, retried twice, never blocking the main flow).
AUDIT_PRODUCER = {
    "kafka.acks": "1", "kafka.retries": "2", "kafka.linger.ms": "20", "kafka.compression.type": "lz4",
}


@dataclass(frozen=True)
class TopicSpec:
    """A topic (``format="kafka"``), or a folder of files with ``key`` and ``value`` columns."""

    format: str = "kafka"
    topic: str | None = None
    servers: str | None = None
    path: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def writer_options(self) -> dict[str, str]:
        if self.format != "kafka":
            return dict(self.options)
        if not self.topic or not self.servers:
            raise ValueError("a topic sink needs topic and servers")
        return {"kafka.bootstrap.servers": self.servers, "topic": self.topic, **self.options}


def keyed(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value"))


def publish(df: DataFrame, target: TopicSpec, key: str, value: Column) -> None:
    """Write a batch. Delivery is at least once: a repeated task may repeat messages."""
    writer = keyed(df, key, value).write.format(target.format).options(**target.writer_options()).mode("append")
    writer.save() if target.format == "kafka" else writer.save(target.path)


def publish_stream(
    df: DataFrame, target: TopicSpec, key: str, value: Column, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Publish as a query of its own, so that its failure cannot stop another one.

    Files are written exactly once; a topic receives every message at least once.
    """
    writer = (
        keyed(df, key, value).writeStream.format(target.format).options(**target.writer_options())
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"}))
    )
    return writer.start() if target.format == "kafka" else writer.start(target.path)
