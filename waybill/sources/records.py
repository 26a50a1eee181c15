"""Sources: message topics (or files with the same schema), audit and outcome logs, sink tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.functions.columns import audit_struct, outcome_struct
from waybill.schemas import RECORD, SINK_ROW


@dataclass(frozen=True)
class SourceSpec:
    """Where records come from.

    ``format`` is ``kafka`` or a file format. For a topic the consumer settings become reader
    options; ``max_per_batch`` bounds a micro-batch (records for a topic, files for a folder).
    """

    format: str = "kafka"
    topic: str | None = None
    servers: str | None = None
    path: str | None = None
    starting: str = "earliest"
    isolation: str = "read_committed"
    max_per_batch: int | None = None
    min_partitions: int | None = None
    options: dict[str, str] = field(default_factory=dict)

    def reader_options(self, streaming: bool) -> dict[str, str]:
        if self.format != "kafka":
            bound = {"maxFilesPerTrigger": str(self.max_per_batch)} if streaming and self.max_per_batch else {}
            return bound | self.options
        if not self.topic or not self.servers:
            raise ValueError("a topic source needs topic and servers")
        out = {
            "kafka.bootstrap.servers": self.servers,
            "subscribe": self.topic,
            "startingOffsets": self.starting,
            "kafka.isolation.level": self.isolation,
        }
        if streaming and self.max_per_batch:
            out["maxOffsetsPerTrigger"] = str(self.max_per_batch)
        if self.min_partitions:
            out["minPartitions"] = str(self.min_partitions)
        return out | self.options


def read_records(spark: SparkSession, source: SourceSpec, streaming: bool = False) -> DataFrame:
    """Records with ``key, value, topic, partition, offset, timestamp``."""
    reader = (spark.readStream if streaming else spark.read).format(source.format)
    reader = reader.options(**source.reader_options(streaming))
    if source.format == "kafka":
        raw = reader.load()
        return raw.select(
            F.col("key").cast("string"), F.col("value").cast("string"), "topic", "partition", "offset", "timestamp"
        )
    records = reader.schema(RECORD).load(source.path)
    return only_topic(records, source.topic) if source.topic else records


def only_topic(records: DataFrame, topic: str) -> DataFrame:
    return records.where(F.col("topic") == topic)


def _split(df: DataFrame, col: str, parsed: Column, carry: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    # A row explodes into its parsed form or into nothing, so each text is parsed once; a filter on the
    # parsed column would be moved below the projection and parse it a second time.
    good = df.select(F.explode(F.array_compact(F.array(parsed))).alias("_parsed"), *carry).select("_parsed.*", *carry)
    return good, df.where(parsed.isNull())


def parse_audit(df: DataFrame, col: str = "value", carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Audit rows that meet the contract, and the source rows that do not (never an error).

    ``carry`` names source columns (an offset, say) to keep beside the parsed ones.
    """
    return _split(df, col, audit_struct(F.col(col)), carry)


def parse_outcomes(df: DataFrame, col: str = "value", carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Outcome rows, and the source rows that could not be read as outcomes."""
    return _split(df, col, outcome_struct(F.col(col)), carry)


def route(audit: DataFrame, stage: str) -> DataFrame:
    """Audit rows of one stage; rows without a stage go nowhere."""
    return audit.where(F.col("stage") == stage)


def read_sink(spark: SparkSession, format: str, path: str | None = None, **options: str) -> DataFrame:
    """Sink table with its columns checked against the sink schema."""
    reader = spark.read.format(format).options(**options)
    table = reader.load(path) if path else reader.load()
    return check_sink(table)


def check_sink(table: DataFrame) -> DataFrame:
    """Fail when a sink column is missing or has another type; extra columns are dropped."""
    have = {f.name.lower(): f.dataType for f in table.schema.fields}
    for want in SINK_ROW.fields:
        if want.name not in have:
            raise ValueError(f"sink table lacks column {want.name}")
        if have[want.name].simpleString().removesuffix("_ntz") != want.dataType.simpleString():
            raise ValueError(f"sink column {want.name} is {have[want.name].simpleString()}")
    return table.select(*[F.col(f.name) for f in SINK_ROW.fields])
