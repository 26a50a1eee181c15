"""Append and idempotent upsert sinks over files or a database table."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waybill.functions.columns import sink_event_id
from waybill.operators.reconcile import sink_duplicates
from waybill.schemas import SINK_KEY, SINK_ROW
from waybill.session import broadcast_if_small, newest_version, numbered, remove, written
from waybill.sources.records import check_sink, only_topic


@dataclass(frozen=True)
class SinkSpec:
    """Where rows go: a file format with ``path``, or ``jdbc`` with ``url`` and ``table``.

    ``mode`` is ``append`` (every delivery is kept) or ``upsert`` (one row per key).
    ``connections`` bounds the tasks that write to a database at the same time. ``run`` tells
    the life of one checkpoint from another: a stream that starts on a new checkpoint counts its batches from 0
    again, so (run, batch id) identifies a batch and orders it.
    """

    format: str = "parquet"
    path: str | None = None
    url: str | None = None
    table: str = "sink_events"
    mode: str = "append"
    batch_size: int = 200
    connections: int = 10
    options: dict[str, str] = field(default_factory=dict)
    run: int = 0


def to_sink_rows(
    records: DataFrame, topic: str | None = None, deterministic_id: bool = False, created_at: Column | None = None
) -> DataFrame:
    """Records as sink rows. A deterministic id is the same again when the write is retried."""
    chosen = only_topic(records, topic) if topic else records
    return chosen.select(
        sink_event_id(deterministic_id).alias("event_id"),
        F.col("topic").alias("kafka_topic"),
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("value").alias("payload"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``.

    An aggregation, not a window: copies of a key are combined before the shuffle, so a key written
    very often sends one row per task.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*keys).agg(last.alias("_last")).select(
        *[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns]
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = SINK_KEY, order: Sequence[str] = ("created_at", "event_id")) -> DataFrame:
    """Table content after ``incoming`` replaced the rows with equal keys and added the others."""
    old = existing.withColumn("_generation", F.lit(0))
    new = incoming.withColumn("_generation", F.lit(1))
    return latest(old.unionByName(new), keys, ["_generation", *order]).drop("_generation")


def write_sink(rows: DataFrame, target: SinkSpec, batch_id: int | None = None) -> None:
    """Write in the target's mode."""
    (upsert_sink if target.mode == "upsert" else append_sink)(rows, target, batch_id)


def append_sink(rows: DataFrame, target: SinkSpec, batch_id: int | None = None) -> None:
    """Add rows. With a batch id the files, or the rows, of an earlier try of that batch are replaced."""
    if target.format == "jdbc" and batch_id is not None:
        _through_stage(rows, target, batch_id, lambda stage: append_statements(target.table, stage, target.run, batch_id))
    elif target.format == "jdbc":
        _jdbc(rows, target, target.table).mode("append").save()
    elif batch_id is None:
        rows.write.format(target.format).options(**target.options).mode("append").save(target.path)
    else:
        _write_batch(rows, target, batch_id)


def upsert_sink(
    rows: DataFrame, target: SinkSpec, batch_id: int | None = None, keys: Sequence[str] = SINK_KEY,
    order: Sequence[str] = ("created_at", "event_id"),
) -> None:
    """Make the rows the current ones of their keys.

    Files: the batch, reduced to the last row per key, becomes one more generation next to the earlier
    ones, so a write costs the size of the batch and not of the table; ``read_upserted`` picks the
    newest generation per key and ``compact_sink`` folds generations into a base. A repeated batch
    replaces its own files. Database: rows go to a staging table, then one statement merges them.
    """
    once = latest(rows, keys, order)
    if target.format == "jdbc":
        _through_stage(once, target, batch_id, lambda stage: [merge_statement(target.table, stage, keys)])
        return
    if batch_id is None:
        raise ValueError("a file upsert needs a batch id to order its generations")
    _write_batch(once, target, batch_id)


def _write_batch(rows: DataFrame, target: SinkSpec, batch_id: int) -> None:
    place = f"{target.path}/generations/run={target.run}/batch_id={batch_id}"
    rows.write.format(target.format).options(**target.options).mode("overwrite").save(place)


_PLACE = ["run", "batch_id"]


def _load(spark: SparkSession, target: SinkSpec, place: str) -> DataFrame:
    schema = SINK_ROW.simpleString()[len("struct<"):-1].replace(":", " ") + ", run bigint, batch_id bigint"
    if not written(spark, place):
        return spark.createDataFrame([], schema)
    return spark.read.format(target.format).options(**target.options).schema(schema).load(place)


def _rows(spark: SparkSession, target: SinkSpec) -> tuple[DataFrame, DataFrame, dict[int, int], int]:
    """The base, the generations that are not in it, up to which batch each run is in it, and its version."""
    version = newest_version(spark, f"{target.path}/manifest")
    live = _load(spark, target, f"{target.path}/generations")
    if version is None:
        return live.limit(0), live, {}, -1
    # One row for each run, that is for each checkpoint the sink has ever had.
    folded = dict(spark.read.schema("run long, upto long").parquet(f"{target.path}/manifest/version={version}").collect())
    for run, upto in folded.items():
        live = live.where((F.col("run") != run) | (F.col("batch_id") > upto))
    return _load(spark, target, f"{target.path}/base/version={version}"), live, folded, version


def read_appended(spark: SparkSession, target: SinkSpec) -> DataFrame:
    """All rows of an append sink that was written with batch ids."""
    base, live, _, _ = _rows(spark, target)
    return base.unionByName(live).drop(*_PLACE)


def read_upserted(spark: SparkSession, target: SinkSpec, keys: Sequence[str] = SINK_KEY) -> DataFrame:
    """Current rows of a file upsert sink: the newest generation of each key."""
    base, live, _, _ = _rows(spark, target)
    return latest(base.unionByName(live), keys, _PLACE).drop(*_PLACE)


def compact_sink(spark: SparkSession, target: SinkSpec, keys: Sequence[str] = SINK_KEY) -> None:
    """Fold the generations into a new base next to them.

    The manifest that names the base also names the last folded batch of each run. Readers take the base and the generations
    behind it, so a batch that is folded already and then repeated changes nothing, and a stream may write on while this runs. The
    newest batch of a run is left out, because its write may not have returned. A manifest is written after its
    base: until then readers stay with what they had.
    """
    base, live, folded, version = _rows(spark, target)
    ends = {r["run"]: r["upto"] for r in live.groupBy("run").agg((F.max("batch_id") - 1).alias("upto")).collect()}
    chosen = F.lit(False)
    for run, upto in ends.items():
        chosen = chosen | ((F.col("run") == run) & (F.col("batch_id") <= upto))
    rows = base.unionByName(live.where(chosen))
    rows = latest(rows, keys, _PLACE) if target.mode == "upsert" else rows
    rows.write.format(target.format).options(**target.options).mode("overwrite").save(f"{target.path}/base/version={version + 1}")
    now = list((folded | ends).items())
    spark.createDataFrame(now, "run long, upto long").coalesce(1).write.mode("overwrite").parquet(f"{target.path}/manifest/version={version + 1}")


def vacuum_sink(spark: SparkSession, target: SinkSpec, keep: int = 1) -> int:
    """Remove what only readers older than the last ``keep`` compactions can need; returns how many folders went.

    These are the generations that the manifest before those had folded already, and the bases and manifests before
    it. A reader that began before the newest compaction therefore still finds all its files.
    """
    versions = numbered(spark, f"{target.path}/manifest")
    if len(versions) <= keep:
        return 0
    oldest = versions[-1 - keep]
    # One row for each run, as in every read.
    folded = dict(spark.read.schema("run long, upto long").parquet(f"{target.path}/manifest/version={oldest}").collect())
    gone = [f"generations/run={run}/batch_id={b}" for run, upto in folded.items()
            for b in numbered(spark, f"{target.path}/generations/run={run}", "batch_id") if b <= upto]
    gone += [f"base/version={v}" for v in numbered(spark, f"{target.path}/base") if v < oldest]
    for place in gone:
        remove(spark, f"{target.path}/{place}")
        remove(spark, f"{target.path}/index/{place}")
    for v in versions:
        if v < oldest:
            remove(spark, f"{target.path}/manifest/version={v}")
    return len(gone)


# --- lookups ------------------------------------------------------------------------------------------

#: A file's Bloom filter is cut into bitmaps of 32768 bits, one for about _KEYS keys; a key sets _PROBES bits of one
#: bitmap. A file without the key is taken for one that has it in about 1 of 400 cases.
_BITS = 32_768
_KEYS = 2_048
_PROBES = 4
_FILE = r"(base/version=\d+/[^/]+|generations/run=\d+/batch_id=\d+/[^/]+)$"


def _file_names(rows: DataFrame) -> dict[str, str]:
    """Files of a scan by their name within the sink. Every scan holds this list on the driver."""
    return {re.search(_FILE, f)[1]: f for f in rows.inputFiles()}


def _probes(hashed: Column) -> Column:
    mixed = F.xxhash64(hashed, F.lit(1))
    return F.array(*[F.shiftrightunsigned(mixed, 15 * i).bitwiseAND(_BITS - 1) for i in range(_PROBES)])


def _has_bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)) % 2 == 1


def _filters(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per file: its smallest and largest key and the bitmaps of its Bloom filter, from the key columns alone."""
    narrow = rows.select(F.regexp_extract("_metadata.file_path", _FILE, 1).alias("file"), F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("hashed"))
    sizes = narrow.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    # Powers of two, so that a lookup needs the place of a key for few sizes only.
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / _KEYS)).cast("int"))
    sizes = sizes.select("file", "low", "high", F.pow(F.lit(2), power).cast("bigint").alias("bitmaps"))
    placed = narrow.drop("key").join(sizes.select("file", "bitmaps"), "file").select(
        "file", F.pmod("hashed", "bitmaps").alias("bitmap"), F.explode(_probes(F.col("hashed"))).alias("position"))
    return placed.groupBy("file", "bitmap").agg(F.bitmap_construct_agg("position").alias("bits")).join(sizes, "file")


def index_sink(spark: SparkSession, target: SinkSpec, keys: Sequence[str] = SINK_KEY) -> None:
    """Index the files that are not indexed yet, for ``lookup_upserted``.

    Writes do not wait for it: a file without an entry is opened by every lookup, and an entry
    without its file (a batch was repeated) is not read. Run it after compaction or every few batches.
    """
    base, live, _, version = _rows(spark, target)
    known = _known(spark, target, version)
    fresh = [f for name, f in _file_names(base).items() if name not in known]
    if fresh:
        rows = spark.read.format(target.format).options(**target.options).schema(base.schema).load(fresh)
        _filters(rows, keys).write.mode("overwrite").parquet(f"{target.path}/index/base/version={version}")
    fresh = [f for name, f in _file_names(live).items() if name not in known]
    if fresh:
        rows = _generation_files(spark, target, live, fresh)
        place = [F.regexp_extract("file", rf"{c}=(\d+)/", 1).cast("bigint").alias(c) for c in _PLACE]
        _filters(rows, keys).select("*", *place).write.mode("append").partitionBy(*_PLACE).parquet(f"{target.path}/index/generations")


def _generation_files(spark: SparkSession, target: SinkSpec, live: DataFrame, files: list[str]) -> DataFrame:
    reader = spark.read.format(target.format).options(**target.options).schema(live.schema)
    return reader.option("basePath", f"{target.path}/generations").load(files)


def _index(spark: SparkSession, target: SinkSpec, version: int) -> DataFrame | None:
    places = [p for p in (f"{target.path}/index/base/version={version}", f"{target.path}/index/generations") if written(spark, p)]
    parts = [spark.read.parquet(p).select("file", "bitmaps", "bitmap", "bits", "low", "high") for p in places]
    return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _known(spark: SparkSession, target: SinkSpec, version: int) -> set[str]:
    """Names of the indexed files: at most as many as the sink has."""
    index = _index(spark, target, version)
    return set() if index is None else {r["file"] for r in index.select("file").distinct().collect()}


def files_with(spark: SparkSession, target: SinkSpec, wanted: DataFrame, keys: Sequence[str] = SINK_KEY) -> tuple[list[str], int]:
    """Names of the sink's files that can hold one of the wanted keys, and the number of all files that count."""
    base, live, _, version = _rows(spark, target)
    names = [*_file_names(base), *_file_names(live)]
    index = _index(spark, target, version)
    if index is None:
        return names, len(names)
    known = _known(spark, target, version)
    # At most 40 sizes, whatever the sink.
    sizes = [r["bitmaps"] for r in index.select("bitmaps").distinct().collect()]
    asked = wanted.select(F.struct(*keys).alias("key"), F.xxhash64(*keys).alias("hashed")).distinct()
    asked = asked.withColumn("bitmaps", F.explode(F.array(*[F.lit(n).cast("bigint") for n in sizes]))).select(
        "key", "bitmaps", F.pmod("hashed", "bitmaps").alias("bitmap"), _probes(F.col("hashed")).alias("probes"))
    found = asked.join(index, ["bitmaps", "bitmap"]).where(
        (F.col("key") >= F.col("low")) & (F.col("key") <= F.col("high")) & F.forall("probes", lambda p: _has_bit(F.col("bits"), p)))
    hits = {r["file"] for r in found.select("file").distinct().collect()}
    return [n for n in names if n in hits or n not in known], len(names)


def lookup_upserted(spark: SparkSession, target: SinkSpec, wanted: DataFrame, keys: Sequence[str] = SINK_KEY) -> DataFrame:
    """Current rows of the wanted keys: those that a merge of ``wanted`` would replace. Null keys are keys like others.

    Opens only the files that can hold one of them, by key range and Bloom filter; payloads of other keys are
    neither shuffled nor, where their file is not opened, read.
    """
    base, live, _, _ = _rows(spark, target)
    chosen = set(files_with(spark, target, wanted, keys)[0])
    old = [f for name, f in _file_names(base).items() if name in chosen]
    new = [f for name, f in _file_names(live).items() if name in chosen]
    base = spark.read.format(target.format).options(**target.options).schema(base.schema).load(old) if old else base.limit(0)
    live = _generation_files(spark, target, live, new) if new else live.limit(0)
    asked = broadcast_if_small(wanted.select(*[F.col(k).alias(f"_wanted_{k}") for k in keys]).distinct())
    same = [F.col(k).eqNullSafe(F.col(f"_wanted_{k}")) for k in keys]
    return latest(base.unionByName(live).join(asked, same, "left_semi"), keys, _PLACE).drop(*_PLACE)


def ensure_sink_table(spark: SparkSession, table: str, location: str | None = None, unique: bool = True) -> DataFrame:
    """Create the sink table when absent and verify its columns and, if asked, its key.

    Returns the keys held more than once; without ``unique`` an empty table of the same shape.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SINK_ROW.fields)
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{place}")
    found = sink_duplicates(check_sink(spark.table(table)))
    return found if unique else found.limit(0)


# --- database statements --------------------------------------------------------------------------

# The columns of the sink table in the database.
_DATABASE_COLUMNS = {
    "id": "SERIAL PRIMARY KEY",
    "event_id": "VARCHAR(64)",
    "kafka_topic": "TEXT",
    "kafka_partition": "INT",
    "kafka_offset": "BIGINT",
    "payload": "TEXT",
    "created_at": "TIMESTAMP DEFAULT now()",
}


def sink_ddl(table: str, unique: bool = True) -> list[str]:
    """Statements that create the sink table and, if asked, its unique key."""
    columns = ", ".join(f"{name} {kind}" for name, kind in _DATABASE_COLUMNS.items())
    out = [f"CREATE TABLE IF NOT EXISTS {table} ({columns})"]
    if unique:
        out.append(f"CREATE UNIQUE INDEX IF NOT EXISTS {table}_place ON {table} ({', '.join(SINK_KEY)})")
    return out


def merge_statement(table: str, stage: str, keys: Sequence[str] = SINK_KEY) -> str:
    """One statement that upserts a staged batch: payload and event id of a known key are replaced."""
    columns = ", ".join(f.name for f in SINK_ROW.fields)
    changed = ", ".join(f"{c} = EXCLUDED.{c}" for c in ("payload", "event_id"))
    return (
        f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage} "
        f"ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {changed}"
    )


def _jdbc(rows: DataFrame, target: SinkSpec, table: str):
    return rows.write.format("jdbc").options(
        url=target.url, dbtable=table, batchsize=str(target.batch_size), numPartitions=str(target.connections), **target.options
    )


def append_statements(table: str, stage: str, run: int, batch_id: int) -> list[str]:
    """Statements that add a staged batch once: a batch that is in the list of batches adds nothing."""
    columns = ", ".join(f.name for f in SINK_ROW.fields)
    same = f"run = {run} AND batch_id = {batch_id}"
    return [
        f"CREATE TABLE IF NOT EXISTS {table}_batches (run BIGINT, batch_id BIGINT, PRIMARY KEY (run, batch_id))",
        f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage} WHERE NOT EXISTS (SELECT 1 FROM {table}_batches WHERE {same})",
        f"INSERT INTO {table}_batches SELECT {run}, {batch_id} WHERE NOT EXISTS (SELECT 1 FROM {table}_batches WHERE {same})",
    ]


def _through_stage(rows: DataFrame, target: SinkSpec, batch_id: int | None, statements) -> None:
    """Write the batch to a staging table and move it from there in one transaction.

    Not tried against a database here; only the statements are.
    """
    stage = f"{target.table}_stage" if batch_id is None else f"{target.table}_stage_{target.run}_{batch_id}"
    _jdbc(rows, target, stage).mode("overwrite").save()
    jvm = rows.sparkSession._jvm
    properties = jvm.java.util.Properties()
    for name, value in target.options.items():
        properties.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(target.url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in [*statements(stage), f"DROP TABLE {stage}"]:
            statement.executeUpdate(text)
        connection.commit()
    finally:
        connection.close()
