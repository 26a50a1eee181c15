"""Session helpers: shared scratch space, lineage cuts, durations and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_UNIT_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}

# A side with at most this many rows is small enough to broadcast. Callers that cannot prove
# the bound from their own parameters count up to one row past it and shuffle beyond it.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's setting, or a temporary one where all runs on this machine.

    On a cluster without the setting this raises: each executor would write to a disk of its own and
    readers would see a part of the data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="waybill-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/waybill-{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a table in the shared folder and go on from there.

    Later readers scan the table, with column pruning and pushed filters, in place of recomputing it,
    and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: With this on, the shuffle files of a query are deleted when it has ended, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A ``cut_lineage`` for steps on the way: its tables are deleted at the end of the block, shuffle files when their query has ended.

    What leaves the block has to be written by ``cut_lineage`` inside it.
    """
    paths, before = [], spark.conf.get(_CLEANUP, "false")

    def cut(df: DataFrame) -> DataFrame:
        paths.append(path := scratch_path(spark, "table"))
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    spark.conf.set(_CLEANUP, "true")
    try:
        yield cut
    finally:
        spark.conf.set(_CLEANUP, before)
        for path in paths:
            remove(spark, path)


def _folder(spark: SparkSession, path: str):
    """The file system that holds ``path``, as Spark is configured for it, and the path in it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``. Asks for that one name and lists nothing."""
    files, place = _folder(spark, path)
    return files.exists(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in ``path``, none where there is no such path."""
    files, place = _folder(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete the folder ``path`` and all in it; a missing one is fine."""
    files, place = _folder(spark, path)
    files.delete(place, True)


def numbered(spark: SparkSession, path: str, name: str = "version") -> list[int]:
    """All N, rising, for which ``path`` has a folder ``name=N``."""
    return sorted(int(f.removeprefix(f"{name}=")) for f in subfolders(spark, path) if re.fullmatch(rf"{name}=\d+", f))


def newest_version(spark: SparkSession, path: str, name: str = "version") -> int | None:
    """The largest N for which ``path`` holds a complete table ``name=N``."""
    for n in reversed(numbered(spark, path, name)):
        # Files get their final place when the whole write commits; what tasks are still writing is deeper.
        files, place = _folder(spark, f"{path}/{name}={n}/*.parquet")
        if files.globStatus(place):
            return n
    return None


def run_of(spark: SparkSession, checkpoint: str, earlier: list[int] | None = None) -> int:
    """The run a checkpoint stands for: when it was first used, in milliseconds; written beside its progress once.

    It is larger than all ``earlier`` runs, whatever the clock of this machine says.
    """
    place = f"{checkpoint}/waybill-run"
    if written(spark, place):
        found = spark.read.schema("run long").parquet(place).first()
        if found:
            return found[0]
    run = max([time.time_ns() // 1_000_000, *(r + 1 for r in earlier or [])])
    spark.createDataFrame([(run,)], "run long").coalesce(1).write.mode("overwrite").parquet(place)
    return run


def micros(duration: str | int) -> int:
    """Length of a duration in microseconds: ``"90 seconds"``, ``"5m"``, or a number of seconds."""
    if isinstance(duration, int):
        return duration * 1_000_000
    short = {"us": "microsecond", "ms": "millisecond", "s": "second", "m": "minute", "h": "hour", "d": "day"}
    total = 0
    parts = re.findall(r"(\d+)\s*([a-z]+)", duration.strip().lower())
    if not parts or re.sub(r"(\d+)\s*([a-z]+)\s*", "", duration.strip().lower()):
        raise ValueError(f"not a duration: {duration!r}")
    for number, unit in parts:
        unit = short.get(unit, unit.rstrip("s"))
        if unit not in _UNIT_US:
            raise ValueError(f"not a duration: {duration!r}")
        total += int(number) * _UNIT_US[unit]
    return total


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than one row past the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to shuffle."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df
