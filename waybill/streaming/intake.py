"""Streams that split what they read: parsed rows, rows set aside, matched and unmatched reads; and counts of all of them.

Counts are taken where the rows pass, by ``observe``; a ``Totals`` listener gathers them from the progress of every micro-batch.
"""

from __future__ import annotations

import threading
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from waybill.functions.columns import audit_struct
from waybill.schemas import BATCH_READ, COMMITTED, ESTIMATED_FAILED, LATE_COMMIT, OFFSET_COMMITTED, REPLAY_OBSERVED
from waybill.session import run_of
from waybill.streaming.sinks import EVERY_FIVE_SECONDS


class Totals(StreamingQueryListener):
    """Sums of the counts that streams observe under ``name``.

    A batch that is reported again, after a restart from its checkpoint, replaces what it reported before. Add it to ``spark.streams``
    before a stream starts; ``wait`` returns when the stream's last batch has been counted.
    """

    def __init__(self, name: str):
        self.name = name
        self._lock = threading.Lock()
        self._batches: dict[tuple[str, int], dict[str, int]] = {}
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        row = (progress.observedMetrics or {}).get(self.name)
        if row is not None:
            with self._lock:
                self._batches[str(progress.id), progress.batchId] = {k: v or 0 for k, v in row.asDict().items()}

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def wait(self, query: StreamingQuery, timeout: float = 60.0) -> None:
        query.awaitTermination()
        if not self._ended[str(query.runId)].wait(timeout):
            raise TimeoutError("the stream ended, but its last progress was not reported")

    @property
    def totals(self) -> dict[str, int]:
        with self._lock:
            out: dict[str, int] = defaultdict(int)
            for batch in self._batches.values():
                for k, v in batch.items():
                    out[k] += v
        return dict(out)


def run_intake(
    raw: DataFrame, good: str, quarantine: str, checkpoint: str, parsed: Callable[[Column], Column] = audit_struct, col: str = "value",
    name: str = "intake", trigger: dict | None = None,
) -> StreamingQuery:
    """Write rows that parse to ``good``, and rows that do not, as they came, to ``quarantine``.

    Each micro-batch is parsed once and counted under ``name``: ``read``, ``good`` and ``quarantined``. A batch that is repeated
    replaces its own folders (by run and batch) in both places; a malformed row never stops the stream.
    """
    run = run_of(raw.sparkSession, checkpoint)
    whole = F.struct(*raw.columns).alias("_raw")
    rows = raw.select(whole, parsed(F.col(col)).alias("_parsed"))
    bad = F.isnull("_parsed").cast("bigint")
    rows = rows.observe(name, F.count(F.lit(1)).alias("read"), F.sum(1 - bad).alias("good"), F.sum(bad).alias("quarantined"))

    def write(batch: DataFrame, batch_id: int) -> None:
        # One evaluation for both outputs, which also keeps the counts single.
        batch.persist()
        try:
            place = f"run={run}/batch_id={batch_id}"
            batch.where(F.col("_parsed").isNotNull()).select("_parsed.*").write.mode("overwrite").parquet(f"{good}/{place}")
            batch.where(F.isnull("_parsed")).select("_raw.*").write.mode("overwrite").parquet(f"{quarantine}/{place}")
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or EVERY_FIVE_SECONDS)).start()


def observed_outcomes(outcomes: DataFrame, name: str = "lifecycle") -> DataFrame:
    """The outcomes, counted by kind under ``name``: replays, estimatedFailed, lateCommits and committed."""
    kinds = {"replays": REPLAY_OBSERVED, "estimatedFailed": ESTIMATED_FAILED, "lateCommits": LATE_COMMIT, "committed": COMMITTED}
    return outcomes.observe(name, *(F.sum((F.col("outcome") == kind).cast("bigint")).alias(n) for n, kind in kinds.items()))


def pair_stream(audit: DataFrame, within: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """``eventId, read_at, commit_at`` for every read with each commit at most ``within`` after it; ``commit_at`` is null for a read without.

    A stream-stream outer join: a read and its commits meet while both are in the state, and an unmatched read comes out when the
    watermark shows that no commit can follow. State holds ``within`` + ``late`` of the log. Rows more than ``late`` behind the latest
    are dropped by Spark and counted in the query's progress (``numRowsDroppedByWatermark``); use ``lifecycle_stream`` where none may be.
    """
    def side(stage: str, id_name: str, at: str) -> DataFrame:
        return audit.where(F.col("stage") == stage).select(F.col("eventId").alias(id_name), F.col("timestamp").alias(at)).withWatermark(at, late)

    reads, commits = side(BATCH_READ, "eventId", "read_at"), side(OFFSET_COMMITTED, "_of", "commit_at")
    follows = (F.col("eventId") == F.col("_of")) & (F.col("commit_at") >= F.col("read_at")) & (
        F.col("commit_at") <= F.col("read_at") + F.expr(f"INTERVAL {within}"))
    return reads.join(commits, follows, "leftOuter").select("eventId", "read_at", "commit_at")


def pairs_of(joined: DataFrame) -> DataFrame:
    """One row per event id of the joined stream's output, in the form of ``read_commit_pairs``; without commits these are null or 0."""
    return joined.groupBy("eventId").agg(
        F.count_distinct("read_at").alias("reads"), F.count_distinct("commit_at").alias("commits"),
        F.min("read_at").alias("first_read"), F.max("read_at").alias("last_read"),
        F.min("commit_at").alias("first_commit"), F.max("commit_at").alias("last_commit"))
