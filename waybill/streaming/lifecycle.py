"""The lifecycle as a stateful stream, one state entry per open event id.

No event is lost to the watermark. Spark would drop rows whose event time is behind it, so the time column it watches is filled on rows
of their own only (one per audit row, gone before the shuffle) and null on the events. Events ahead of the watermark wait in a
keyed list and are taken in time order once it has passed them; events behind it are taken when they arrive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waybill.schemas import (
    BATCH_READ, COMMITTED, ESTIMATED_FAILED, LATE_COMMIT, OFFSET_COMMITTED, OUTCOME, RANGES, REPLAY_OBSERVED,
)
from waybill.session import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Times are whole microseconds, ranges are JSON text that only passes through. ``timed_out`` is null
# while the entry is armed.
_STATE = (
    "grp string, topic string, first bigint, last bigint, timed_out bigint, records int, replays int, timeouts int, "
    "ranges string"
)
#: An event's columns.
_EVENT = ("us", "seq", "stage", "grp", "topic", "records", "ranges")
#: Events that wait for the watermark, as JSON: one element for those of a micro-batch, because each element is a message of its own
#: between the state store and Python.
_WAITING = "events string"
_OUT = (
    "eventId string, outcome string, consumerGroup string, sourceTopic string, first bigint, last bigint, observed bigint, "
    "recordCount int, replayCount int, timeoutCount int, ranges string"
)


_ENTRY = tuple(part.split(" ")[0] for part in _STATE.split(", "))


class LifecycleProcessor(StatefulProcessor):
    """Reads arm an entry, commits close it, and a tick past the threshold times it out.

    ``wait`` says whether events ahead of the watermark are held back until it has passed them.
    """

    def __init__(self, threshold_us: int, tick_us: int, ttl_us: int | None, event_time: bool, wait: bool):
        self.threshold_us, self.tick_us, self.ttl_us, self.event_time, self.wait = threshold_us, tick_us, ttl_us, event_time, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("pending", _STATE)
        self.timer = handle.getValueState("timer", "at bigint")
        self.early = handle.getListState("early", _WAITING)

    def _due(self, entry: dict) -> int | None:
        """When the entry's next timer is: its timeout, or its removal once timed out."""
        if entry["timed_out"] is not None:
            return None if self.ttl_us is None else entry["timed_out"] + self.ttl_us
        past = entry["last"] + self.threshold_us
        return past - past % self.tick_us + self.tick_us

    @staticmethod
    def _outcome(key: str, name: str, entry: dict, observed: int) -> Row:
        return Row(
            eventId=key, outcome=name, consumerGroup=entry["grp"], sourceTopic=entry["topic"], first=entry["first"],
            last=entry["last"], observed=observed, recordCount=entry["records"], replayCount=entry["replays"],
            timeoutCount=entry["timeouts"], ranges=entry["ranges"],
        )

    def _load(self) -> dict | None:
        found = self.entry.get()
        return None if found is None else dict(zip(_ENTRY, found))

    def _timer(self) -> int | None:
        found = self.timer.get()
        return None if found is None else found[0]

    def _expire(self, key: str, entry: dict, now: int) -> Iterator[Row]:
        """Time the entry out when its tick has passed; ``now`` is exclusive."""
        due = self._due(entry)
        if entry["timed_out"] is None and due < now:
            entry["timed_out"] = due
            entry["timeouts"] += 1
            yield self._outcome(key, ESTIMATED_FAILED, entry, due)

    def _take(self, key: str, entry: dict | None, events: list[dict]) -> Iterator[Row]:
        """Apply events, which are in order; the entry they leave is in ``self.left``."""
        for event in events:
            at = event["us"]
            if entry is not None and self.event_time:
                yield from self._expire(key, entry, at)
            if event["stage"] == BATCH_READ:
                if entry is None:
                    entry = {"grp": event["grp"], "topic": event["topic"], "first": at, "last": at,
                             "timed_out": None, "records": 0, "replays": 0, "timeouts": 0, "ranges": None}
                else:
                    entry["replays"] += 1
                    yield self._outcome(key, REPLAY_OBSERVED, entry, at)
                # A read from before the last one that is known is a replay, and does not arm the entry again.
                if at >= entry["last"]:
                    entry.update(last=at, records=event["records"], ranges=event["ranges"], timed_out=None)
                entry["first"] = min(entry["first"], at)
            elif entry is not None:
                entry["last"] = max(entry["last"], at)
                yield self._outcome(key, LATE_COMMIT if entry["timeouts"] else COMMITTED, entry, at)
                entry = None
        self.left = entry

    def _settle(self, entry: dict | None, early: list[dict], known: bool, fired: bool = False) -> None:
        """Store the entry and move the key's only timer to where it or the first of the events that wait is due.

        ``known`` says whether the state has an entry.
        """
        times = [] if entry is None or self._due(entry) is None else [self._due(entry)]
        times += [min(e["us"] for e in early)] if early else []
        # The timer that fired is gone.
        self._move(None if fired else self._timer(), min(times) if times else None)
        if fired and not times:
            self.timer.clear()
        if entry is not None:
            self.entry.update(tuple(entry[n] for n in _ENTRY))
        elif known:
            self.entry.clear()

    def _move(self, timer: int | None, due: int | None) -> None:
        # Timers count milliseconds; rounding up keeps a timer from firing before its tick.
        due = None if due is None else -(-due // 1000)
        if timer == due:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)
            self.timer.update((due,))
        else:
            self.timer.clear()

    def _passed(self, timerValues) -> int | None:
        """The last time the watermark has passed, where events wait for it."""
        return timerValues.getCurrentWatermarkInMs() * 1000 if self.event_time else None

    def _waiting(self) -> list[dict]:
        return [dict(zip(_EVENT, e)) for part in self.early.get() for e in json.loads(part[0])] if self.wait else []

    @staticmethod
    def _packed(events: list[dict]) -> tuple[str]:
        return (json.dumps([list(e.values()) for e in events]),)

    @staticmethod
    def _in_order(events: list[dict]) -> list[dict]:
        return sorted(events, key=lambda e: (e["us"], e["seq"], e["stage"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # A key's rows of one micro-batch come in any order; the source's batch bound limits them, and ``late`` those that wait.
        new = self._events(rows)
        passed = self._passed(timerValues)
        early: list[dict] = []
        if self.wait:
            early = [e for e in new if e["us"] > passed]
            new = [e for e in new if e["us"] <= passed]
            if not new:
                # Nothing to take, so what waits is not read. What the watermark has passed is due at the timer, in order.
                self.early.appendValue(self._packed(early))
                timer, first = self._timer(), min(e["us"] for e in early)
                if timer is None or first < timer * 1000:
                    self._move(timer, first)
                return
            # Behind the watermark: together with what has waited long enough, so that order is kept among them.
            held = self._waiting()
            new += [e for e in held if e["us"] <= passed]
            early += [e for e in held if e["us"] > passed]
            self._hold(early, held)
        entry = self._load()
        known = entry is not None
        yield from self._take(key[0], entry, self._in_order(new))
        entry = self.left
        if entry is not None and self.event_time:
            yield from self._expire(key[0], entry, passed + 1)
        self._settle(entry, early, known)

    @staticmethod
    def _events(rows: Iterator[Row]) -> list[dict]:
        found, at = [], None
        for row in rows:
            at = at or [row.__fields__.index(n) for n in _EVENT]
            found.append({n: row[i] for n, i in zip(_EVENT, at)})
        return found

    def _hold(self, early: list[dict], held: list[dict]) -> None:
        """Let the events ``early`` wait in place of ``held``."""
        if early:
            self.early.put([self._packed(early)])
        elif held:
            self.early.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self._load()
        known = entry is not None
        early: list[dict] = []
        if self.event_time:
            passed = self._passed(timerValues)
            held = self._waiting()
            due = [e for e in held if e["us"] <= passed]
            early = [e for e in held if e["us"] > passed]
            if due:
                self._hold(early, held)
            yield from self._take(key[0], entry, self._in_order(due))
            entry = self.left
            if entry is not None:
                yield from self._expire(key[0], entry, passed + 1)
                over = self._due(entry)
                if entry["timed_out"] is not None and over is not None and over <= passed:
                    entry = None
        elif entry is not None and entry["timed_out"] is not None:
            entry = None
        elif entry is not None:
            # By the wall clock the entry times out at the tick that finds it, which a lagging stream runs late.
            now = timerValues.getCurrentProcessingTimeInMs() * 1000
            entry["timed_out"] = now - now % self.tick_us
            entry["timeouts"] += 1
            yield self._outcome(key[0], ESTIMATED_FAILED, entry, entry["timed_out"])
        self._settle(entry, early, known, fired=True)

    def close(self) -> None:
        pass


def lifecycle_stream(
    audit: DataFrame,
    timeout: str = "60 seconds",
    extra: str = "30 seconds",
    tick: str = "10 seconds",
    clock: str = "event",
    late: str = "10 minutes",
    ttl: str | None = None,
    seq: str | None = None,
) -> DataFrame:
    """Outcomes of a streaming audit log.

    ``clock="event"`` runs ticks on the watermark, which trails the latest audit row of any stage by ``late``. Events up to ``late`` out
    of order are put in order first, so that outcomes are those of the batch operator; events later than that are applied when
    they come, at their own time, and none is dropped. With ``late`` of zero events are applied as they come, a key's in order
    within a micro-batch. ``clock="processing"`` runs ticks on the wall clock; Spark then always has a next batch, so run it
    with a time trigger and not with ``availableNow``. ``seq`` names the column that orders equal timestamps (a topic offset,
    say). Rows without a time are no events. Entries that timed out and are never committed stay in the state unless ``ttl`` is set.
    """
    if clock not in ("event", "processing"):
        raise ValueError("clock is 'event' or 'processing'")
    event_time = clock == "event"
    audit.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = F.col("timestamp").isNotNull()
    event = timed & F.col("stage").isin(BATCH_READ, OFFSET_COMMITTED)
    columns = [
        F.col("eventId"), F.unix_micros("timestamp").alias("us"),
        (F.coalesce(F.col(seq).cast("bigint"), F.lit(0)) if seq else F.lit(0).cast("bigint")).alias("seq"), F.col("stage"),
        F.col("consumerGroup").alias("grp"), F.col("sourceTopic").alias("topic"), F.col("recordCount").alias("records"),
        F.to_json("partitionRanges").alias("ranges"),
    ]
    if event_time:
        # A row that moves the clock, and an event that has none. Only the test of the clock itself stays above the watermark.
        marks = F.array_compact(F.array(
            F.when(timed, F.struct(F.col("timestamp").alias("clock"))), F.when(event, F.struct(F.lit(None).cast("timestamp").alias("clock")))))
        rows = audit.select(*columns, F.explode(marks).alias("_mark")).select("*", F.col("_mark.clock").alias("_clock")).drop("_mark")
        rows = rows.withWatermark("_clock", late).where(F.col("_clock").isNull())
    else:
        rows = audit.where(event).select(*columns)
    processor = LifecycleProcessor(
        micros(timeout) + micros(extra), micros(tick), None if ttl is None else micros(ttl), event_time, event_time and micros(late) > 0)
    out = rows.groupBy("eventId").transformWithState(
        processor, _OUT, "Append", "EventTime" if event_time else "ProcessingTime"
    )
    times = {"first": "firstSeenAt", "last": "lastSeenAt", "observed": "observedAt"}
    out = out.withColumns({n: F.timestamp_micros(n) for n in times}).withColumnsRenamed(times)
    return out.withColumn("partitionRanges", F.from_json("ranges", RANGES)).select(
        *[f.name for f in OUTCOME.fields]
    )


def pending_batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The open entries in the state of a lifecycle stream, as of its last finished micro-batch.

    Reads the checkpoint itself with Spark's state source, in as many tasks as the state has partitions, whether the stream runs,
    has stopped or failed. Columns are those of ``lifecycle.open_episodes``; events that still wait for the watermark are not in it.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pending").load()
    v = "value."
    return state.select(
        F.col("key.eventId").alias("eventId"), F.col(v + "grp").alias("consumerGroup"), F.col(v + "topic").alias("sourceTopic"),
        F.timestamp_micros(v + "first").alias("firstSeenAt"), F.timestamp_micros(v + "last").alias("lastSeenAt"),
        F.timestamp_micros(v + "timed_out").alias("timedOutAt"), F.col(v + "records").alias("recordCount"),
        F.col(v + "replays").alias("replayCount"), F.col(v + "timeouts").alias("timeoutCount"),
        F.from_json(v + "ranges", RANGES).alias("partitionRanges"))
