from datetime import datetime, timedelta, timezone

from waybill.schemas import AUDIT

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    """Instant a number of seconds after the epoch."""
    return EPOCH + timedelta(microseconds=round(seconds * 1_000_000))


def seconds(ts):
    """Seconds after the epoch of a timestamp collected in any local zone."""
    return ts.timestamp()


def audit_rows(spark, key, log):
    """``log`` is a list of ("R" | "C", seconds); record counts number the reads."""
    rows = []
    for i, (kind, t) in enumerate(log):
        read = kind == "R"
        rows.append((
            key, "BATCH_READ" if read else "OFFSET_COMMITTED", "g", "t", at(t), i + 1 if read else 0,
            [(0, i, i, 1)] if read else [],
        ))
    return spark.createDataFrame(rows, AUDIT)


def simulate(log, threshold, tick, horizon):
    """Outcomes of one key's sorted log, event by event and tick by tick."""
    out, entry = [], None

    def emit(name, when):
        out.append((name, entry["first"], entry["last"], when, entry["rc"], entry["replays"], entry["timeouts"]))

    def expire(until, inclusive):
        due = ((entry["last"] + threshold) // tick + 1) * tick
        if entry["armed"] and (due < until or (inclusive and due <= until)):
            entry["armed"] = False
            entry["timeouts"] += 1
            emit("ESTIMATED_FAILED", due)

    for i, (kind, t) in enumerate(log):
        if entry is not None:
            expire(t, False)
        if kind == "R":
            if entry is None:
                entry = {"first": t, "replays": 0, "timeouts": 0}
            else:
                entry["replays"] += 1
                emit("REPLAY_OBSERVED", t)
            entry.update(last=t, rc=i + 1, armed=True)
        elif entry is not None:
            entry["last"] = t
            emit("LATE_COMMIT" if entry["timeouts"] else "COMMITTED", t)
            entry = None
    if entry is not None:
        expire(horizon, True)
    return sorted(out)


def collected(outcomes):
    return sorted(
        (r["outcome"], seconds(r["firstSeenAt"]), seconds(r["lastSeenAt"]), seconds(r["observedAt"]),
         r["recordCount"], r["replayCount"], r["timeoutCount"])
        for r in outcomes.collect()
    )
