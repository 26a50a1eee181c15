"""Column expressions: audit and outcome JSON, identifiers, labels and units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from waybill.schemas import BATCH_READ, RANGES, STAGES

_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_ISO = r"(?i)^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"


# --- time -------------------------------------------------------------------------------------

def parse_instant(text: Column) -> Column:
    """ISO-8601 instant with a zone, else null."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(F.upper(text)))


def parse_instant_or_epoch(text: Column) -> Column:
    """ISO-8601 instant, or decimal epoch seconds."""
    seconds = text.try_cast("decimal(20,6)")
    return F.coalesce(parse_instant(text), F.timestamp_micros((seconds * 1_000_000).cast("bigint")))


def iso_instant(ts: Column) -> Column:
    """UTC text of a timestamp, independent of the session time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# --- JSON -------------------------------------------------------------------------------------

def _number(text: Column, kind: str) -> Column:
    """A required JSON number: numeric text is read, a fraction is cut off, other text counts as 0."""
    return F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind), F.lit(0).cast(kind))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def audit_struct(text: Column) -> Column:
    """Audit JSON as a struct, null where it breaks the audit contract.

    Every field is read as text first, because the contract accepts numbers written as text and
    tells a missing field from a wrongly typed one.
    """
    raw = F.from_json(
        text,
        "eventId string, stage string, consumerGroup string, sourceTopic string, timestamp string, recordCount string, "
        "partitionRanges array<struct<partition string, offsetMin string, offsetMax string, recordCount string>>",
        _JSON,
    )
    return _let(raw, lambda r: _let(
        parse_instant(r["timestamp"]), lambda at: F.when(_audit_valid(r, at), _audit_fields(r, at))
    ))


def _audit_valid(raw: Column, at: Column) -> Column:
    complete = F.forall(
        raw["partitionRanges"],
        lambda r: F.coalesce(
            r["partition"].isNotNull()
            & r["offsetMin"].isNotNull()
            & r["offsetMax"].isNotNull()
            & r["recordCount"].isNotNull(),
            F.lit(False),
        ),
    )
    return (
        raw["eventId"].isNotNull()
        & raw["stage"].isin(*STAGES)
        & raw["consumerGroup"].isNotNull()
        & raw["sourceTopic"].isNotNull()
        & at.isNotNull()
        & raw["recordCount"].isNotNull()
        & ((raw["stage"] != BATCH_READ) | F.coalesce(complete, F.lit(False)))
    )


def _audit_fields(raw: Column, at: Column) -> Column:
    ranges = F.transform(
        raw["partitionRanges"],
        lambda r: F.struct(
            _number(r["partition"], "int").alias("partition"),
            _number(r["offsetMin"], "bigint").alias("offsetMin"),
            _number(r["offsetMax"], "bigint").alias("offsetMax"),
            _number(r["recordCount"], "int").alias("recordCount"),
        ),
    )
    return F.struct(
        *[raw[n].alias(n) for n in ("eventId", "stage", "consumerGroup", "sourceTopic")],
        at.alias("timestamp"),
        _number(raw["recordCount"], "int").alias("recordCount"),
        F.when(raw["stage"] == BATCH_READ, ranges).otherwise(F.array().cast(RANGES)).alias("partitionRanges"),
    )


def outcome_struct(text: Column) -> Column:
    """Outcome JSON as a struct; unknown fields are ignored, counters default to 0, ranges to none."""
    raw = F.from_json(
        text,
        "eventId string, outcome string, consumerGroup string, sourceTopic string, firstSeenAt string, "
        "lastSeenAt string, observedAt string, recordCount string, replayCount string, timeoutCount string, "
        "partitionRanges array<struct<partition int, offsetMin bigint, offsetMax bigint, recordCount int>>",
        _JSON,
    )
    return _let(raw, _outcome_fields)


def _outcome_fields(raw: Column) -> Column:
    counters = {
        n: F.when(raw[n].isNull(), 0).otherwise(raw[n].try_cast("int")) for n in ("recordCount", "replayCount", "timeoutCount")
    }
    valid = raw["outcome"].isNotNull() & raw["consumerGroup"].isNotNull() & raw["sourceTopic"].isNotNull()
    for value in counters.values():
        valid = valid & value.isNotNull()
    ranges = F.transform(
        F.coalesce(raw["partitionRanges"], F.array().cast(RANGES)),
        lambda r: F.struct(
            F.coalesce(r["partition"], F.lit(0)).alias("partition"),
            F.coalesce(r["offsetMin"], F.lit(0).cast("bigint")).alias("offsetMin"),
            F.coalesce(r["offsetMax"], F.lit(0).cast("bigint")).alias("offsetMax"),
            F.coalesce(r["recordCount"], F.lit(0)).alias("recordCount"),
        ),
    )
    return F.when(
        valid,
        F.struct(
            *[raw[n].alias(n) for n in ("eventId", "outcome", "consumerGroup", "sourceTopic")],
            *[parse_instant_or_epoch(raw[n]).alias(n) for n in ("firstSeenAt", "lastSeenAt", "observedAt")],
            *[c.alias(n) for n, c in counters.items()],
            ranges.alias("partitionRanges"),
        ),
    )


def audit_json() -> Column:
    """Audit row as JSON text; ranges appear only on reads."""
    ranges = F.when(F.col("stage") == BATCH_READ, F.coalesce("partitionRanges", F.array().cast(RANGES)))
    return F.to_json(F.struct(
        "eventId", "stage", "consumerGroup", "sourceTopic",
        iso_instant(F.col("timestamp")).alias("timestamp"),
        F.coalesce("recordCount", F.lit(0)).alias("recordCount"),
        ranges.alias("partitionRanges"),
    ))


def outcome_json() -> Column:
    """Outcome row as JSON text with ISO timestamps."""
    return F.to_json(F.struct(
        "eventId", "outcome", "consumerGroup", "sourceTopic",
        *[iso_instant(F.col(n)).alias(n) for n in ("firstSeenAt", "lastSeenAt", "observedAt")],
        "recordCount", "replayCount", "timeoutCount",
        F.coalesce("partitionRanges", F.array().cast(RANGES)).alias("partitionRanges"),
    ))


# --- identifiers ------------------------------------------------------------------------------

def ranges_text(ranges: Column, between: str = "|") -> Column:
    """``partition:min:max:count`` of each range, in partition order."""
    return F.array_join(
        F.transform(
            F.sort_array(ranges),
            lambda r: F.concat_ws(":", r["partition"], r["offsetMin"], r["offsetMax"], r["recordCount"]),
        ),
        between,
    )


def fingerprint(group: Column, topic: Column, count: Column, ranges: Column) -> Column:
    """SHA-256 hex of ``group|topic|count`` followed by ``|partition:min:max:count`` per range."""
    head = F.concat_ws("|", group, topic, count.cast("string"))
    tail = ranges_text(ranges)
    return F.sha2(F.when(F.size(ranges) > 0, F.concat_ws("|", head, tail)).otherwise(head), 256)


def sink_event_id(deterministic: bool) -> Column:
    """A fresh UUID, or a hash of the record's place so that a retry writes the same id."""
    if not deterministic:
        return F.uuid()
    return F.sha2(F.concat_ws("|", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")), 256)


# --- labels -----------------------------------------------------------------------------------

def label_or_unknown(value: Column) -> Column:
    """Null and blank label values become ``unknown``."""
    return F.when(value.isNull() | value.rlike(r"^\s*$"), "unknown").otherwise(value)


def sorted_labels(labels: Column) -> Column:
    return F.map_from_entries(F.sort_array(F.map_entries(labels)))


def labels_key(labels: Column) -> Column:
    """Text that is equal exactly when two label sets are equal; usable as a join or group key."""
    return F.to_json(sorted_labels(F.coalesce(labels, F.create_map().cast("map<string,string>"))))


def labels_from_key(key: Column) -> Column:
    return F.from_json(key, "map<string,string>")


def _quoted(text: Column) -> Column:
    inner = F.to_json(F.array(text))
    return F.substr(inner, F.lit(2), F.length(inner) - 2)


def series_name(labels: Column, index: Column | None = None) -> Column:
    """Sorted-key JSON of the labels as the CSV export spells it, or ``series_<index>`` when empty."""
    entries = F.sort_array(F.map_entries(labels))
    pairs = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(": "), _quoted(e["value"])))
    text = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    position = F.lit(0) if index is None else index
    return F.when(F.size(entries) > 0, text).otherwise(F.concat(F.lit("series_"), position.cast("string")))


def anchored(regex: str) -> str:
    return f"^(?:{regex})$"


def label(labels: Column, name: str) -> Column:
    """A label's value; a missing label counts as empty text."""
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


def matches(labels: Column, eq: dict[str, str] | None = None, regex: dict[str, str] | None = None) -> Column:
    """All equality and (anchored) regular-expression matchers hold."""
    test = F.lit(True)
    for name, value in (eq or {}).items():
        test = test & (label(labels, name) == value)
    for name, pattern in (regex or {}).items():
        test = test & label(labels, name).rlike(anchored(pattern))
    return test


def replaced_labels(labels: Column, dst: str, replacement: str, src: str, regex: str) -> Column:
    """Set ``dst`` from ``src`` where the whole value matches; an empty result removes ``dst``."""
    value = label(labels, src)
    result = F.regexp_replace(value, anchored(regex), replacement)
    without = F.map_filter(labels, lambda k, _: k != dst)
    changed = F.when(result == "", without).otherwise(F.map_concat(without, F.create_map(F.lit(dst), result)))
    return F.when(value.rlike(anchored(regex)), changed).otherwise(labels)


def attached_labels(labels: Column, extra: dict[str, str]) -> Column:
    """Add fixed labels; the added value wins over one already present."""
    kept = F.map_filter(labels, lambda k, _: ~k.isin(*extra)) if extra else labels
    pairs = [F.lit(x) for item in extra.items() for x in item]
    return F.map_concat(kept, F.create_map(*pairs)) if extra else kept


def file_name(name: Column) -> Column:
    """Keep letters, digits, dot, underscore and dash; ``metric`` when nothing is left."""
    kept = F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("metric"))


# --- units ------------------------------------------------------------------------------------

def kib(value: Column) -> Column:
    return value / 1024


def mib(value: Column) -> Column:
    return value / 1048576


def gib(value: Column) -> Column:
    return value / 1073741824


def percent(value: Column) -> Column:
    return value * 100
