"""Evaluation of metric samples on a step grid: counter increase and rate, as-of values, label algebra.

Samples are reduced to *pieces* before anything is ordered along a whole series. A piece holds what
a fixed slice of time (the greatest common divisor of window and step) contributes, so a series is
ordered over its slices and not over its samples, and a slice that is itself very large is cut into
several pieces. A series of very many slices is cut into ranges of them: each range is ordered by itself, one row per range says
what it holds (first and last slice and value, loss), and a scan of these rows gives every range what it takes over from
earlier ones, so that no task orders a series whole. Which grid points a piece opens or closes follows from its neighbours, so every
output row is produced directly: no join of samples with grid points and no sliding frame.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from waybill.functions import columns as C
from waybill.operators.ordered import SEG, Ordered
from waybill.session import BROADCAST_ROWS, cut_lineage, micros

#: A series of more slices than this is ordered range by range.
RANGE_SLICES = 1_000_000


def _epoch_us(at: str | datetime) -> int:
    if isinstance(at, str):
        at = datetime.fromisoformat(at)
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    delta = at - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


@dataclass(frozen=True)
class Grid:
    """Evaluation times ``start, start + step, ...`` up to ``end``; zoneless times are UTC."""

    start: str | datetime
    end: str | datetime
    step: str = "10 seconds"

    @property
    def start_us(self) -> int:
        return _epoch_us(self.start)

    @property
    def step_us(self) -> int:
        return micros(self.step)

    @property
    def last(self) -> int:
        """Index of the last grid point; -1 when the grid is empty."""
        return (_epoch_us(self.end) - self.start_us) // self.step_us

    @property
    def end_us(self) -> int:
        return self.start_us + self.last * self.step_us

    @property
    def points(self) -> int:
        return self.last + 1

    def at(self, index: Column) -> Column:
        return F.timestamp_micros(F.lit(self.start_us) + index * F.lit(self.step_us))


@dataclass(frozen=True)
class _Slices:
    """Slices of time shared by a grid and a look-back window."""

    grid: Grid
    window_us: int

    @property
    def size(self) -> int:
        return math.gcd(self.window_us, self.grid.step_us)

    @property
    def per_window(self) -> int:
        return self.window_us // self.size

    @property
    def per_step(self) -> int:
        return self.grid.step_us // self.size

    @property
    def total(self) -> int:
        """Slices from the first window's beginning to the last grid time: no series has more."""
        return (self.grid.end_us - self.grid.start_us + self.window_us) // self.size

    def cut(self, samples: DataFrame) -> DataFrame:
        """Samples some window can see, with their series key, time and slice number (from 1)."""
        before = self.grid.start_us - self.window_us
        # On the raw column, so that the bounds reach the scan.
        seen = samples.where(
            (F.col("ts") > F.timestamp_micros(F.lit(before)))
            & (F.col("ts") <= F.timestamp_micros(F.lit(self.grid.end_us)))
            & F.col("value").isNotNull()
        )
        rows = seen.select("metric", C.labels_key(F.col("labels")).alias("_key"), F.unix_micros("ts").alias("_t"), "value")
        # Slice k holds the times in (before + (k - 1) * size, before + k * size].
        rows = rows.withColumn("_slice", F.expr(f"(_t - {before + 1}) div {self.size} + 1"))
        if self.per_step > self.per_window:
            rows = rows.where(F.pmod(F.col("_slice") - 1, F.lit(self.per_step)) < self.per_window)
        return rows

    def indexes(self, low: Column, high: Column) -> Column:
        """Grid indexes whose point ends a slice numbered from ``low`` to ``high``."""
        first = F.greatest(F.ceil((low - self.per_window) / F.lit(self.per_step)), F.lit(0))
        last = F.least(F.floor((high - self.per_window) / F.lit(self.per_step)), F.lit(self.grid.last))
        none = F.array().cast("array<bigint>")
        return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(none)

    def closed_by(self, slice_: Column, next_slice: Column) -> Column:
        """Grid indexes whose window has this slice as its last one with data."""
        expiry = slice_ + self.per_window
        return self.indexes(slice_, F.least(F.coalesce(next_slice, expiry), expiry) - 1)

    def opened_by(self, slice_: Column, previous_slice: Column) -> Column:
        """Grid indexes whose window has this slice as its first one with data."""
        low = F.coalesce(F.greatest(slice_, previous_slice + self.per_window), slice_)
        return self.indexes(low, slice_ + self.per_window - 1)


def _lost(value: Column, previous: Column) -> Column:
    """What a counter lost by restarting from zero before this sample."""
    return F.when(value < previous, previous).otherwise(0.0)


_SERIES = ["metric", "_key"]


def _ranged(pieces: DataFrame, slices: _Slices, range_slices: int) -> tuple[DataFrame, list[str]]:
    """Pieces with the range they are in, written once where there are several ranges, and the columns to order them by."""
    if slices.total <= range_slices:
        return pieces, _SERIES
    return cut_lineage(pieces.withColumn("_range", F.expr(f"_slice div {range_slices}"))), [*_SERIES, "_range"]


def _with_ranges(pieces: DataFrame, table: DataFrame, steps: Sequence[dict[str, Column]], keep: Sequence[str]) -> DataFrame:
    """Pieces with what their range takes over. ``table`` has one row per series and range, ``steps`` are windows over a series of these."""
    for step in steps:
        table = table.withColumns(step)
    on = [*_SERIES, "_range"]
    table = table.select(*(F.col(c).alias(f"_of_{c}") for c in on), *keep)
    match = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return pieces.join(table, match).drop(*(f"_of_{c}" for c in on))


def increase(samples: DataFrame, window: str, grid: Grid, range_slices: int = RANGE_SLICES, **split) -> DataFrame:
    """Counter growth in ``(T - window, T]`` at each grid time T, per series.

    Sums the differences of consecutive samples inside the window; a drop counts as a restart and adds
    the new value. A window with one sample gives 0 and one without samples gives no row. Nothing is
    extrapolated to the window's edges.
    """
    slices = _Slices(grid, micros(window))
    ordered = Ordered(
        slices.cut(samples), ["metric", "_key", "_slice"], ["_t", "value"], **split,
        sampler=lambda share: slices.cut(samples.sample(share, seed=17) if share < 1.0 else samples),
    )
    within = ordered.window
    rows = ordered.rows.withColumns({"_prev": F.lag("value").over(within), "_next": F.lead("value").over(within)})
    # The first and last values are picked by flags so that the aggregation stays hash based.
    pieces = rows.groupBy("metric", "_key", "_slice", SEG).agg(
        F.max(F.when(F.isnull("_prev"), F.col("value"))).alias("_first"),
        F.max(F.when(F.isnull("_next"), F.col("value"))).alias("_last"),
        F.sum(_lost(F.col("value"), F.col("_prev"))).alias("_inner"),
    )
    pieces, by = _ranged(pieces, slices, range_slices)
    series = Window.partitionBy(*by).orderBy("_slice", SEG)
    pieces = pieces.withColumns({
        "_between": _lost(F.col("_first"), F.lag("_last").over(series)),
        "_before": F.lag("_slice").over(series),
        "_after": F.lead("_slice").over(series),
    })
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("_lost", F.sum(F.col("_between") + F.col("_inner")).over(upto))
    if by != _SERIES:
        at, over = F.struct("_slice", SEG), Window.partitionBy(*_SERIES).orderBy("_range")
        table = pieces.groupBy(*by).agg(
            F.min("_slice").alias("_low"), F.max("_slice").alias("_high"), F.min_by("_first", at).alias("_first"),
            F.max_by("_last", at).alias("_last"), F.max_by("_lost", at).alias("_loss"))
        pieces = _with_ranges(pieces, table, [
            {"_in_slice": F.lag("_high").over(over), "_next_slice": F.lead("_low").over(over), "_edge": _lost(F.col("_first"), F.lag("_last").over(over))},
            {"_in_lost": F.col("_edge") + F.coalesce(
                F.sum(F.col("_edge") + F.col("_loss")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))},
        ], ["_in_slice", "_next_slice", "_in_lost"])
        pieces = pieces.withColumns({
            "_before": F.coalesce("_before", "_in_slice"), "_after": F.coalesce("_after", "_next_slice"), "_lost": F.col("_lost") + F.col("_in_lost")})
    opened = slices.opened_by(F.col("_slice"), F.col("_before"))
    closed = slices.closed_by(F.col("_slice"), F.col("_after"))
    marks = pieces.select(
        "metric", "_key", "_first", "_last", "_lost", "_inner", F.posexplode(F.array(opened, closed)).alias("_closes", "_points")
    ).select("*", F.explode("_points").alias("i"))
    opens, closes = F.col("_closes") == 0, F.col("_closes") == 1

    def end(test: Column, value: Column) -> Column:
        return F.max(F.when(test, value))

    # Still partitioned by series (unless that is cut into ranges), so this grouping does not shuffle. Values and losses are
    # subtracted apart: a counter that never restarts gives the exact difference.
    ends = marks.groupBy("metric", "_key", "i").agg((
        (end(closes, F.col("_last")) - end(opens, F.col("_first")))
        + (end(closes, F.col("_lost")) - end(opens, F.col("_lost") - F.col("_inner")))
    ).alias("value"))
    return ends.select("metric", C.labels_from_key(F.col("_key")).alias("labels"), grid.at(F.col("i")).alias("ts"), "value")


def rate(samples: DataFrame, window: str, grid: Grid, **split) -> DataFrame:
    """Growth per second: ``increase`` over the length of the window."""
    grown = increase(samples, window, grid, **split)
    return grown.withColumn("value", F.col("value") / (micros(window) / 1e6))


def instant(samples: DataFrame, grid: Grid, lookback: str = "5 minutes", range_slices: int = RANGE_SLICES) -> DataFrame:
    """Latest value in ``(T - lookback, T]`` at each grid time T, per series."""
    slices = _Slices(grid, micros(lookback))
    # Combined before the shuffle: one row per series and slice leaves each task.
    pieces = slices.cut(samples).groupBy("metric", "_key", "_slice").agg(F.max_by("value", "_t").alias("value"))
    pieces, by = _ranged(pieces, slices, range_slices)
    pieces = pieces.withColumn("_after", F.lead("_slice").over(Window.partitionBy(*by).orderBy("_slice")))
    if by != _SERIES:
        next_slice = F.lead("_low").over(Window.partitionBy(*_SERIES).orderBy("_range"))
        table = pieces.groupBy(*by).agg(F.min("_slice").alias("_low"))
        pieces = _with_ranges(pieces, table, [{"_next_slice": next_slice}], ["_next_slice"])
        pieces = pieces.withColumn("_after", F.coalesce("_after", "_next_slice"))
    held = pieces.select(
        "metric", "_key", "value", F.explode(slices.closed_by(F.col("_slice"), F.col("_after"))).alias("_i")
    )
    return held.select("metric", C.labels_from_key(F.col("_key")).alias("labels"), grid.at(F.col("_i")).alias("ts"), "value")


def last_not_null(samples: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Latest value that is not null, per group."""
    return samples.where(F.col("value").isNotNull()).groupBy(*by).agg(
        F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts")
    )


# --- labels ------------------------------------------------------------------------------------

def keep_metrics(samples: DataFrame, regex: str) -> DataFrame:
    """Samples whose whole metric name matches."""
    return samples.where(F.col("metric").rlike(C.anchored(regex)))


def attach_labels(samples: DataFrame, labels: dict[str, str]) -> DataFrame:
    return samples.withColumn("labels", C.attached_labels(F.col("labels"), labels))


def match_labels(samples: DataFrame, eq: dict[str, str] | None = None, regex: dict[str, str] | None = None) -> DataFrame:
    return samples.where(C.matches(F.col("labels"), eq, regex))


def label_replace(samples: DataFrame, dst: str, replacement: str, src: str, regex: str) -> DataFrame:
    return samples.withColumn("labels", C.replaced_labels(F.col("labels"), dst, replacement, src, regex))


def metric_names(samples: DataFrame) -> DataFrame:
    """Distinct metric names in order, without empty ones."""
    return samples.select("metric").where(F.col("metric") != "").distinct().orderBy("metric")


# --- vectors: (labels, ts, value), each label set once per time ------------------------------------

_AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    "count": lambda c: F.count(c).cast("double"),
}


def agg_by(vector: DataFrame, fn: str, by: Sequence[str] = ()) -> DataFrame:
    """Aggregate over label sets at each time, keeping the labels in ``by``."""
    names = [f"_by{i}" for i in range(len(by))]
    rows = vector.select(
        "ts", "value", *[F.try_element_at("labels", F.lit(b)).alias(n) for b, n in zip(by, names)]
    )
    pairs = [x for b, n in zip(by, names) for x in (F.lit(b), F.col(n))]
    labels = F.map_filter(F.create_map(*pairs).cast("map<string,string>"), lambda _, v: v.isNotNull())
    return rows.groupBy("ts", *names).agg(_AGGREGATES[fn]("value").alias("value")).select(
        labels.alias("labels"), "ts", "value"
    )


def count_groups(vector: DataFrame, by: str) -> DataFrame:
    """Number of distinct values of a label at each time."""
    value = C.label(F.col("labels"), by)
    return vector.groupBy("ts").agg(F.count_distinct(value).cast("double").alias("value")).select(
        F.create_map().cast("map<string,string>").alias("labels"), "ts", "value"
    )


def scale(vector: DataFrame, convert: Callable[[Column], Column]) -> DataFrame:
    return vector.withColumn("value", convert(F.col("value")))


_OPERATIONS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b != 0, a / b)
    .when((a == 0) | F.isnan(a), F.lit(float("nan")))
    .otherwise(F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))),
}


def vector_op(
    left: DataFrame, right: DataFrame, op: str, on: Sequence[str] | None = None, points: int | None = None
) -> DataFrame:
    """Arithmetic of values with matching labels and time.

    ``on=None`` matches whole label sets, ``on=[...]`` only those labels, and ``on=[]`` time alone, with
    one right value per time. ``points`` states how many times there are: with ``on=[]`` the right side
    then has a known size and is broadcast while that is small.
    """
    def key(labels: Column) -> Column:
        if on is None:
            return C.labels_key(labels)
        return F.concat_ws("\u0001", *[C.label(labels, n) for n in on]) if on else F.lit("")

    by = ["ts"] if on is not None and not on else ["_key", "ts"]
    a = left.withColumn("_key", key(F.col("labels"))).select("labels", "_key", "ts", F.col("value").alias("_a"))
    b = right.withColumn("_key", key(F.col("labels"))).select("_key", "ts", F.col("value").alias("_b")).select(*by, "_b")
    if by == ["ts"] and points is not None and points <= BROADCAST_ROWS:
        b = F.broadcast(b)
    return a.join(b, by).select("labels", "ts", _OPERATIONS[op](F.col("_a"), F.col("_b")).alias("value"))


def _first_per_label_set(ranked: DataFrame) -> DataFrame:
    """Of equal label sets at one time, the value with the lowest rank."""
    return (
        ranked.groupBy(C.labels_key(F.col("labels")).alias("_key"), "ts")
        .agg(F.min_by("value", "_rank").alias("value"))
        .select(C.labels_from_key(F.col("_key")).alias("labels"), "ts", "value")
    )


def vector_or(*operands: DataFrame) -> DataFrame:
    """Each label set and time from the first operand that has it: one grouping for any number of operands."""
    ranked = None
    for rank, operand in enumerate(operands):
        rows = operand.select("labels", "ts", "value", F.lit(rank).alias("_rank"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return _first_per_label_set(ranked)


@dataclass(frozen=True)
class Selector:
    """Series whose ``label`` matches ``regex`` get ``dst`` set to ``replacement``."""

    label: str
    regex: str
    replacement: str
    capture: str = ".*"


def relabelled_or(vector: DataFrame, selectors: Sequence[Selector], dst: str) -> DataFrame:
    """``or`` of one rewritten copy of the vector per selector, reading the vector once."""
    labels = F.col("labels")
    copies = F.array(*[
        F.when(
            C.matches(labels, regex={s.label: s.regex}),
            F.struct(
                F.lit(i).alias("_rank"),
                C.replaced_labels(labels, dst, s.replacement, s.label, s.capture).alias("labels"),
            ),
        )
        for i, s in enumerate(selectors)
    ])
    rows = vector.select(F.explode(F.array_compact(copies)).alias("c"), "ts", "value")
    return _first_per_label_set(rows.select("c.labels", "ts", "value", "c._rank"))
