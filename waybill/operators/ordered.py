"""Ordered per-key work that stays balanced when one key holds much of the data.

A window over ``partitionBy(key)`` sorts each key inside one task. That is right while keys are
small and wrong when a key holds a third of the rows. ``Ordered`` looks at a sample of the keys
first. When no key is hot it is a plain window. Otherwise the hot keys, and only those, are cut
into segments along their order, the window runs per (key, segment), and what a segment needs
from the ones before or after it comes from a table with one row per segment. Segments hold about ``hot_rows``
rows each, or more where there would be above ``MAX_SEGMENTS`` of them, so that they are few enough to broadcast. Where keys are known to be small, ``hot_rows=None`` leaves
out the look at the sample.

The sample only decides where to cut. Any cut gives the same result, so nothing is lost or
approximated by it. The cut points are plain rows held by the driver (at most two per segment),
so a task that is run again sees the same segments. Placing and using them costs the same per row whatever their number,
but for the logarithm of that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

SEG = "_seg"
HOT_ROWS = 5_000_000
SAMPLE_FRACTION = 0.001
#: The driver holds the edges of so many segments, and tables with a row for each are broadcast. Where rows / ``hot_rows`` is more, segments
#: get larger and not more.
MAX_SEGMENTS = 20_000
SAMPLED_ROWS = 50
_FAN = 16
_WHOLE = -1


class Ordered:
    """Rows with a known order inside each key, cut into segments where a key is hot."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot_rows: int | None = HOT_ROWS,
        fraction: float = SAMPLE_FRACTION,
        sampler: Callable[[float], DataFrame] | None = None,
    ):
        """``sampler`` gives a sample of ``df`` when sampling its source is cheaper than sampling ``df``."""
        self.keys = list(keys)
        self.order = list(order)
        cuts = None
        if hot_rows is not None:
            # Few rows per segment means small data, where a thin sample would see nothing.
            fraction = min(1.0, max(fraction, 200.0 / hot_rows))
            sampler = sampler or (lambda share: df.sample(share, seed=17) if share < 1.0 else df)
            cuts = _cut_points(sampler, self.keys, self.order, hot_rows, fraction)
        self.split = cuts is not None
        self.rows = _tag(df, cuts, self.keys, self.order) if self.split else df.withColumn(SEG, F.lit(_WHOLE))

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, *([SEG] if self.split else [])).orderBy(*self.order)

    @property
    def position(self) -> Column:
        """Comparable value of a row's place in the order."""
        return F.struct(*self.order)

    def with_carry(
        self,
        df: DataFrame,
        per_segment: Mapping[str, Column],
        steps: Sequence[Mapping[str, Column]],
        keep: Mapping[str, T.DataType],
    ) -> DataFrame:
        """Add to each row what its segment receives from the other segments of its key.

        ``per_segment`` aggregates a segment, ``steps`` are window expressions over
        ``segments`` applied in turn, and ``keep`` names the resulting columns (with the type
        used when no key was split). Rows of keys that were not split get nulls.
        """
        if not self.split:
            return df.withColumns({name: F.lit(None).cast(kind) for name, kind in keep.items()})
        table = df.where(F.col(SEG) != _WHOLE).groupBy(*self.keys, SEG).agg(
            *[expr.alias(name) for name, expr in per_segment.items()]
        )
        for step in steps:
            table = table.withColumns(dict(step))
        # One row per segment.
        on = [*self.keys, SEG]
        table = table.select(*[F.col(c).alias(f"_of_{c}") for c in on], *keep)
        match = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
        return df.join(F.broadcast(table), match, "left").drop(*[f"_of_{c}" for c in on])

    def segments(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(SEG)

    def earlier_segments(self) -> WindowSpec:
        return self.segments().rowsBetween(Window.unboundedPreceding, -1)


def _cut_points(sampler, keys, order, hot_rows, fraction):
    """A table of segments' edges, numbered from 1 in each hot key, and the largest number; None without a hot key."""
    picked = sampler(fraction)
    hot = (
        picked.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows * fraction)
        # Each stands for more than hot_rows rows; any other has fewer rows than the largest segments.
        .orderBy(F.desc("_n"))
        .limit(MAX_SEGMENTS)
        .collect()
    )
    if not hot:
        return None
    spark = picked.sparkSession
    hot_total = sum(r["_n"] for r in hot) / fraction
    pieces = min(math.ceil(hot_total / hot_rows), MAX_SEGMENTS)
    hot_keys = spark.createDataFrame([r[:-1] for r in hot], picked.select(*keys).schema)
    # Some dozens of sampled rows per segment are enough to place its edges.
    keep = min(1.0, SAMPLED_ROWS * pieces / hot_total)
    narrow = sampler(keep).select(*keys, *[c for c in order if c not in keys])
    hot_keys = hot_keys.withColumnsRenamed({k: f"_hot_{k}" for k in keys})
    same_key = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    # At most MAX_SEGMENTS * SAMPLED_ROWS rows are ordered here, of one key or of many.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    every = max(1, math.floor(hot_total / pieces * keep))
    edges = (
        narrow.join(F.broadcast(hot_keys), same_key, "left_semi")
        .withColumn("_place", place)
        .where((F.col("_place") - 1) % every == 0)
        .select(*keys, F.struct(*order).alias("_edge"), "_place")
    )
    rows = edges.collect()
    if not rows:
        return None
    cuts = spark.createDataFrame(rows, edges.schema).select(
        *keys, "_edge", F.row_number().over(Window.partitionBy(*keys).orderBy("_edge")).alias("_i"))
    return cuts, max(r["_place"] - 1 for r in rows) // every + 1


def _tag(df, cuts, keys, order):
    """Number each hot key's rows by segment: how many of the key's edges lie at or before the row.

    The edges of a key are a tree of nodes with 15 edges each, one small table per level. A row meets one node of each level, so it
    is compared with 15 edges times the logarithm of their number.
    """
    edges, longest = cuts
    stride = 1
    while stride * _FAN <= longest:
        stride *= _FAN
    # One row for each node; the topmost level has one for each hot key.
    on = [f"_cut_{k}" for k in keys]
    edges = edges.withColumnsRenamed(dict(zip(keys, on)))
    match = [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, on)]
    names = [f"_edge_{j}" for j in range(1, _FAN)]
    top, tagged = True, df
    while stride:
        nodes = edges.withColumn("_node", F.expr(f"_i - _i % {stride * _FAN}"))
        if not top:
            nodes = nodes.where(f"_i % {stride} = 0 AND _i != _node")
        nodes = nodes.groupBy(*on, *([] if top else ["_node"])).agg(
            *[F.max(F.when(F.col("_i") == F.col("_node") + j * stride, F.col("_edge"))).alias(n) for j, n in enumerate(names, 1)],
            F.lit(True).alias("_hot"))
        tagged = tagged.join(F.broadcast(nodes), match if top else [*match, F.col(SEG) == F.col("_node")], "left")
        at = F.struct(*order)
        passed = sum((F.when(F.col(n) <= at, stride).otherwise(0) for n in names), F.lit(0))
        tagged = tagged.withColumn(SEG, F.when(F.col("_hot"), passed).otherwise(_WHOLE) if top else F.col(SEG) + passed)
        tagged = tagged.drop(*on, "_node", "_hot", *names)
        top, stride = False, stride // _FAN
    return tagged


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, **split) -> DataFrame:
    """1-based position of each row inside its key."""
    ordered = Ordered(df, keys, order, **split)
    local = ordered.rows.withColumn(name, F.row_number().over(ordered.window).cast("bigint"))
    carried = ordered.with_carry(
        local,
        {"_rows": F.count(F.lit(1))},
        [{"_before": F.sum("_rows").over(ordered.earlier_segments())}],
        {"_before": T.LongType()},
    )
    return carried.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_before", SEG)


def chunk(df: DataFrame, order: Sequence[str], size: int, partition_by: Sequence[str], **split) -> DataFrame:
    """Number the rows of each key in order and cut them into chunks of ``max(1, size)`` rows."""
    numbered = running_number(df, partition_by, order, "_row", **split)
    return numbered.withColumn("chunk", F.floor((F.col("_row") - 1) / F.lit(max(1, size))).cast("bigint")).drop("_row")


def current_batch(
    events: DataFrame, keys: Sequence[str], order: Sequence[str], event_id: str, is_read: Column, is_commit: Column, **split
) -> DataFrame:
    """For each commit, the id of the last batch read since the commit before it.

    Commits that follow another commit with no read between them get null.
    """
    ordered = Ordered(events.withColumns({"_read": is_read, "_commit": is_commit}), keys, order, **split)
    before = ordered.window.rowsBetween(Window.unboundedPreceding, -1)
    # A commit clears the current batch, so the last non-null of "what this row leaves behind" is
    # wanted; the struct keeps "cleared" apart from "not touched".
    left = F.when(F.col("_read"), F.struct(F.col(event_id).alias("id"))).when(
        F.col("_commit"), F.struct(F.lit(None).cast("string").alias("id"))
    )
    rows = ordered.rows.withColumn("_leaves", left)
    rows = rows.withColumn("_seen", F.last("_leaves", ignorenulls=True).over(before))
    kind = T.StructType([T.StructField("id", T.StringType())])
    rows = ordered.with_carry(
        rows,
        {"_tail": F.max_by("_leaves", F.when(F.col("_leaves").isNotNull(), ordered.position))},
        [{"_in": F.last("_tail", ignorenulls=True).over(ordered.earlier_segments())}],
        {"_in": kind},
    )
    return (
        rows.where("_commit")
        .withColumn("currentBatch", F.coalesce("_seen", "_in")["id"])
        .drop("_read", "_commit", "_leaves", "_seen", "_in", SEG)
    )
