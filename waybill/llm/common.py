"""Helpers shared by the corpus operators: tables, Arrow maps, word hashes, fixed-size filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Words of most contracts are runs without these bytes: [\x20\x09-\x0D].
SPACE = r"[ \t-\r]+"
_HASH_CHUNK = 1 << 20
PIECE = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_columns(df: DataFrame, fields: T.StructType, compute: Callable[[pa.Array], list], text: str = "text") -> DataFrame:
    """``df`` with the columns of ``fields``, computed batch by batch from the text column.

    ``compute`` gets the texts of a slice of a batch (about ``PIECE`` bytes or one row; nulls as empty strings) and returns one Arrow array per
    field. A column of ``df`` with the name of a new one is replaced by it.
    """
    kept = [f for f in df.schema.fields if f.name not in fields.fieldNames()]
    schema = T.StructType(kept + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            old = [batch.column(f.name) for f in kept]
            new = compute(pc.fill_null(batch.column(text), ""))
            yield pa.RecordBatch.from_arrays([*old, *new], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text (or one row), so that arrays made from them stay small."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array, lower: bool = False, alphabet: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, in order, and where each text's words start.

    Words are runs of bytes outside [\\x20\\x09-\\x0D], or of the bytes that ``alphabet`` (256 booleans) marks; ``lower``
    lower-cases A-Z first. The second array has one entry more than there are texts. Works in pieces of about 1 MB cut between words, so
    that memory does not follow the longest text.
    """
    texts = texts.cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets) or buffers[2] is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = (data != 32) & ~((data >= 9) & (data <= 13)) if alphabet is None else alphabet[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + _HASH_CHUNK)))
        stop = int(starts[end]) if end < len(starts) else len(data)
        part, mine = data[starts[at] : stop], starts[at:end] - starts[at]
        if lower:
            part = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        lengths = np.diff(np.append(mine, len(part)))
        place = np.arange(len(part)) - np.repeat(mine, lengths)
        values = (part.astype(np.uint64) + np.uint64(1)) * solid[starts[at] : stop]
        values *= _powers(int(lengths.max()))[place]
        out[at:end] = np.add.reduceat(values, mine)
        at = end
    return mix(out), first


def runs_of_words(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and where each text's runs start."""
    n = len(words) - size + 1
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if n <= 0:
        return np.zeros(0, np.uint64), begin
    acc = np.full(n, np.uint64(size), np.uint64)
    for j in range(size):
        acc *= _STEP
        acc += words[j : j + n]
    # Runs that start in a text's last size-1 words reach into the next text.
    place = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    return mix(acc[place]), begin


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def beside(docs: DataFrame, names: list[str], choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``choose`` keeps of ``docs``, with all columns as they were. ``names`` are columns that ``choose`` makes on the way: columns of
    ``docs`` of these names stand aside under others meanwhile."""
    clash = [c for c in docs.columns if c.lower() in {n.lower() for n in names}]
    aside = dict(zip(clash, free(docs, *clash)))
    chosen = choose(docs.withColumnsRenamed(aside)) if clash else choose(docs)
    return chosen.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def id_filter(ids: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """A bitmap of 2**bits positions in rows of 4 KB, marking the hashes of ``key``; always of that size at most."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return (
        ids.select(place.alias("_place"))
        .groupBy(F.expr("bitmap_bucket_number(_place)").alias("_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_place))").alias("_bits"))
    )


def may_be_in(df: DataFrame, marks: DataFrame, key: str, bits: int = 23, flag: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among those in an ``id_filter``; an exact join has to follow (an
    inner one: the optimizer would move a semi join ahead of this filter).

    With ``flag`` all rows stay and that column tells. The bitmap is broadcast: its size is fixed by ``bits``. A full bitmap
    lets all rows pass.
    """
    place, bucket, held, found = free(df, "place", "bucket", "bits", "of")
    marks = marks.select(F.col("_bucket").alias(found), F.col("_bits").alias(held))
    at = F.expr(f"cast(bitmap_bit_position(`{place}`) div 8 + 1 as int)")
    byte = F.conv(F.hex(F.substring(held, at, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position(`{place}`) % 8 as int))")) != 0, F.lit(False))
    joined = (
        df.withColumn(place, F.pmod(F.xxhash64(key), F.lit(1 << bits))).withColumn(bucket, F.expr(f"bitmap_bucket_number(`{place}`)"))
        .join(F.broadcast(marks), F.col(bucket) == F.col(found), "left" if flag else "inner"))
    return (joined.withColumn(flag, hit) if flag else joined.filter(hit)).drop(place, bucket, held, found)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where lambdas refer to it again and again."""
    return F.transform(F.array(value), body)[0]
