"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of every benchmark item (an item of fewer words is one
pattern). For patterns of one length a search position is judged by its last block of two words: the shift
table says how far the search may jump when no pattern has that block near its end; with no jump
possible, the bucket of that block lists the patterns ending in it, a prefix block discards most of them, and
comparison of all words confirms an occurrence.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Null or empty texts have no words; items
without words, and null items, have no patterns; an item without id marks words but is not named. Patterns shared by several
items name each of them. Repeated documents get equal rows; an empty benchmark leaves every document clean.

Documents are searched where they are read: no shuffle. The patterns go to the workers in blocks of bounded size
(``block_bytes`` of benchmark text); a larger benchmark takes several passes, each of which carries the marks on.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from waybill.llm.common import beside
from waybill.session import cut_lineage

WINDOW = 10
BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


class Search:
    """Wu-Manber tables, one set per pattern length."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(len(words) - window, 0) + 1 if words else 0):
                owners[tuple(words[i : i + window])].add(item)
        self.owners = dict(owners)
        lengths: dict[int, list] = defaultdict(list)
        for pattern in owners:
            lengths[len(pattern)].append(pattern)
        self.tables = []
        for size, patterns in sorted(lengths.items()):
            block = min(2, size)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
            for pattern in patterns:
                for end in range(block, size + 1):
                    key = pattern[end - block : end]
                    shift[key] = min(size - end, shift.get(key, size))
                buckets[pattern[-block:]].append((pattern[:block], pattern))
            self.tables.append((size, block, shift, dict(buckets)))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(start, pattern) of every occurrence."""
        for size, block, shift, buckets in self.tables:
            jump, n, end = size - block + 1, len(words), size
            while end <= n:
                suffix = tuple(words[end - block : end])
                move = shift.get(suffix, jump)
                if move:
                    end += move
                    continue
                start = end - size
                prefix = tuple(words[start : start + block])
                for first, pattern in buckets[suffix]:
                    if first == prefix and tuple(words[start:end]) == pattern:
                        yield start, pattern
                end += 1


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items, streamed through the driver in lists of at most ``block_bytes`` (or one item)."""
    rows = benchmark.select(F.col(item).cast("string"), F.col(text)).filter(F.col(text).isNotNull())
    block: list = []
    held = 0
    for i, t in rows.toLocalIterator():
        size = len(t.encode())
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((i, t))
        held += size
    yield block


def mark(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with ``n_words``, ``hits`` (sorted disjoint runs of hit words as flat from, to pairs, end exclusive) and
    ``items`` (ids of the items with an occurring window, sorted as strings). Columns of those names are replaced."""
    out = documents.drop("n_words", "hits", "items")
    passes = 0
    for block in _blocks(benchmark, item, item_text, block_bytes):
        if passes:
            out = cut_lineage(out)
        out = _pass(out, block, text, window, passes > 0)
        passes += 1
    return out


_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
_searches: dict[str, Search] = {}


def _pass(docs: DataFrame, block: list, text: str, window: int, more: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key = hashlib.sha256(repr((window, block)).encode()).hexdigest()
    kept = [f for f in docs.schema.fields if f.name not in {x.name for x in _FIELDS}]
    schema = T.StructType(kept + _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _searches:
            _searches.clear()
            _searches[key] = Search(shared.value, window)
        search = _searches[key]
        for batch in batches:
            counts, hits, items = [], [], []
            old = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist()) if more else None
            for t in pc.fill_null(batch.column(text), ""):
                words = words_of(t.as_py())
                runs, named = map(list, next(old)) if old else ([], [])
                found = set(named)
                spans = list(zip(runs[::2], runs[1::2]))
                for start, pattern in search.find(words):
                    spans.append((start, start + len(pattern)))
                    found.update(i for i in search.owners[pattern] if i is not None)
                counts.append(len(words))
                hits.append(_joined(spans))
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _joined(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping or touching spans as one, flattened."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    marked = mark(documents.select("doc_id", "text"), benchmark, **options)
    n_hit = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")),
                        lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns as they were (also those that ``mark`` makes)."""
    return beside(documents, [f.name for f in _FIELDS], lambda docs: mark(docs, benchmark, **options).filter(F.size("hits") == 0))
