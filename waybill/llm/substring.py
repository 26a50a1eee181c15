"""Substring deduplication with difference-cover anchors.

A window is 20 consecutive words. For a period of 13 the positions 0, 1, 3 and 9 are a difference cover: whatever two
positions are compared, some shift below 13 brings both onto cover positions. So if two windows are equal, one of their runs of eight
words (20 - 13 + 1) starts on a cover position in both texts. Only those runs, the anchors, are hashed for the whole
corpus: 4 of 13 positions. A window with no repeated anchor inside cannot be repeated. The rest are extended: the 20 words of a
window around a repeated anchor are hashed as a whole and compared across the corpus, and every occurrence after the first
(smaller doc_id, or earlier start in one document) marks its words. Windows are judged on the input.

Words are runs outside [\\x20\\x09-\\x0D], told apart by 64-bit hashes. Null texts have no words; rows of equal doc_id are copies of one
document (none is earlier than the other); rows without doc_id come after all others and are documents by their text, in the order of its
hash: equal ones are copies, different ones are not. An empty table gives an empty one.

Repeated windows inside a batch are found there; what goes over the network is one row of packed numbers per batch and slice
of the hash space, so that a passage in a third of all documents arrives once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from waybill.llm.common import pieces, runs_of_words, word_hashes
from waybill.llm.rare import level_of, levels, slice_bits, text_bytes
from waybill.session import cut_lineage

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bins of the table of repeated anchors: 64 MB at a byte each.
TABLE_BITS = 26
SLICE_TEXT = 64 << 20
_LAST = 2**63 - 1


def _anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors and the places (word numbers of the batch) where they start."""
    h, begin = runs_of_words(words, first, ANCHOR)
    counts = np.diff(begin)
    inside = np.arange(len(h)) - np.repeat(begin[:-1], counts)
    chosen = np.isin(inside % PERIOD, COVER)
    return h[chosen], (inside + np.repeat(first[:-1], counts))[chosen]


def anchor_hashes(texts: pa.Array) -> np.ndarray:
    return _anchors(*word_hashes(texts))[0]


def _keyed(documents: DataFrame, tail: str = "") -> DataFrame:
    """``documents`` with ``_doc`` and ``_tie`` (and ``tail``), which together tell documents apart; the tie is 0 wherever there is a doc_id."""
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))
    return documents.withColumns({f"_doc{tail}": F.coalesce("doc_id", F.lit(_LAST)), f"_tie{tail}": tie})


def _split(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc, tie, packed starts) for rows sorted by doc and tie."""
    edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]), [True]])) if len(doc) else [0]
    return [(int(doc[a]), int(tie[a]), start[a:b].astype("<i4").tobytes()) for a, b in zip(edges, edges[1:])]


def _later(h: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (hash, doc, tie, start), and which of that order come after the first of their hash."""
    order = np.lexsort((start, tie, doc, h))
    h, doc, tie, start = h[order], doc[order], tie[order], start[order]
    run = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    lead = np.flatnonzero(run)[np.cumsum(run) - 1] if len(h) else np.zeros(0, np.int64)
    return order, (doc != doc[lead]) | (tie != tie[lead]) | (start != start[lead])


#: ``ties`` has numbers for the windows of rows without doc_id only.
_SENT = "slice int, doc long, tie long, hashes binary, docs binary, ties binary, low binary, high binary"


def _candidates(documents: DataFrame, table, cuts: int) -> DataFrame:
    """Windows with a repeated anchor, packed by slice; rows with ``doc`` set hold starts already known to be repeated."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(table.value, np.uint8)
        for batch in pieces(batches):
            words, first = word_hashes(batch.column("text"))
            ids, own_ties = batch.column("_doc").to_numpy(), batch.column("_tie").to_numpy()
            a, places = _anchors(words, first)
            flags = np.zeros(len(words) + 1, np.int64)
            flags[places[level_of(marks, a) > 0] + 1] = 1
            upto = np.cumsum(flags)
            h, begin = runs_of_words(words, first, WINDOW)
            counts = np.diff(begin)
            start = (np.arange(len(h)) - np.repeat(begin[:-1], counts))
            place = start + np.repeat(first[:-1], counts)
            keep = upto[place + PERIOD] > upto[place]
            h, start, doc, tie = h[keep], start[keep], np.repeat(ids, counts)[keep], np.repeat(own_ties, counts)[keep]
            order, later = _later(h, doc, tie, start)
            h, start, doc, tie = h[order], start[order], doc[order], tie[order]
            known = np.lexsort((start[later], tie[later], doc[later]))
            mine = _split(doc[later][known], tie[later][known], start[later][known])
            new = ~later
            new[1:] &= (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1])
            h, start, doc, tie = h[new], start[new], doc[new], tie[new]
            edges = np.searchsorted(h >> np.uint64(64 - cuts), np.arange((1 << cuts) + 1))
            rows = [(i, None, None, _bytes(h[x:y], "<u8"), _bytes(doc[x:y], "<i8"), _bytes(tie[x:y][doc[x:y] == _LAST], "<i8"), _bytes(start[x:y] & 0xFFFF, "<u2"), _bytes(start[x:y] >> 16, "<u2"))
                    for i, (x, y) in enumerate(zip(edges, edges[1:])) if x < y]
            rows += [((d + t) % (1 << cuts), d, t, None, None, None, s, None) for d, t, s in mine]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["slice", "doc", "tie", "hashes", "docs", "ties", "low", "high"])

    docs = _keyed(documents.select("doc_id", "text")).select("_doc", "_tie", F.coalesce("text", F.lit("")).alias("text"))
    return docs.mapInArrow(send, _SENT)


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _compare(part: pa.Table) -> pa.Table:
    """One slice: starts of later occurrences, per document."""
    known = pc.is_valid(part["doc"])
    ready, packed = part.filter(known), part.filter(pc.invert(known))

    def joined(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(packed[name].to_pylist()), kind)

    h, doc = joined("hashes", "<u8"), joined("docs", "<i8")
    start = joined("low", "<u2").astype(np.int64) | joined("high", "<u2").astype(np.int64) << 16
    tie = np.zeros(len(doc), np.int64)
    tie[doc == _LAST] = joined("ties", "<i8")
    order, later = _later(h, doc, tie, start)
    doc, tie, start = doc[order][later], tie[order][later], start[order][later]
    by_doc = np.lexsort((start, tie, doc))
    found = _split(doc[by_doc], tie[by_doc], start[by_doc]) + list(zip(*(ready[name].to_pylist() for name in ("doc", "tie", "low"))))
    return pa.table({
        "doc": pa.array([d for d, _, _ in found], pa.int64()), "tie": pa.array([t for _, t, _ in found], pa.int64()),
        "starts": pa.array([s for _, _, s in found], pa.binary())})


def repeated_starts(documents: DataFrame, table_bits: int = TABLE_BITS) -> DataFrame:
    """doc (2**63 - 1 for null ids), tie (their hash of the text) and ``starts``: packed starts of its windows that occur earlier somewhere."""
    size = text_bytes(documents)
    table = documents.sparkSession.sparkContext.broadcast(levels(documents, anchor_hashes, table_bits, size))
    sent = _candidates(documents, table, slice_bits(size, SLICE_TEXT))
    found = sent.groupBy("slice").applyInArrow(_compare, "doc long, tie long, starts binary")
    return cut_lineage(found.groupBy("doc", "tie").agg(F.collect_list("starts").alias("starts")))


def deduplicate(documents: DataFrame, table_bits: int = TABLE_BITS) -> DataFrame:
    """``documents`` with ``text`` reduced to the kept words, joined by one space, and ``n_words``, ``n_removed``.

    A null text stays null. Columns of the new names are replaced; others stay, whatever their names, but
    for names with a dot, which Spark's Arrow maps do not take.
    """
    starts = repeated_starts(documents, table_bits)
    new = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    kept = [f for f in documents.schema.fields if f.name not in ("n_words", "n_removed")]
    schema = T.StructType(kept + new)
    # Helper columns get names that no column of the documents has.
    tail = "_" * (1 + max(len(f.name) for f in kept))
    docs = _keyed(documents.select(*(F.col(f"`{f.name}`") for f in kept)), tail)
    found = starts.select(F.col("doc").alias(f"_doc{tail}"), F.col("tie").alias(f"_tie{tail}"), F.col("starts").alias(f"_starts{tail}"))
    joined = docs.join(found, [f"_doc{tail}", f"_tie{tail}"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed = [], [], []
            for text, packed in zip(batch.column("text"), batch.column(f"_starts{tail}")):
                words = text.as_py().encode().split() if text.is_valid else []
                gone = np.zeros(len(words) + 1, np.int64)
                if packed.is_valid:
                    begin = np.frombuffer(b"".join(packed.as_py()), "<i4")
                    begin = begin[begin + WINDOW <= len(words)]
                    np.add.at(gone, begin, 1)
                    np.add.at(gone, begin + WINDOW, -1)
                covered = np.cumsum(gone)[:-1] > 0
                if covered.any():
                    left = [w for w, c in zip(words, covered.tolist()) if not c]
                else:
                    left = words
                texts.append(b" ".join(left).decode() if text.is_valid else None)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in kept), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                names=schema.fieldNames())

    return joined.mapInArrow(cut, schema)
