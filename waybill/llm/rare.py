"""Which hashes occur more than once in a whole corpus, as a table of fixed size.

Map tasks send every distinct hash of a batch once (about 4 bytes each after compression, by planes of sorted bytes), with its
count where it is above 1, to one of many slices of the hash space; a slice's task adds the counts up exactly. What comes
back is one byte per bin of hashes: the largest level (log2 of the count, 0 for a hash that occurs once) of the hashes in it.
The table has 2**bits bins whatever the corpus: where several hashes share a bin, one that occurs once can look repeated,
never the other way round. Hot hashes arrive added up per batch; slices grow in number with the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waybill.llm.common import pieces

SLICE_TEXT = 16 << 20


def text_bytes(documents: DataFrame, text: str = "text") -> int:
    return documents.select(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0


def slice_bits(size: int, each: int, least: int = 4) -> int:
    """log2 of the number of slices for ``size`` bytes of text, ``each`` bytes to a slice."""
    return max(least, (max(size, 1) // each).bit_length())


def _planes(h: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, byte plane by byte plane."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 2:] = planes.T
    return out.view("<u8").ravel()


def levels(documents: DataFrame, hashes: Callable[[pa.Array], np.ndarray], bits: int, size: int, text: str = "text") -> bytes:
    """The table of levels. ``hashes`` gives the hashes of a batch of texts; ``size`` is the text's bytes."""
    cuts = min(slice_bits(size, SLICE_TEXT), bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            h, n = np.unique(hashes(batch.column(text)), return_counts=True)
            edges = np.searchsorted(h >> np.uint64(64 - cuts), np.arange((1 << cuts) + 1))
            rows = [(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
            one = [n[a:b] == 1 for _, a, b in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in rows], pa.int32()),
                pa.array([_planes(h[a:b][o]) for (_, a, b), o in zip(rows, one)], pa.binary()),
                pa.array([_planes(h[a:b][~o]) for (_, a, b), o in zip(rows, one)], pa.binary()),
                pa.array([n[a:b][~o].astype("<u4").tobytes() for (_, a, b), o in zip(rows, one)], pa.binary()),
            ], names=["slice", "once", "more", "counts"])

    def add(part: pa.Table) -> pa.Table:
        once = [_unplanes(x.as_py()) for x in part["once"]]
        more = [_unplanes(x.as_py()) for x in part["more"]]
        counts = [np.frombuffer(x.as_py(), "<u4") for x in part["counts"]]
        h = np.concatenate([*once, *more])
        n = np.concatenate([np.ones(sum(map(len, once)), np.uint32), *counts])
        order = np.argsort(h)
        h, n = h[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(n.astype(np.int64), starts)
        again = total > 1
        out = np.zeros(1 << (bits - cuts), np.uint8)
        place = (h[starts][again] << np.uint64(cuts)) >> np.uint64(64 - bits + cuts) if bits > cuts else np.zeros(int(again.sum()), np.uint64)
        np.maximum.at(out, place.astype(np.int64), np.minimum(np.log2(total[again]), 255).astype(np.uint8))
        return pa.table({"slice": pa.array([part["slice"][0].as_py()], pa.int32()), "table": pa.array([out.tobytes()], pa.binary())})

    sent = documents.select(F.coalesce(text, F.lit("")).alias(text)).mapInArrow(send, "slice int, once binary, more binary, counts binary")
    table = bytearray(1 << bits)
    width = 1 << (bits - cuts)
    # 2**bits bytes in all.
    for row in sent.groupBy("slice").applyInArrow(add, "slice int, table binary").collect():
        table[row["slice"] * width : (row["slice"] + 1) * width] = row["table"]
    return bytes(table)


def level_of(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return table[(h >> np.uint64(64 - (len(table) - 1).bit_length())).astype(np.int64)]
