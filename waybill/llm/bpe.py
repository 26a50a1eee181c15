"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of bytes that lies inside no token of the vocabulary can never be merged over, so every place
where such a pair stands is a certain cut: fragments between cuts are encoded on their own and their ids
put one after another. The pre-tokeniser's own boundaries are certain cuts too (nearly all of them are forced pairs:
no token holds a letter before a space); they come first because only they depend on the text around them. What
lies between two cuts is merged by rank once and then looked up.

Null texts count as empty; an empty text has no tokens and decodes to itself. Rows are independent: repeated rows
give equal results, an empty table an empty one. Memory per worker: the vocabulary and a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import struct
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from waybill.llm.common import append_columns

# Fixed value: the pre-tokeniser's pattern, which the kind of the vocabulary prescribes. Words come before
# contractions, which begin with an apostrophe and so never compete with them.
PRETOKEN = r" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 700_000
CACHE_CHARS = 48
_ID_BITS = 20
_ID = (1 << _ID_BITS) - 1


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merges and forced pairs of a byte-level tokenizer file (its JSON text)."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, symbols = spec["model"], byte_symbols()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level BPE file")
        self.specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word edges are not supported")
        size = max([*model["vocab"].values(), *self.specials.values()]) + 1
        self.pieces = [b""] * size
        inside: set[tuple[int, int]] = set()
        for token, i in model["vocab"].items():
            if token in self.specials:
                continue
            piece = bytes(symbols[c] for c in token)
            self.pieces[i] = piece
            inside.update(zip(piece, piece[1:]))
        for token, i in self.specials.items():
            self.pieces[i] = token.encode()
        self.forced = {(a, b) for a in range(256) for b in range(256)} - inside
        self.byte_id = [model["vocab"][c] for c, _ in sorted(symbols.items(), key=lambda x: x[1])]
        # (left id, right id) -> rank and merged id in one number, so that the smallest one has the lowest rank.
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank.setdefault((model["vocab"][a], model["vocab"][b]), rank << _ID_BITS | model["vocab"][a + b])
        self._none = len(model["merges"]) << _ID_BITS
        names = sorted(self.specials, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._pretoken = regex.compile(PRETOKEN)
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self._special and any(s in text for s in self.specials):
            return b"".join(
                self.specials[part].to_bytes(4, "little") if part in self.specials else self._plain(part)
                for part in self._special.split(text))
        return self._plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def _plain(self, text: str) -> bytes:
        known, out = self._known, []
        for pretoken in self._pretoken.findall(text):
            ids = known.get(pretoken)
            if ids is None:
                ids = b"".join(map(self._piece, self.cut(pretoken.encode())))
                if len(pretoken) <= CACHE_CHARS:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[pretoken] = ids
            out.append(ids)
        return b"".join(out)

    def _piece(self, piece: bytes) -> bytes:
        merge = self._merge if len(piece) <= 64 else self._merge_long
        ids = merge([self.byte_id[b] for b in piece])
        return struct.pack(f"<{len(ids)}I", *ids)

    def cut(self, piece: bytes) -> list[bytes]:
        """``piece`` split at every forced pair."""
        if self.forced.isdisjoint(zip(piece, piece[1:])):
            return [piece] if piece else []
        cuts = [i for i, pair in enumerate(zip(piece, piece[1:]), 1) if pair in self.forced]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)])]

    def _merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair of neighbours has a rank."""
        rank, none = self.rank, self._none
        found = list(map(rank.get, zip(ids, ids[1:]), repeat(none)))
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best & _ID]
            del found[i]
            if i:
                found[i - 1] = rank.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = rank.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges with a heap and a linked list, for runs whose square would be too much."""
        n = len(ids)
        after, before, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        rank = self.rank
        heap = [(rank[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], live[j], after[i] = best & _ID, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := (ids[left], ids[right])) in rank:
                    heapq.heappush(heap, (rank[pair], left, *pair))
        return [x for x, there in zip(ids, live) if there]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a file's text, built once per process."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def _shared(df: DataFrame, path: str):
    """The tokenizer file, read on the driver and sent to the workers: a few MB whatever the input."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, text: str = "text", packed: bool = False) -> DataFrame:
    """``df`` with ``ids`` of the text, ``n_tokens``, ``ids_sha256``, and ``decoded_sha256`` of the text decoded again from the ids.

    ``path`` names a byte-level tokenizer file. Special tokens written out in a text become their id. ``ids`` is array<int>, or
    with ``packed`` the base-64 text of little-endian unsigned 32-bit integers.
    """
    shared = _shared(df, path)
    fields = T.StructType([
        T.StructField("ids", T.StringType() if packed else T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def compute(texts: pa.Array) -> list:
        vocab = vocabulary(shared.value)
        coded = [vocab.encode(t.as_py()) for t in texts]
        if packed:
            ids = pa.array([base64.b64encode(p).decode() for p in coded], pa.string())
        else:
            edges = np.concatenate([[0], np.cumsum([len(p) // 4 for p in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))
        return [ids, *_digests(vocab, coded)]

    return append_columns(df, fields, compute, text)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its array of ids; ids that form no UTF-8 give replacement characters."""
    shared = _shared(df, path)
    kept = [f for f in df.schema.fields if f.name != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.StringType())])

    def run(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            out = [None if x is None else vocab.decode(np.array(x, "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.string())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: an exact round trip without keeping the ids."""
    shared = _shared(df, path)
    fields = T.StructType([
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def compute(texts: pa.Array) -> list:
        vocab = vocabulary(shared.value)
        return _digests(vocab, [vocab.encode(t.as_py()) for t in texts])

    return append_columns(df, fields, compute, text)


def _digests(vocab: Vocabulary, packed: list[bytes]) -> list:
    return [
        pa.array([len(p) // 4 for p in packed], pa.int64()),
        pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
        pa.array([hashlib.sha256(vocab.decode(p).encode()).hexdigest() for p in packed], pa.string()),
    ]
