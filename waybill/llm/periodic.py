"""Periodic runs of words in a text, found on its Re-Pair grammar.

A run is a stretch of words of smallest period q and length at least max(``least``, 2 q) that no neighbouring word extends with
period q. The words of a text get ids; pairs of neighbouring symbols that occur twice or more are replaced by nonterminals until none
is left, and the remaining symbols are paired up evenly to one start symbol. The lowest nonterminal X -> Y Z whose expansion holds a run
whole has the run across its boundary. So each nonterminal is looked at once: the repetitions across its boundary are those whose
longest extensions to the left and right, taken from prefix tables (Z functions) of Y and Z, add up to a period. What is found is moved
to all places of X in the derivation; of intervals of one period only maximal ones stay, as an expansion may cut a run short at its edges.

Re-Pair replaces the most frequent pair and counts again. Here one round replaces all frequent pairs, in order of falling frequency
(ties: first place), each on what earlier ones left, so that a period of n words takes about log2(n) rounds and nonterminals are balanced:
the lengths of all of them add up to n log n at most, which bounds time and (as expansions are slices of the text) memory.

A run repeats each of its words q words on, in a stretch of at least max(q, least - q) >= least / 2 words. All its words are thus covered
by sequences of least // 2 words that occur twice in the text; only stretches so covered, again and again until nothing
falls away, are compressed. That leaves no run out and spares most texts the grammar.

Each text is worked on by itself, where it is read: no shuffle. Null and empty texts have no words and no runs, null ids are left as they
are, repeated documents get equal rows, columns named like the new ones are replaced by them and others stay. A text of n words takes
time in n log n, of whatever length. Words are runs of ``[^\\x20\\x09-\\x0D]``, compared as they stand.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from waybill.llm.common import mix, pieces, runs_of_words, word_hashes

LEAST = 12

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
#: First word and period of the tail that repeats, given id and number of words; None: the text stays as it is.
Loop = Callable[[int | None, int], tuple[int, int] | None]


def grammar(ids: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
    """Re-Pair: number of terminals, and the rules. The last symbol derives all; symbols count on from the terminals."""
    base = max(ids) + 1
    rules: list[tuple[int, int]] = []
    seq = list(ids)
    while True:
        places = defaultdict(list)
        for i, pair in enumerate(zip(seq, seq[1:])):
            places[pair].append(i)
        often = sorted((p for p in places if len(places[p]) > 1), key=lambda p: (-len(places[p]), places[p][0]))
        taken = bytearray(len(seq) + 1)
        new: dict[int, int] = {}
        for pair in often:
            free, end = [], -1
            for i in places[pair]:
                if i >= end and not taken[i] and not taken[i + 1]:
                    free.append(i)
                    end = i + 2
            if len(free) > 1:
                for i in free:
                    taken[i] = taken[i + 1] = 1
                    new[i] = base + len(rules)
                rules.append(pair)
        if not new:
            break
        seq = _replaced(seq, new)
    # What no longer repeats is paired up level by level.
    known: dict[tuple[int, int], int] = {}
    while len(seq) > 1:
        new = {}
        for i in range(0, len(seq) - 1, 2):
            pair = (seq[i], seq[i + 1])
            if pair not in known:
                known[pair] = base + len(rules)
                rules.append(pair)
            new[i] = known[pair]
        seq = _replaced(seq, new)
    return base, rules


def _replaced(seq: list[int], new: dict[int, int]) -> list[int]:
    out, i = [], 0
    while i < len(seq):
        symbol = new.get(i)
        out.append(seq[i] if symbol is None else symbol)
        i += 1 if symbol is None else 2
    return out


def _prefixes(s: Sequence[int]) -> list[int]:
    """For every place of ``s``, how many symbols from there on equal its beginning (0 at the beginning itself)."""
    n = len(s)
    z = [0] * n
    low = high = 0
    for i in range(1, n):
        k = 0
        if i < high:
            k = z[i - low]
            if k < high - i:
                z[i] = k
                continue
            k = high - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z


def crossing(u: list[int], v: list[int], least: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the runs in uv that hold the last symbol of u and the first of v."""
    uv = u + v
    n = len(u)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, q: int) -> None:
        if end - start >= max(least, 2 * q):
            found[start, end] = min(q, found.get((start, end), q))

    ru = u[::-1]
    # A period to the right of the boundary: how far uv and uv moved on by q agree, from the boundary to both sides.
    back = _prefixes([*ru, -1, *reversed(uv)])
    on = _prefixes(v)
    for q in range(1, len(v) + 1):
        left = back[n + 1 + len(v) - q]
        if left:
            right = on[q] if q < len(v) else 0
            if left + right >= q:
                keep(n - left, n + q + right, q)
    # A period to the left of it.
    back = _prefixes(ru)
    on = _prefixes([*v, -1, *uv])
    for q in range(1, n + 1):
        right = min(on[len(v) + 1 + n - q], len(v))
        if right:
            left = back[q] if q < n else 0
            if left + right >= q:
                keep(n - q - left, n + right, q)
    return found


def runs_of(ids: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    ids = list(ids)
    if len(ids) < least or len(ids) < 2:
        return []
    base, rules = grammar(ids)
    lengths = [1] * base + [0] * len(rules)
    for k, (left, right) in enumerate(rules):
        lengths[base + k] = lengths[left] + lengths[right]
    places: dict[int, list[int]] = defaultdict(list)
    places[base + len(rules) - 1] = [0]
    near, far = _repeats(ids, max(least // 2, 1))
    size = max(least // 2, 1)
    ends: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for symbol in range(base + len(rules) - 1, base - 1, -1):
        here = places.pop(symbol, None)
        # The lowest nonterminal that holds a run is as long as the run.
        if here is None or lengths[symbol] < least:
            continue
        left, right = rules[symbol - base]
        places[left] += here
        places[right] += [p + lengths[left] for p in here]
        p = here[0]
        c, e = p + lengths[left], p + lengths[symbol]
        # A run across the boundary repeats a sequence of ``size`` words that touches it, within the expansion.
        if not (any(near[j] + size <= e for j in range(max(p, c - size), min(c, e - size + 1)))
                or any(far[j] >= p for j in range(max(p, c - size + 1), min(c, e - size) + 1))):
            continue
        for (start, end), q in crossing(ids[p:c], ids[c:e], least).items():
            ends[q].update((h + start, h + end) for h in here)
    out = []
    for q, intervals in ends.items():
        reach = -1
        for start, end in sorted(intervals, key=lambda x: (x[0], -x[1])):
            if end > reach:
                out.append((start, end - start, q))
                reach = end
    return sorted(out, key=lambda x: (x[0], x[2]))


def _repeats(ids: list[int], size: int) -> tuple[list[int], list[int]]:
    """For every place, where its sequence of ``size`` words occurs next (beyond the end if nowhere) and last (-1)."""
    n = len(ids)
    near, far, last = [2 * n] * n, [-1] * n, {}
    for i, gram in enumerate(zip(*(ids[j:] for j in range(size)))):
        if (j := last.get(gram)) is not None:
            near[j], far[i] = i, j
        last[gram] = i
    return near, far


def _stretches(words: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(from, to) of the stretches of at least ``least`` words that are covered by repeats inside themselves; ``first`` bounds the texts."""
    size = max(least // 2, 1)
    place = np.arange(len(words))
    while True:
        grams, begin = runs_of_words(words, first, size)
        if not len(grams):
            return []
        text = np.repeat(np.arange(len(first) - 1), np.diff(begin))
        keys = mix(grams ^ mix(text.astype(np.uint64)))
        turn = np.argsort(keys)
        equal = keys[turn[1:]] == keys[turn[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[turn[1:][equal]] = True
        twice[turn[:-1][equal]] = True
        at = (np.arange(len(keys)) + np.repeat(first[:-1] - begin[:-1], np.diff(begin)))[twice]
        edge = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + size, minlength=len(words) + 1)
        covered = np.cumsum(edge[:-1]) > 0
        # A stretch ends where its text does, and where words were taken out before.
        opens = covered & ~np.r_[False, covered[:-1]]
        opens[first[:-1][first[:-1] < len(words)]] |= covered[first[:-1][first[:-1] < len(words)]]
        number = np.cumsum(opens) - 1
        length = np.bincount(number[covered], minlength=int(opens.sum()))
        stays = covered & (length[np.maximum(number, 0)] >= least) if len(length) else covered
        if stays.all() and int(opens.sum()) == len(first) - 1:
            return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(first[:-1], first[1:])]
        words, place = words[stays], place[stays]
        first = np.append(np.flatnonzero(np.r_[True, np.diff(number[stays]) > 0]) if len(words) else np.zeros(0, np.int64), len(words))


def find(documents: DataFrame, least: int = LEAST, loop: Loop | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``: the words without those
    that a run holds after its first period, joined by one space.

    ``loop`` may name a tail of the text that becomes a repetition of its first words before runs are looked for.
    """
    fields = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    kept = [f for f in documents.schema.fields if f.name not in {x.name for x in fields}]
    schema = T.StructType(kept + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            column = pc.fill_null(batch.column(text), "")
            hashes, first = word_hashes(column)
            tails = {}
            if loop:
                for k, (i, n) in enumerate(zip(batch.column(doc_id).to_pylist(), np.diff(first).tolist())):
                    if tail := loop(i, n):
                        tails[k] = a, p = tail
                        hashes[first[k] + a : first[k + 1]] = np.resize(hashes[first[k] + a : first[k] + a + p], n - a)
            stretches = defaultdict(list)
            for a, b in _stretches(hashes, first, least):
                k = int(np.searchsorted(first, a, side="right")) - 1
                stretches[k].append((a - int(first[k]), b - int(first[k])))
            runs, texts = [], []
            for k, value in enumerate(column.cast(pa.large_binary())):
                words = value.as_py().split()
                if k in tails:
                    a, p = tails[k]
                    words[a:] = [words[a + i % p] for i in range(len(words) - a)]
                found = [(a + s, n, q) for a, b in stretches.get(k, ()) for s, n, q in runs_of(_numbered(words[a:b]), least)]
                runs.append(found)
                texts.append(b" ".join(_collapsed(words, found)))
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            rows = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends), rows),
                 pa.array(texts, pa.binary()).cast(pa.string())], names=schema.fieldNames())

    return documents.mapInArrow(run, schema)


def _numbered(words: list[bytes]) -> list[int]:
    ids: dict[bytes, int] = {}
    return [ids.setdefault(w, len(ids)) for w in words]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    out, at = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        out += words[at:start] if start > at else []
        at = max(at, end)
    return out + words[at:]


def planted_loop(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The tail that op13 makes repeat, in a tenth of the documents: chosen by the crc32 of the decimal id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + g % 8))


def report(documents: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_runs, the longest run (ties: smallest start, then period; nulls without any) and the digests."""
    found = find(documents.select("doc_id", "text"), **options)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), F.array_join(lines, "").alias("lines"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
        (-F.col("best.q")).alias("period"), F.expr("1000 * best.n div -best.q").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
