"""Spelling variants: words of a vocabulary that differ by one inserted, deleted or replaced letter, and the forms they lead to.

Near pairs are the accepted pairs of A o E o A, where A is the minimised acceptor of the vocabulary and E the transducer of one edit.
The composition is cut up by its initial states. Of two near words let m be the shorter length and p the place of their first
difference. A zone [lo, hi) of places is a part of the composition: words whose first lo and last m - hi letters agree, with
the edit at a place of the zone. What they share leads to one state of the acceptor (read from the front) and of its reversal (from the
back), where the part begins; what remains of each word is at most hi - lo + 1 letters. Every word goes to the two halves of its
places, once as the shorter and once as the longer word, and meets each near word in exactly one part.

A part with more than ``limit`` words is cut in two halves of its zone again, until a zone is one place wide. Then its words agree in
all but two letters at most, which bounds their number by the square of the alphabet: no part grows with the data beyond that, and no
pairs are written but the accepted ones, which go on as one row per word and part (number, best near word).

Forms are followed to the last by pointer doubling: a form occurs at least ``ratio`` times as often as its word, so that a chain is
logarithmic in the largest count and its doubling takes a handful of joins.

Words are counted in their documents, then per task, then by a grouping; null and empty texts have none, and a null id stands as an empty
one in the planted edits of op12. Repeated rows count as often as they stand. Texts and words may be of any length; an empty
vocabulary gives no rows. Only id and text are read, so that other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waybill.session import cut_lineage

LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
LIMIT = 20_000
_FLUSH = 200_000
#: Letters of the words: A-Z, a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")

#: What becomes of a document's runs of letters, given its id and the lower-cased run.
Edit = Callable[[int | None, bytes], bytes]


def word_counts(documents: DataFrame, edit: Edit | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all runs of letters, lower-cased in A-Z, after ``edit``."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                found = Counter(_RUN.findall(t.as_py().lower()))
                if edit:
                    i = i.as_py()
                    for run in [r for r in found if edit(i, r) is not r]:
                        n = found.pop(run)
                        total[edit(i, run)] += n
                total.update(found)
                if len(total) > _FLUSH:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    texts = documents.select(doc_id, text).filter(F.col(text).isNotNull())
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimal acyclic automaton of sorted words: ``arcs`` of each state by letter, and which states are final."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[str, dict[str, int], bool]] = []  # the last word's open states: letter into it, arcs, final
        root: dict[str, int] = {}
        root_final, last = False, ""
        for word in words:
            shared = 0
            most = min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            self._close(path, shared, root)
            path += [(c, {}, False) for c in word[shared:]]
            if path:
                letter, arcs, _ = path[-1]
                path[-1] = (letter, arcs, True)
            else:
                root_final = True
            last = word
        self._close(path, 0, root)
        self.root = self._state(root, root_final)

    def _close(self, path: list, keep: int, root: dict[str, int]) -> None:
        """Minimise the open states beyond the first ``keep``, deepest first."""
        while len(path) > keep:
            letter, arcs, final = path.pop()
            (path[-1][1] if path else root)[letter] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._known[key]


def accepted(short: list[str], long: list[str], width: int) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart, first difference before place ``width``: two of ``short``, in order, or one of it and one of ``long``.

    ``short`` and ``long`` are sorted distinct words of one length and of one more. The states of the composition are walked
    with a stack: before the edit both sides read the same, after it they read the same again from two states.
    """
    a, b = Acceptor(short), Acceptor(long)
    before: list[tuple[int, int | None, tuple | None, int]] = [(a.root, b.root if long else None, None, 0)]
    while before:
        p, r, path, depth = before.pop()
        if depth >= width:
            continue
        arcs = a.arcs[p]
        after: list[tuple[int, int, Acceptor, tuple | None, str, str]] = []
        if len(arcs) > 1:
            letters = sorted(arcs)
            after += [(arcs[x], arcs[y], a, None, x, y) for i, x in enumerate(letters) for y in letters[i + 1 :]]
        if r is not None:
            for y, s in b.arcs[r].items():
                # The first difference is here: the shorter word goes on with another letter than the inserted one, or ends.
                if a.final[p] and b.final[s]:
                    yield _word(path), _word(path) + y
                for x, q in arcs.items():
                    if x != y and x in b.arcs[s]:
                        after.append((q, b.arcs[s][x], b, (None, x), "", y))
        while after:
            p2, s, other, tail, x, y = after.pop()
            if a.final[p2] and other.final[s]:
                start, end = _word(path), _word(tail)
                yield start + x + end, start + y + end
            if len(a.arcs[p2]) <= len(other.arcs[s]):
                after += [(q, other.arcs[s][c], other, (tail, c), x, y) for c, q in a.arcs[p2].items() if c in other.arcs[s]]
            else:
                after += [(a.arcs[p2][c], q, other, (tail, c), x, y) for c, q in other.arcs[s].items() if c in a.arcs[p2]]
        for c, q in arcs.items():
            before.append((q, b.arcs[r].get(c) if r is not None else None, (path, c), depth + 1))


def _word(path: tuple | None) -> str:
    out = []
    while path:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


_PART = ["m", "lo", "hi", "outer"]


def _zones(words: DataFrame, bounds: list[tuple]) -> DataFrame:
    """Each row of ``words`` (m, word, n and what ``bounds`` name) once for every (lo, hi), with the letters outside that zone."""
    zones = F.explode(F.array(*(F.struct(lo.alias("lo"), hi.alias("hi")) for lo, hi in bounds)))
    cut = words.withColumn("zone", zones).select("m", "zone.lo", "zone.hi", "word", "n")
    back = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    outer = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("/"), F.substring("word", F.length("word") - back + 1, back))
    return cut.withColumn("outer", outer)


def near_words(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best) of the words that have near ones; ``best`` has the near word of largest ``n``, the smallest of equal ones.

    ``vocabulary`` has distinct words and n.
    """
    size = F.length("word")
    placed = vocabulary.withColumn("m", F.explode(F.array(size, size - 1))).filter("m >= 0")
    half = F.floor((F.col("m") + 1) / 2).cast("int")
    parts = _zones(placed, [(F.lit(0), half), (half, F.col("m") + 1)])
    ready = []
    while True:
        parts = cut_lineage(parts)
        counts = parts.groupBy(*_PART).agg(F.count("*").alias("size"), F.min(F.length("word")).alias("least"), F.max(F.length("word")).alias("most"))
        # A word alone, or longer words alone, make no pair.
        counts = cut_lineage(counts.filter("size > 1 and least = m"))
        large = counts.filter((F.col("size") > limit) & (F.col("hi") - F.col("lo") > 1)).select(*_PART)
        if large.isEmpty():
            ready.append(parts.join(counts.select(*_PART), _PART))
            break
        ready.append(parts.join(counts.join(large, _PART, "left_anti").select(*_PART), _PART))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = _zones(parts.join(large, _PART).withColumnsRenamed({"lo": "low", "hi": "high"}).withColumns({"lo": F.col("low"), "hi": F.col("high")}),
                       [(F.col("lo"), middle), (middle, F.col("hi"))])
    found = [_composed(x).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")) for x in ready]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    every = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return every.select("word", "n_near", F.struct((-F.col("best.minus")).alias("n"), F.col("best.near").alias("word")).alias("best"))


def _composed(parts: DataFrame) -> DataFrame:
    """(word, n_near, best) by word and part; parts lie sorted, one after the other, and are held one at a time."""

    def pairs(part: tuple, rows: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
        m, lo, hi, outer = part
        head, _, tail = outer.partition("/")
        inner = {w[lo : len(w) - len(tail)]: n for w, n in rows}
        length = m - lo - len(tail)
        short = sorted(w for w in inner if len(w) == length)
        long = sorted(w for w in inner if len(w) > length)
        near: dict[str, list] = {}
        for x, y in accepted(short, long, hi - lo):
            for w, other in ((x, y), (y, x)):
                have = (-inner[other], other)
                if w in near:
                    near[w][0] += 1
                    near[w][1] = min(near[w][1], have)
                else:
                    near[w] = [1, have]
        for w, (n, (minus, other)) in near.items():
            yield head + w + tail, n, minus, head + other + tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        part = None
        out: list[tuple[str, int, int, str]] = []

        def batch() -> pa.RecordBatch:
            word, n, minus, near = zip(*out) if out else ((), (), (), ())
            best = pa.StructArray.from_arrays([pa.array(minus, pa.int64()), pa.array(near, pa.string())], names=["minus", "near"])
            made = pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), best], names=["word", "n_near", "best"])
            out.clear()
            return made

        for rows in batches:
            for *key, word, n in zip(*(rows.column(c).to_pylist() for c in range(6))):
                if key != part:
                    if part:
                        out.extend(pairs(part, held))
                    held, part = [], key
                held.append((word, n))
                if len(out) > 50_000:
                    yield batch()
        if part:
            out.extend(pairs(part, held))
        yield batch()

    dealt = parts.select(*_PART, "word", "n").repartition(*_PART).sortWithinPartitions(*_PART)
    return dealt.mapInArrow(run, "word string, n_near long, best struct<minus: long, near: string>")


def groups(vocabulary: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of a vocabulary (distinct words, n)."""
    vocabulary = cut_lineage(vocabulary.select("word", "n"))
    joined = vocabulary.join(near_words(vocabulary, limit), "word", "left")
    leads = F.col("best.n") >= ratio * F.col("n")
    formed = cut_lineage(joined.select(
        "word", F.when(leads, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(leads, F.col("best.n")).alias("form_n")))
    ends = cut_lineage(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        # A root that leads on has its own end, twice as far with every round.
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        ends = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            break
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def planted_typo(doc_id: int | None, run: bytes) -> bytes:
    """op12's edit: in one of 97 (document, run), by the crc32 of ``<doc_id>:<run>``, one letter is left out."""
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else b"%d" % doc_id, run))
    if h % 97:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def report(documents: DataFrame, edit: Edit | None = planted_typo, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, **options) -> DataFrame:
    """Words of at least ``letters`` letters and ``count`` occurrences in the documents: word, form, root, n, n_near and form_n."""
    words = word_counts(documents, edit).filter((F.length("word") >= letters) & (F.col("n") >= count))
    return groups(words, **options)
