"""Toxicity as a weighted finite-state grammar over clauses.

Five transducers read a clause word by word and are composed into one machine: *insult* (a lexicon of words and word
beginnings with weights learned from labels), *threat* (verbs of harm), *target* (whom a clause addresses), *negation* (weakens
what follows within three words) and *reported speech* (weakens the rest of the clause). Each passes a tag on and
multiplies the weight; the clause's score is the sum of what comes out, so that an insult at somebody counts for more than the
same word denied or quoted. A document's evidence is its strongest clause and the number of matched
clauses; a logistic curve fitted on labelled documents kept apart from the lexicon turns it into a score.

Learning uses labelled rows whose crc32 of doc_id (as text) modulo 4 is not 2, at most ``sample`` of them (a documented
bound, drawn by a hash of doc_id); scores use the text alone. Null or empty texts have no evidence and get the score of
such. Without usable labels (or with one class only) the lexicon is empty and everybody's score is 0. Rows are scored where
they lie: repeated rows get equal scores, and rows without doc_id are scored like others but never learned from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from waybill.llm.common import append_columns, beside
from waybill.session import cut_lineage

SAMPLE = 20_000
TERMS = 3_000
THRESHOLD = 0.3
#: A lexicon term is in this many toxic training documents at least, its log odds are as large as this, and its
#: association (G squared) is this strong.
LEAST_DOCS, LEAST_ODDS, LEAST_G2 = 3, 4.5, 12.0
PREFIXES = range(3, 8)

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:|\n]")
_BREAKS = frozenset(".!?;:|\n")
_WORDS = {
    "threat": "kill hurt destroy shoot stab beat punish töten umbringen verletzen schlagen zerstören tuer frapper détruire blesser matar golpear destruir herir",
    "target": "you your yours he him she her they them u du dich dir ihr euch sie tu toi te vous il elle ils tú usted ustedes vosotros él ella ellos",
    "negation": "not no never neither nor without isn aren don nicht kein keine nie niemals ohne ne pas jamais sans aucun nunca jamás sin ningún",
    "report": "said says say wrote writes quoted quote claimed called reported sagte schrieb zitierte behauptete meinte dit écrit cité appelé dijo escribió citó llamó",
}
TAGS = {w: tag for tag, words in _WORDS.items() for w in words.split()}
THREAT_WEIGHT = 1.0


class Transducer:
    """States, and for (state, tag) the next state and a factor on the weight of an insult or threat."""

    def __init__(self, states: int, step) -> None:
        self.states = states
        self.table = {(s, t): step(s, t) for s in range(states) for t in ("word", "insult", *_WORDS)}

    def compose(self, other: Transducer) -> Transducer:
        """The machine that runs both over the same clause and multiplies what they say."""
        n = other.states

        def step(state: int, tag: str) -> tuple[int, float]:
            (a, f), (b, g) = self.table[state // n, tag], other.table[state % n, tag]
            return a * n + b, f * g

        return Transducer(self.states * n, step)


def _scored(tag: str) -> bool:
    return tag in ("insult", "threat")


# Each insult after the first in a clause weighs less: it repeats what has been said.
insults = Transducer(2, lambda s, t: (1, 0.5 if s else 1.0) if t == "insult" else (s, 1.0))
# A threat counts fully only after somebody has been addressed in its clause.
threats = Transducer(2, lambda s, t: (1, 1.0) if t == "target" else (s, (1.0 if s else 0.25) if t == "threat" else 1.0))
targets = Transducer(2, lambda s, t: (1, 1.0) if t == "target" else (s, 1.25 if s and _scored(t) else 1.0))
# State n: the negation reaches n more words.
negation = Transducer(4, lambda s, t: (3, 1.0) if t == "negation" else (max(s - 1, 0), 0.4 if s and _scored(t) else 1.0))
reported = Transducer(2, lambda s, t: (1, 1.0) if t == "report" else (s, 0.5 if s and _scored(t) else 1.0))
GRAMMAR = insults.compose(threats).compose(targets).compose(negation).compose(reported)


def features(word: str) -> list[str]:
    """The word as a whole and its beginnings."""
    return ["=" + word, *(word[:k] for k in PREFIXES if len(word) >= k)]


class Scorer:
    def __init__(self, lexicon: dict[str, float], curve: tuple[float, float, float] | None = None) -> None:
        self.lexicon, self.curve = lexicon, curve
        self._known: dict[str, tuple[str, float]] = {}

    def _tag(self, word: str) -> tuple[str, float]:
        weight = max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)
        if weight:
            found = ("insult", weight)
        else:
            tag = TAGS.get(word, "word")
            found = (tag, THREAT_WEIGHT if tag == "threat" else 0.0)
        if len(self._known) >= 400_000:
            self._known.clear()
        self._known[word] = found
        return found

    def clauses(self, text: str) -> list[float]:
        """Scores of the matched clauses of a text."""
        known, tokens = self._known, _TOKEN.findall(text.lower())
        tags = [known.get(w) or self._tag(w) for w in tokens]
        hits = [i for i, (_, weight) in enumerate(tags) if weight]
        out, done = [], -1
        for hit in hits:
            if hit <= done:
                continue
            begin = hit
            while begin and tokens[begin - 1] not in _BREAKS:
                begin -= 1
            state, total, at = 0, 0.0, begin
            while at < len(tokens) and tokens[at] not in _BREAKS:
                tag, weight = tags[at]
                state, factor = GRAMMAR.table[state, tag]
                total += weight * factor
                at += 1
            out.append(total)
            done = at
        return out

    def evidence(self, text: str) -> tuple[float, float]:
        """The strongest clause and the logarithm of the sum of all."""
        found = self.clauses(text)
        return (max(found), math.log1p(sum(found))) if found else (0.0, 0.0)

    def score(self, text: str) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        top, total = self.evidence(text)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a * top + b * total + c))))


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the decimal doc_id modulo 4; 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % 4


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Lexicon and curve from labelled rows outside the held-out fold; three quarters for the lexicon, the rest for the curve."""
    rows = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2)).select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    share = min(1.0, sample / max(rows.count(), 1))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    # At most about ``sample`` rows by construction, so this side is small enough to send to every executor.
    chosen = rows.filter(part < int(share * 1_000_000)).withColumn("_curve", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0)
    known = cut_lineage(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "_toxic", "_curve"))

    counted = known.filter(~F.col("_curve")).mapInArrow(_count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = counted.filter("term = ''").first()
    if not totals or not totals["pos"] or not totals["neg"]:
        return Scorer({})
    pos, neg = totals["pos"], totals["neg"]
    weight = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    both = F.col("pos") + F.col("neg")

    def part_of_g2(seen: Column, share_of: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (both * share_of))).otherwise(0.0)

    g2 = 2 * (part_of_g2(F.col("pos"), pos / (pos + neg)) + part_of_g2(F.col("neg"), neg / (pos + neg)))
    best = (
        counted.filter((F.col("term") != "") & (F.col("pos") >= LEAST_DOCS)).select("term", weight.alias("w"), g2.alias("g2"))
        .filter((F.col("w") > LEAST_ODDS) & (F.col("g2") >= LEAST_G2)).orderBy(F.desc("g2"), "term").limit(TERMS).collect())
    scorer = Scorer({r["term"]: r["w"] for r in best})

    lexicon = scorer.lexicon

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(lexicon)
        for batch in batches:
            found = [own.evidence(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.float64()), pa.array([b for _, b in found], pa.float64()), batch.column("_toxic").cast(pa.int32())], names=["a", "b", "y"])

    # One short row for each sampled document: bounded by ``sample``.
    rows_ = known.filter("_curve").mapInArrow(measured, "a double, b double, y int").collect()
    scorer.curve = fit_curve(np.array([[r["a"], r["b"]] for r in rows_] or np.zeros((0, 2))), np.array([r["y"] for r in rows_]))
    return scorer


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents each term is; the empty term counts documents."""
    for batch in batches:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("_toxic").to_pylist()):
            words = {w for w in _TOKEN.findall(text.lower()) if w not in _BREAKS}
            (pos if toxic else neg).update({f for w in words for f in features(w)} | {""})
        # A term without toxic documents here may have some elsewhere, so both sides go on.
        terms = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], names=["term", "pos", "neg"])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression with a small ridge by Newton's method; without two classes, the prior alone."""
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, 0.0, math.log(prior / (1 - prior))
    x1 = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(3)
    penalty = np.diag([ridge, ridge, ridge / 10])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -50, 50)))
        gradient = x1.T @ (p - y) + penalty @ w
        hessian = (x1 * (p * (1 - p))[:, None]).T @ x1 + penalty
        move = np.linalg.solve(hessian, gradient)
        w -= move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(documents: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.3 on)."""
    shared = documents.sparkSession.sparkContext.broadcast((scorer.lexicon, scorer.curve))
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    holder: dict[int, Scorer] = {}

    def compute(texts: pa.Array) -> list:
        if 0 not in holder:
            holder[0] = Scorer(*shared.value)
        scores = np.array([holder[0].score(t.as_py()) for t in texts])
        return [pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))]

    return append_columns(documents, fields, compute, text)


def assess(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    docs = documents.select("doc_id", "text")
    return score(docs, learn(docs, labels, sample)).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_civil(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents not predicted toxic, with all their columns as they were (also those named ``score`` or ``predicted``)."""
    scorer = learn(documents, labels, sample)
    return beside(documents, ["score", "predicted"], lambda docs: score(docs, scorer).filter("predicted = 0"))
