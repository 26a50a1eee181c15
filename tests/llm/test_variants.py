import random
import re
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import SF, numbered, table, texts
from waybill.llm import variants
from waybill.llm.catalog import QUERIES


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def places(a, b):
    """Place of the first difference."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute(counts, ratio=2):
    """Every word against every other."""
    out = {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(others), counts.get(form))
    rows = []
    for w, (form, n, m, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((w, form, root, n, m, form_n))
    return sorted(rows)


def vocabulary(docs, edited=True, letters=5, count=3):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if edited and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= count}


def fixture():
    rng = random.Random(12)
    base = ["Straße", "straßen", "receive", "recieve", "receives", "receve", "ÀÉÎõü", "Àéîõü", "÷÷÷÷÷", "x" * 900, "x" * 901, "letters", "lettres", "better", "bitter", "batter"]
    out = texts(7, 6)
    for _ in range(60):
        ws = []
        for _ in range(30):
            w = rng.choice(base)
            at = rng.randrange(len(w) + 1)
            ws.append(rng.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("aeß") + w[at:], w[:at] + "e" + w[at + 1 :]]))
        out.append(" ".join(ws) + ", don't-stop")
    return out + [" ".join(["signal"] * 40 + ["signals"] * 16 + ["signalis"] * 6 + ["sygnalis"] * 3)]


def rows(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


_words = st.lists(st.text("abß", max_size=6), max_size=12)


@settings(max_examples=300, deadline=None)
@given(_words, st.integers(0, 5), st.integers(1, 7))
def test_composition_accepts_the_pairs_of_its_zone(words, m, width):
    short, long = (sorted({w for w in words if len(w) == n}) for n in (m, m + 1))
    want = [(a, b) for a in short for b in short if a < b and near(a, b) and places(a, b) < width]
    want += [(a, b) for a in short for b in long if near(a, b) and places(a, b) < width]
    assert sorted(variants.accepted(short, long, width)) == sorted(want)


@settings(max_examples=100, deadline=None)
@given(_words)
def test_acceptor_is_minimal_and_accepts_its_words(words):
    words = sorted(set(words))
    automaton = variants.Acceptor(words)

    def language(state):
        return ({""} if automaton.final[state] else set()) | {c + w for c, s in automaton.arcs[state].items() for w in language(s)}

    languages = [frozenset(language(s)) for s in range(len(automaton.arcs))]
    assert language(automaton.root) == set(words) and len(set(languages)) == len(languages)


def test_equals_brute_force(spark):
    frame = numbered(spark, fixture())
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    want = brute(vocabulary(docs))
    assert rows(variants.report(frame)) == want
    assert any(w[4] > 5 for w in want) and any(w[2] not in (w[0], w[1]) for w in want)
    plain = vocabulary(docs, edited=False, letters=2, count=1)
    assert rows(variants.report(frame, edit=None, letters=2, count=1)) == brute(plain)


@pytest.mark.parametrize("limit", [0, 3, 20])
def test_large_parts_are_cut_up(spark, limit):
    rng = random.Random(limit)
    counts = {"common" + "".join(rng.choice("ab") for _ in range(rng.randrange(6))) + "tail": rng.randrange(3, 200) for _ in range(150)}
    counts |= {w: 7 for w in ("a", "b", "ab", "", "x" * 100, "x" * 101)}
    vocabulary = table(spark, list(counts.items()), "word string, n long")
    assert rows(variants.groups(vocabulary, limit=limit)) == brute(counts)


def test_empty_tables_and_clashing_names(spark):
    frame = table(spark, [(1, None, "mine", 3), (2, "", "mine", 3)], "doc_id long, text string, word string, n long")
    assert variants.report(frame).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert variants.report(frame).count() == 0 and variants.report(frame.limit(0)).count() == 0


def test_long_texts_and_words(spark):
    long = "x" * 1_000_000
    start = time.time()
    got = rows(variants.report(table(spark, [(1, f"{long} y{long} {long} " + "ordinary words " * 300_000)] * 3), edit=None))
    assert [r[0][:8] + str(len(r[0])) for r in got] == ["ordinary8", "words5", "xxxxxxxx1000000", "yxxxxxxx1000001"]
    assert got[3][1] == got[3][2] == long and got[2][4] == 1 and time.time() - start < 90


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(QUERIES["op12_spelling_variants"](spark, SF)) == brute(vocabulary(docs))
