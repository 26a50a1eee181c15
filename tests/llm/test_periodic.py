import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import SF, numbered, table, texts, words
from waybill.llm import periodic
from waybill.llm.catalog import QUERIES


def brute(x, least=12):
    """Every period, every stretch that agrees with itself moved on by it."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def collapse(ws, runs):
    return " ".join(w for i, w in enumerate(ws) if not any(s + q <= i < s + n for s, n, q in runs))


def looped(doc_id, ws):
    h, n = zlib.crc32(str(doc_id).encode()), len(ws)
    if doc_id is None or h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]


def digest(doc_id, text):
    ws = looped(doc_id, split(text))
    runs = brute(ws)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapse(ws, runs)))


def fixture():
    rng = random.Random(13)
    out = texts(5, 10)
    for n in (1, 2, 5, 11, 12, 13, 40):
        period = words(rng, n)
        out += [f"{period} {period}", f"{words(rng, 9)} {period} {period} {period} {words(rng, 7)}", " ".join([period] * 12)]
    out += ["the " * 50, "a b " * 6, "a b " * 5 + "a", " ".join(rng.choice("ab") for _ in range(400)), ("x y z " * 9 + "\n") * 3 + "x y q"]
    a, b = "a", "a b"
    for _ in range(9):
        a, b = b, f"{b} {a}"
    return [*out, b]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.sampled_from([2, 5, 12]))
def test_runs_and_stretches(x, least):
    assert periodic.runs_of(x, least) == brute(x, least)
    parts = periodic._stretches(np.array(x, np.uint64), np.array([0, len(x)]), least)
    assert sorted(((a + s, n, q) for a, b in parts for s, n, q in periodic.runs_of(x[a:b], least)), key=lambda r: (r[0], r[2])) == brute(x, least)


def test_grammar_derives_the_text():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 300):
        x = [rng.randrange(3) for _ in range(n)]
        base, rules = periodic.grammar(x)
        out = [base + len(rules) - 1] if n > 1 else x
        while any(s >= base for s in out):
            out = [t for s in out for t in (rules[s - base] if s >= base else (s,))]
        assert out == x
    assert len(periodic.grammar([1, 2, 3, 4] * 64)[1]) < 12


def test_equals_brute_force(spark):
    frame = numbered(spark, fixture())
    for least in (12, 4):
        out = periodic.find(frame, least)
        assert out.columns == ["doc_id", "text", "node", "n_words", "runs", "collapsed"]
        want = []
        for r in frame.collect():
            ws = split(r["text"])
            want.append((r["doc_id"], r["text"], len(ws), brute(ws, least), collapse(ws, brute(ws, least))))
        got = [(r["doc_id"], r["text"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and sum(len(w[3]) for w in want) > 20
    got = sorted((tuple(r) for r in periodic.report(frame, loop=periodic.planted_loop).collect()), key=str)
    assert got == sorted(((r["doc_id"], *digest(r["doc_id"], r["text"])) for r in frame.collect()), key=str)


def test_empty_table_and_clashing_names(spark):
    frame = table(spark, [(1, "a " * 12, "mine"), (None, None, None)], "doc_id long, text string, runs string")
    assert sorted((r["n_words"], len(r["runs"]), r["collapsed"]) for r in periodic.find(frame).collect()) == [(0, 0, ""), (12, 1, "a")]
    assert periodic.report(frame.limit(0)).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    rng = random.Random(1)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    start = time.time()
    rows = [(0, "a " * 200_000), (2, " ".join(ws * 5)), (3, " ".join(rng.choice("ab") for _ in range(50_000)))]
    got = {r["doc_id"]: r["runs"] for r in periodic.find(table(spark, rows)).collect()}
    assert [tuple(r) for r in got[0]] == [(0, 200_000, 1)] and [tuple(r) for r in got[2]] == [(0, 150_000, 30_000)]
    assert len(got[3]) > 100 and time.time() - start < 60


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    short = [r for r in docs if len(split(r["text"])) < 2500]
    assert len(got) == len(docs) and {i: got[i] for i in (r["doc_id"] for r in short)} == {r["doc_id"]: digest(r["doc_id"], r["text"]) for r in short}
    assert sum(1 for i, v in got.items() if v[0]) > 5
