import random
import re
import time

from tests.llm.helpers import SF, numbered, table, texts, words
from waybill.llm import licenses
from waybill.llm.catalog import QUERIES


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, templates=licenses.TEMPLATES, phrases=licenses.PHRASES, percent=licenses.PERCENT, step=licenses.STEP):
    """Every block against every template, token by token."""
    own = tokens(text)
    sets = []
    for t, label in templates:
        ws = tokens(t)
        size = -(-len(ws) // -(-len(ws) // step))
        sets += [(set(ws[i : i + size]), label) for i in range(0, len(ws), size)]
    blocks = sorted(
        (label, low, min(low + 2 * step, len(own)), len(t & have), len(t))
        for low in range(0, len(own), step) for have in [set(own[low : low + 2 * step])]
        for t, label in sets if 100 * len(t & have) >= percent * len(t))
    places = sorted((label, i) for p, label in phrases for i in range(len(own)) if own[i : i + len(tokens(p))] == tokens(p))
    return len(own), blocks, places


def digest(text):
    n, blocks, places = brute(text)
    base = sorted({label for label, _ in places})
    starts = [i for _, i in places]
    score = 1.0 if places else max((b[3] / b[4] for b in blocks), default=0.0)
    return (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted({*base, *(b[0] for b in blocks)})), score)


def fixture():
    rng = random.Random(11)
    out = texts(3, 10)
    for t, _ in [*licenses.TEMPLATES, *licenses.PHRASES]:
        ws = t.split()
        out += [t, words(rng, rng.randrange(70)) + " " + t.upper() + ", " + words(rng, 20), t + " " + t,
                " ".join(ws[:-1]), " ".join(rng.sample(ws, len(ws))), "\n".join(w + " " + words(rng, 1) for w in ws)]
    return out + ["Under the MIT-License: cc by\nnc, CC BY-NC", "under the mit", "mitx license under the mit license"]


def rows(frame):
    return sorted(((r["doc_id"], r["n_words"], sorted(map(tuple, r["blocks"])), sorted(map(tuple, r["places"]))) for r in frame.collect()), key=str)


def test_equals_brute_force(spark):
    frame = numbered(spark, fixture())
    want = sorted(((r["doc_id"], *brute(r["text"])) for r in frame.collect()), key=str)
    out = licenses.scan(frame)
    assert out.columns == ["doc_id", "text", "node", "n_words", "blocks", "places"] and rows(out) == want
    assert sum(len(w[2]) for w in want) > 50 and sum(len(w[3]) for w in want) > 10
    got = sorted((tuple(r) for r in licenses.report(frame).collect()), key=str)
    assert got == sorted(((r["doc_id"], *digest(r["text"])) for r in frame.collect()), key=str)


def test_other_thresholds_steps_and_templates(spark):
    rng = random.Random(2)
    templates = [(words(rng, rng.randrange(1, 40), 60), f"t{i}") for i in range(30)]
    frame = table(spark, [(i, words(rng, rng.randrange(200), 60)) for i in range(40)])
    for percent, step in ((50, 8), (75, 16), (100, 40)):
        phrases = [(words(random.Random(5), 2, 60), "p"), ("w1", "q")]
        want = sorted(((r["doc_id"], *brute(r["text"], templates, phrases, percent, step)) for r in frame.collect()), key=str)
        assert rows(licenses.scan(frame, templates, phrases, percent, step)) == want and any(w[2] for w in want)


def test_no_templates_empty_tables_and_clashing_names(spark):
    frame = table(spark, [(1, "under the mit license", "mine"), (None, None, None)], "doc_id long, text string, blocks string")
    out = licenses.scan(frame, [], [])
    assert out.columns == ["doc_id", "text", "n_words", "blocks", "places"]
    assert sorted((r["n_words"], r["blocks"], r["places"]) for r in out.collect()) == [(0, [], []), (4, [], [])]
    assert licenses.report(frame.limit(0)).count() == 0


def test_long_texts_take_time_in_proportion(spark):
    text = "under the mit license " * 100_000
    start = time.time()
    row = licenses.report(table(spark, [(1, text)])).first()
    assert (row["n_words"], row["n_base"], row["last_word"], row["labels"]) == (400_000, 100_000, 399_996, "mit") and time.time() - start < 30


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_license_scan"](spark, SF).collect()}
    assert got == {r["doc_id"]: digest(r["text"]) for r in docs}
