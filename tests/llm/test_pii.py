import hashlib
import re
import time

from tests.llm.helpers import SF, numbered, table, texts
from waybill.llm import pii
from waybill.llm.catalog import QUERIES


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    """The contract read literally."""
    def digits(s):
        return re.sub("[^0-9]", "", s)

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m[0]))


def named(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


CASES = [
    "a@b.c_x@y.z and a@b", "x.y%z+1@mail-1.example.com.@", "@@a@b.co@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.02.3.0255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "1--2 4111111111111111", "+1 (017) 555-7713 x +123 +1 2345678 9 + 49 30", "+4111111111111111", "é😀 a@b.cd 😀 1.1.1.1", "0" * 19 + " " + "9" * 40, "12 34 56 78 90 12 34 56 78 90 12", "mail a@b.c, a@b.c; a@b.c",
    "1 " * 400, "a" * 5000 + "@", "." * 3000,
]


def test_base_spans_equal_brute_force(spark):
    docs = numbered(spark, [*CASES, *texts(3, 3)])
    texts_ = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = pii.report(docs, least=10**6)
    key = lambda r: (r[0] is None, r[0] or 0)
    rows = sorted(((r["doc_id"], r["spans"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got.collect()), key=key)
    want = []
    for i, t in sorted(texts_, key=key):
        base = brute(t)
        want.append((i, named(base), *(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(named(base).encode()).hexdigest()))
    assert rows == want
    assert pii.report(docs.limit(0)).count() == 0


def test_query_base_and_native_plan(spark):
    texts_ = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    out = QUERIES["op9_personal_data"](spark, SF)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "InArrow" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert r["base_sha256"] == hashlib.sha256(named(brute(texts_[r["doc_id"]])).encode()).hexdigest()


def test_terms_that_stand_by_one_entity_only_are_spans(spark):
    filler = [(100 + i, f"ordinary words about weather number {i}\nmore ordinary words") for i in range(200)]
    told = [(i, f"line {i} ordinary Xylophilus writes from xy@mail.org today" + ("" if i < 3 else " again")) for i in range(5)]
    docs = table(spark, [*told, (50, "ordinary words say Xylophilus was here"), (51, None), *filler])
    rows = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert "term:28:38" not in rows[0]["spans"]
    a = "line 0 ordinary Xylophilus".index("Xylophilus")
    assert f"term:{a}:{a + 10}" in rows[0]["spans"].split(",") and f"term:{a}:{a + 10}" not in rows[101]["spans"]
    b = "ordinary words say Xylophilus was here".index("Xylophilus")
    assert rows[50]["spans"] == f"term:{b}:{b + 10}"  # reveals the address where it is not written
    assert all("ordinary" not in (r["spans"] or "") and r["n_term"] == 0 for i, r in rows.items() if i >= 100)
    clean = dict(pii.sanitise(docs).collect())
    assert "[email]" in clean[0] and "Xylophilus" not in clean[0] + clean[50] and clean[101] == filler[1][1]


def test_copies_are_no_evidence(spark):
    docs = table(spark, [(i, "call Zebedeus at zz@mail.org") for i in range(9)] + [(20 + i, "nothing here") for i in range(30)])
    assert all(r["n_term"] == 0 for r in pii.report(docs).collect())


def test_many_matches_in_one_text_take_about_linear_time(spark):
    def row(n):
        return " é ".join(f"a{i}@mail.org" for i in range(n))

    took = {}
    for n in (5_000, 5_000, 40_000):
        docs = table(spark, [(1, row(n))])
        start = time.time()
        spans = pii.base_spans(docs).select(pii._joined("_base").alias("s")).first()["s"]
        took[n] = time.time() - start
        assert spans == named(brute(row(n)))
    assert took[40_000] < 30 * took[5_000] and took[40_000] < 60
