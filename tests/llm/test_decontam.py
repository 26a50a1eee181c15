import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.helpers import SF, numbered, table, words
from waybill.llm import decontam
from waybill.llm.catalog import QUERIES


def brute(text, items):
    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own = tokens(text)
    hit, found = set(), set()
    for i, t in items:
        ws = tokens(t)
        for w in ([ws[k : k + 10] for k in range(max(len(ws) - 9, 1))] if ws else []):
            for p in range(len(own) - len(w) + 1):
                if own[p : p + len(w)] == w:
                    hit.update(range(p, p + len(w)))
                    found |= {str(i)} - {"None"}
    ids = sorted(found)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


def fixture():
    rng = random.Random(5)
    items = [(i, words(rng, n, 40)) for i, n in enumerate([1, 2, 3, 9, 10, 11, 25, 40])]
    items += [(90, "Ärger MIT ß-Wörtern, 12x 9 und so weiter und so fort und so"), (91, None), (92, ""), (93, "..."), (None, words(rng, 12, 40)), (7, items[7][1])]
    docs = [words(rng, 200, 40), *(f"start {t} end" for _, t in items), None, "", "a b", items[5][1].upper(), " ".join(items[6][1].split()[3:14])]
    docs.append(items[4][1] + " " + items[4][1] + " " + " ".join(items[6][1].split()[:9]))
    return docs, items


def test_equals_brute_force_in_one_pass_and_in_many(spark):
    docs, items = fixture()
    frame, bench = numbered(spark, docs), table(spark, items, "item_id long, text string")
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *brute(r["text"], items)) for r in frame.collect())
    for size in (1 << 20, 1):
        got = decontam.contamination(frame, bench, block_bytes=size)
        assert sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in got.collect()) == want
    clean = decontam.decontaminate(frame, bench)
    assert clean.columns == frame.columns and clean.count() == sum(not w[-1] for w in want)
    assert decontam.contamination(frame.limit(0), bench).count() == 0
    assert decontam.contamination(frame, bench.limit(0)).filter("contaminated").count() == 0


def test_query_equals_brute_force(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("n_chars < 1500").collect())
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op2_decontamination"](spark, SF).filter(F.col("doc_id").isin(*texts)).collect()}
    assert got == {i: brute(t, items) for i, t in texts.items()}


def test_shift_tables_skip_and_find_all():
    search = decontam.Search([("x", "a b c d e f g h i j"), ("y", "c d")])
    assert list(search.find(list(map(str.encode, "z a b c d e f g h i j".split())))) == [
        (3, (b"c", b"d")), (1, tuple(map(str.encode, "a b c d e f g h i j".split())))]
    assert {size for size, *_ in search.tables} == {2, 10}
