import random

from tests.llm.helpers import numbered, texts, words
from waybill.llm import substring


def brute(rows):
    last = 2**63 - 1
    own = [(last if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in own:
        for k in range(len(ws) - 19):
            w = tuple(ws[k : k + 20])
            first[w] = min(first.get(w, (last, 1 << 40)), (i, k))
    out = []
    for i, ws in own:
        gone = set()
        for k in range(len(ws) - 19):
            if first[tuple(ws[k : k + 20])] != (i, k):
                gone.update(range(k, k + 20))
        out.append((-1 if i == last else i, len(ws), len(gone), b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()))
    return sorted(out)


def result(frame, **options):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["text"] or "") for r in substring.deduplicate(frame, **options).collect())


def test_equals_brute_force(spark):
    rng = random.Random(8)
    some = texts(7, 30)
    passage = words(rng, 20, 9)
    some += [f"{words(rng, k, 9)} {passage} {words(rng, 30 - k, 9)}" for k in range(30)]  # every alignment of a window
    some += ["loop " * 90, "a b " * 40, passage, " ".join(passage.split()[:19])]
    docs = numbered(spark, some)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for bits in (20, 8):  # a crowded table lets more through, with the same result
        assert result(docs, table_bits=bits) == brute(rows)
    assert substring.deduplicate(docs.limit(0), table_bits=12).count() == 0
    out = substring.deduplicate(docs, table_bits=12)
    assert out.columns == [*docs.columns, "n_words", "n_removed"] and out.filter("doc_id = 0").first()["text"] is None


def test_texts_without_id_are_documents_of_their_own(spark):
    rng = random.Random(5)
    passage, other = words(rng, 25, 9**5), words(rng, 25, 9**5)
    own = [words(rng, n, 9**5) for n in (9, 9, 9, 40, 60)]
    loose = [f"{own[0]} {passage}", f"{own[1]} {passage}", f"{own[2]} {other}", own[3], f"{own[3]} {own[4]}", None]
    rows = [(7, f"{words(rng, 4, 9**5)} {other}"), *((None, t) for t in loose), (None, loose[0]), (2**63 - 1, own[4])]
    got = {}
    for r in substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), table_bits=12).collect():
        got.setdefault((r["doc_id"], r["n_words"]), []).append((r["text"], r["n_removed"]))
    # A passage at one place of two texts goes from one of them; copies of a text keep it alike.
    pair = got[None, 34]
    kept = [t for t, n in pair if n == 0]
    assert sorted(t for t, n in pair if n == 25) == sorted({loose[0]: [own[1], own[2]], loose[1]: [own[0], own[0], own[2]]}[kept[0]])
    assert sorted(kept) in ([loose[0], loose[0]], [loose[1]])
    # Words that stand once stay, whatever is removed from other texts at their place.
    assert got[7, 29][0][1] == 0 and got[2**63 - 1, 60] == [(own[4], 0)]
    assert sorted(n for c in (40, 100) for _, n in got[None, c]) in ([0, 100], [40, 60])
    assert got[None, 0] == [(None, 0)]


def test_the_cover_meets_every_difference():
    d, v = substring.COVER, substring.PERIOD
    assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_columns_named_like_helpers_stay(spark):
    text = " ".join(f"w{i}" for i in range(25))
    more = ["_doc", "_tie", "_starts", "doc", "starts", "starts_"]
    docs = spark.createDataFrame([(1, text, *range(6)), (2, f"{text} end", *range(6))], ["doc_id", "text", *more])
    rows = sorted(substring.deduplicate(docs, table_bits=12).collect())
    assert [tuple(r) for r in rows] == [(1, text, *range(6), 25, 0), (2, "end", *range(6), 26, 25)]
