import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import SF, numbered, texts, words
from waybill.llm import ngram_join as J
from waybill.llm.catalog import ORACLE
from waybill.llm.graph import components


def sets(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) or frozenset([tuple(ws)])


def brute(rows, size, percent):
    own = [(i, sets(t, size)) for i, t in rows]
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, s) in enumerate(own):
        r = root(k) if s else ("alone", k)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(i, low[r])
    return sorted(((-1 if i is None else i), len(s), -1 if (c := low[root(k) if s else ("alone", k)]) is None else c) for k, (i, s) in enumerate(own))


@pytest.mark.parametrize("bucket", [24, 2])
def test_components_equal_brute_force(spark, bucket, monkeypatch):
    """With buckets of two nodes at most, nearly everything goes through hubs and the second round."""
    monkeypatch.setattr(J, "BUCKET", bucket)
    rng = random.Random(bucket)
    some = texts(bucket, 25)
    chain = words(rng, 60, 9999).split()
    for i in range(12):  # each links with the next, the first not with the last
        chain = [*chain[2:], f"c{i}a", f"c{i}b"]
        some.append(" ".join(chain))
    docs = numbered(spark, some)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for size, percent in ((4, 85), (5, 80), (1, 50)):
        got = J.join_components(docs, size, percent, table_bits=16)
        assert sorted(((-1 if r[0] is None else r[0]), r[1], -1 if r[2] is None else r[2]) for r in got.collect()) == brute(rows, size, percent)


def test_keep_one(spark):
    docs = numbered(spark, texts(4, 10))
    want = {i for i, _, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80) if i == c and i >= 0}
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} - {None} == want
    assert J.keep_one(docs.limit(0)).count() == 0 and J.join_components(docs.limit(0)).count() == 0


def test_every_order_keeps_linked_pairs_in_its_prefixes():
    rng = random.Random(9)
    for _ in range(200):
        base = {f"s{rng.randrange(400)}" for _ in range(rng.randrange(1, 60))}
        other = {s for s in base if rng.random() > 0.08} | {f"t{rng.randrange(99)}" for _ in range(rng.randrange(4))}
        if not other or 100 * len(base & other) < 85 * len(base | other):
            continue
        rank = {s: rng.random() for s in base | other}
        p, q = (set(sorted(x, key=rank.get)[: J.prefix_length(len(x), 85)]) for x in (base, other))
        assert p & q


def test_shingles_of_short_and_empty_texts():
    h, begin = J.shingle_sets(pa.array(["", "a", "A", "a b", "a b c d", "a b c d e", " a  b\tc d "]), 4)
    assert (begin[1:] - begin[:-1]).tolist() == [0, 1, 1, 1, 1, 2, 1]
    assert h[0] == h[1] and h[3] == h[6]


def test_a_text_is_the_same_node_at_every_place_of_every_batch():
    rng = random.Random(12)
    mine = words(rng, 80, 9999)
    nodes = set()
    for before in (0, 1, 7, 60):
        batch = pa.array([*(words(rng, rng.randrange(200), 9999) for _ in range(before)), mine, "", mine.upper(), words(rng, 50, 9999)])
        got = J.nodes_of(*J.shingle_sets(batch, 4)).tolist()
        nodes |= {got[before], got[before + 2]}
        assert len(set(got[before:])) == 3
    assert len(nodes) == 1


def test_sketches_never_differ_in_more_bits_than_sets_do():
    rng = random.Random(21)
    for n in (0, 1, 30, 400, 5000):
        base = [rng.getrandbits(63) for _ in range(n)]
        other = base[n // 10 :] + [rng.getrandbits(63) for _ in range(n // 8)]
        x, y = (J.sketch_of(np.array(v, np.uint64)) for v in (base, other))
        differ, bits = len(set(base) ^ set(other)), sum(((int(a) ^ int(b)) % 2**64).bit_count() for a, b in zip(x, y))
        assert bits <= differ and (differ - bits) % 2 == 0 and (n > 400 or bits >= 0.8 * differ)
        # The order of the hashes does not matter.
        assert (J.sketch_of(np.array(base[::-1], np.uint64)) == x).all()


def test_near_copies_below_the_threshold_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Edited copies of one text share shingles in their prefixes, but no two reach the threshold."""
    rng = random.Random(22)
    base = words(rng, 100, 10**6).split()
    some = []
    for _ in range(120):
        near = list(base)
        for at in rng.sample(range(0, 100, 4), 7):
            near[at] = f"edit{rng.randrange(2)}x{at}"
        some.append(" ".join(near))
    compared = []
    linked = J._linked

    def counted(*args):
        compared.append(next(x for x in args if "a" in getattr(x, "columns", [])).count())
        return linked(*args)

    monkeypatch.setattr(J, "_linked", counted)
    monkeypatch.setattr(J, "BUCKET", 2)
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = sorted(tuple(r) for r in J.join_components(docs, table_bits=16).collect())
    assert got == brute(list(enumerate(some)), 4, 85)
    assert sum(compared[1:]) <= len(some)


def test_components_are_whole_however_many_open_buckets_are_named(spark, monkeypatch):
    """Pairs that share many buckets: components are whole with many and with few open buckets named with a node."""
    rng = random.Random(23)
    base = words(rng, 300, 10**6).split()
    some = []
    for _ in range(40):
        near = list(base)
        for at in rng.sample(range(0, 300, 10), 6):
            near[at] = f"edit{rng.randrange(3)}x{at}"
        some.append(" ".join(near))
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    monkeypatch.setattr(J, "BUCKET", 2)
    for open_keys in (64, 1):
        monkeypatch.setattr(J, "_OPEN", open_keys)
        got = sorted(tuple(r) for r in J.join_components(docs, table_bits=16).collect())
        assert got == brute(list(enumerate(some)), 4, 85)


def test_graph_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, 5), (100, 15), (7, 7)], "a long, b long")
    got = dict(components(links).collect())
    assert all(got[i] == 0 for i in range(20)) and got[100] == 0 and all(got[i] == 20 for i in range(20, 30)) and got[35] == 30
    assert components(links.limit(0)).count() == 0


def test_sql_has_the_same_links(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {(r[0], r[1], r[2]) for r in con.execute(ORACLE["op3_ngram_join"]).fetchall()}
    got = J.join_components(spark.read.parquet(f"{SF}/documents.parquet"))
    assert {tuple(r) for r in got.collect()} == want
