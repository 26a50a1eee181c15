import hashlib
import math
import random
import re
import time
from collections import Counter

from hypothesis import given, settings, strategies as st

from tests.llm.helpers import SF, numbered, texts
from waybill.llm import secrets
from waybill.llm.catalog import QUERIES


def brute_base(text):
    """The contract read literally: all leftmost matches, failing ones dropped."""
    word = "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    spans = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


PIECES = ["token", "API_KEY", "apikey", "pASSwd", "ſecret", "password", "=", ": ", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", "\n", "hunter2hunter2", "x", "-", "toKen=secret:abcdefgh1"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_base_spans(text):
    base, every = secrets.find(text)
    assert base == brute_base(text)
    assert set(base) <= set(every) and every == sorted(every)


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef0123", min_size=20, max_size=70))
def test_incremental_entropy(text):
    def bits(w):
        return -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())

    assert math.isclose(secrets.window_entropy(text), max(bits(text[i : i + 20]) for i in range(len(text) - 19)), abs_tol=1e-9)


def test_random_strings_are_found_and_ordinary_ones_allowed():
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(200)]
    assert sum(any(k == 3 for _, k, _ in secrets.find(f"see {x} there")[1]) for x in keys) >= 190
    for plain in ("Donaudampfschifffahrtsgesellschaft", "123e4567-e89b-12d3-a456-426614174000", "2024-01-02-2024-01-03-2024", "release_2024_stable_build_12_final",
                  "aaaaaaaaaaaaaaaaaaaaaaaa1", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"):
        assert not secrets.find(f"x {plain} y")[1], plain
    assert secrets.redact("my token = abcdefgh12 end") == "my [secret] end"


def test_hexadecimal_keys_are_found_behind_names_and_paths():
    rng = random.Random(2)
    for before, after in (("sig=", ""), ("key_", ""), ("url/", "/x"), ("x-", "-y"), ("", "_v")):
        for digits, size in (("0123456789ABCDEF", 40), ("0123456789ABCDEF", 24), ("0123456789abcdef", 24)):
            keys = ["".join(rng.choices(digits, k=size)) for _ in range(100)]
            alone = sum(any(k == 3 for _, k, _ in secrets.find(f"see {x} there")[1]) for x in keys)
            glued = sum(any(k == 3 for _, k, _ in secrets.find(f"see {before}{x}{after} there")[1]) for x in keys)
            assert glued >= alone >= 80, (before, digits, size)
    for plain in ("build_20240102030405060708", "name_ffffffffffffffffffff1", "key_deadbeefdeadbeefdeadbeef", "dead-beef-cafe-1234-5678"):
        assert not secrets.find(f"x {plain} y")[1], plain


def test_a_fixed_pattern_hides_only_its_own_part():
    rng = random.Random(4)
    low, up = "".join(rng.choices("0123456789abcdef", k=32)), "".join(rng.choices("0123456789ABCDEF", k=40))
    assert secrets.find(f"{low}/{up}")[1] == [(0, 2, 32), (32, 3, 73)]
    assert secrets.find(f"{up}_{low}_{up}")[1] == [(0, 3, 41), (41, 2, 73), (73, 3, 114)]
    assert secrets.find(f"sig_{low}_end")[1] == [(4, 2, 36)]


def test_rows(spark):
    docs = numbered(spark, [*texts(3, 4), "token=abcdefgh12", "a" * 50_000])
    rows = secrets.scan(docs).collect()
    assert len(rows) == docs.count() and secrets.scan(docs.limit(0)).count() == 0
    assert [r["spans"] for r in rows if r["n_assign"]] == ["assign:0:16"]


def test_query_equals_brute_force(spark):
    texts_ = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    for r in QUERIES["op10_secrets"](spark, SF).collect():
        base = brute_base(texts_[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()


def test_many_spans_take_time_in_proportion():
    rng = random.Random(6)
    part = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    text = f"token = abcdefgh1 {part}\n"
    start = time.time()
    base, every = secrets.find(text * 20_000)
    assert len(base) == 20_000 and len(every) == 20_000 * len(secrets.find(text)[1]) and time.time() - start < 20
