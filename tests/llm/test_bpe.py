import base64
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tests.llm.helpers import SF, numbered, texts
from waybill.llm import bpe
from waybill.llm.catalog import QUERIES, tokenizer
from waybill.llm.common import PIECE, append_columns

PATH = tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
VOCAB = bpe.Vocabulary(open(PATH, encoding="utf-8").read())
MIXED = st.lists(st.sampled_from(["a", "the", " the", "  ", "\n", "'ll", "'", "é", "漢", "😀", "<|endoftext|>", "12", "\x1c", "\x85", "\xa0", "ﬁ", "Ⅷ", "!!"])).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), MIXED))
def test_same_ids_and_text_as_the_library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(VOCAB.encode(text), "<u4").tolist() == ids
    assert VOCAB.decode(VOCAB.encode(text)) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 4000, "!" * 5000, "漢" * 2000, "x" * 70, " " * 3000 + "y"])
def test_long_runs_take_the_heap(text):
    assert np.frombuffer(VOCAB.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_no_token_spans_a_forced_pair():
    assert all(VOCAB.forced.isdisjoint(zip(piece, piece[1:])) for piece in VOCAB.pieces[:-1])
    assert (ord("e"), ord(" ")) in VOCAB.forced and len(VOCAB.forced) > 50_000
    assert b"".join(VOCAB.cut(b"ab\x00c d")) == b"ab\x00c d"


def test_query_equals_the_library(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op1_bpe_round_trip"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d["text"], add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows_and_round_trip(spark):
    docs = numbered(spark, texts())
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    rows = back.collect()
    assert len(rows) == docs.count() and "node" in back.columns
    assert all(r["decoded"] == (r["text"] or "") and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    packed = bpe.encode(docs.filter("text = 'one'"), PATH, packed=True).first()
    assert base64.b64decode(packed["ids"]) == np.array(LIBRARY.encode("one").ids, "<u4").tobytes()


def test_large_batches_are_computed_in_slices(spark):
    """What is held beside a batch grows with a slice of its texts and not with the batch."""
    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "IF(id = 7, NULL, repeat('x', 500000)) AS text")
    fields = T.StructType([T.StructField("seen", T.LongType())])
    out = append_columns(docs, fields, lambda texts: [pa.array([len(texts)] * len(texts), pa.int64())]).select("doc_id", "seen").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(60))
    assert max(r["seen"] for r in out) * 500_000 <= PIECE + 1_000_000
    assert append_columns(docs.limit(0), fields, lambda texts: [pa.array([0] * len(texts), pa.int64())]).collect() == []
