import zlib

from tests.llm.helpers import numbered, table, texts
from waybill.llm import toxicity as X
from waybill.llm.catalog import QUERIES

LEXICON = {"=idiot": 4.0, "lowei": 3.0}


def top(text):
    return X.Scorer(LEXICON).evidence(text)[0]


def test_clauses_not_words():
    plain = top("what an idiot they met")
    assert top("an idiot") == 4.0 and top("You idiot") == 5.0
    assert top("he is not an idiot") < plain and top("she wrote idiot") < plain
    assert top("not here. an idiot") == 4.0  # a negation ends with its clause
    assert top("not one of us would ever say idiot") > top("not an idiot")  # and reaches three words
    assert top("you kill") > top("kill") > 0
    assert top("Loweische Sachen") == 3.0 and top("nothing") == top("") == 0.0
    assert 4.0 < top("idiot idiot") < 8.0


def test_composition_multiplies_and_keeps_both_states():
    both = X.negation.compose(X.reported)
    assert both.states == 8
    state, _ = both.table[0, "report"]
    state, _ = both.table[state, "negation"]
    assert both.table[state, "insult"][1] == 0.4 * 0.5


def test_held_out_documents_of_the_larger_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    assert len(rows) == 10_000
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in rows.items())
    test = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    hit = sum(p and y for p, y in test)
    assert hit / sum(p for p, _ in test) > 0.95 and hit / sum(y for _, y in test) > 0.75


def test_labels_of_the_held_out_fold_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    one = {tuple(r) for r in X.assess(docs, labels).collect()}
    turned = labels.withColumn("toxic", X.F.when(X.fold() == 2, 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    assert {tuple(r) for r in X.assess(docs.withColumn("lang", X.F.lit("zz")), turned).collect()} == one


def test_awkward_tables(spark):
    docs = numbered(spark, [*texts(2, 6), "idiot"])
    for labels in (table(spark, [], "doc_id long, toxic int"), table(spark, [(1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")):
        out = X.assess(docs, labels).collect()
        assert len(out) == docs.count() and {r["predicted"] for r in out} == {0}
        assert X.keep_civil(docs, labels).columns == docs.columns
    assert X.assess(docs.limit(0), table(spark, [(1, 1)], "doc_id long, toxic int")).count() == 0
