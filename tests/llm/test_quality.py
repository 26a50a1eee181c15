import re

import duckdb
from pyspark.sql import functions as F

from tests.llm.helpers import SF, numbered, texts
from waybill.llm import quality
from waybill.llm.catalog import ORACLE


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    repeated = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)


def test_counts_equal_brute_force(spark):
    some = [t for t in texts(6, 12) if not t or len(t) < 4000] + ["a b a b a b", "x\nx\n \nx", "#*$ %&| <>", "one two three " * 30, "\n".join(["line one is here"] * 20)]
    docs = numbered(spark, some)
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r)[:7] for r in quality.verdicts(docs).collect()), key=key)
    assert got == sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=key)
    assert quality.verdicts(docs.limit(0)).count() == 0


def test_the_order_changes_no_verdict(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {tuple(r) for r in quality.verdicts(docs).select("doc_id", "kept").collect()}
    monkeypatch.setattr(quality, "order_rules", lambda sample, rules: sorted(rules, reverse=True))
    assert {tuple(r) for r in quality.verdicts(docs).select("doc_id", "kept").collect()} == want
    assert 0 < sum(k for _, k in want) < len(want)


def test_rules_that_reject_come_first(spark):
    sample = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("word"), 5)).alias("text"))
    order = quality.order_rules(sample, {"never": F.lit(False), "always": F.length("text") > 0, "some": F.col("doc_id") < 3})
    assert order[0] == "always" and order[-1] == "never"


def test_native_plan_without_shuffle(spark):
    plan = quality.verdicts(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = con.execute(ORACLE["op7_quality_rules"])
    names = [d[0] for d in rows.description]
    want = {tuple(r) for r in rows.fetchall()}
    assert {tuple(r) for r in quality.verdicts(spark.read.parquet(f"{SF}/documents.parquet")).select(*names).collect()} == want
