import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from waybill.operators import lifecycle as L
from waybill.operators import reconcile as R
from waybill.operators import runs, series as S
from waybill.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_its_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.QUERIES) > 80


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["outcome", "n"] and out.count() == 4


@pytest.mark.parametrize("name", [
    "lifecycle_outcomes", "outcome_counters", "batch_reads", "partial_batches", "rate_5m", "broker_cpu", "sink_upsert", "phase_tagging"])
def test_small_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    rows = con.execute(entry.oracle_sql()[name])
    heads = [d[0] for d in rows.description]
    want = sorted((tuple(r) for r in rows.fetchall()), key=str)
    got = sorted((tuple(r[h] for h in heads) for r in entry.queries()[name](spark, SF).collect()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b) if all(isinstance(x, (int, float)) for x in a) else [
            round(x, 5) if isinstance(x, float) else x for x in a] == [round(x, 5) if isinstance(x, float) else x for x in b]


def test_no_cross_joins_and_no_python(spark):
    log, recs, sink = V.audit_log(spark, SF), V.records(spark, SF), V.sink_rows(spark, SF)
    grid = S.Grid("2024-01-01", "2024-01-02", "1 hour")
    phases = spark.createDataFrame([("r", "p", 0, 1)], "run_label string, phase string, a int, b int").select(
        "run_label", "phase", F.timestamp_seconds("a").alias("start_ts"), F.timestamp_seconds("b").alias("end_ts"))
    for df in (
        L.lifecycle_batch(log, order=("timestamp", "seq")), L.lifecycle_batch(log, order=("timestamp", "seq"), hot_rows=2),
        R.sink_missing(recs, sink), R.partial_batches(V.batches(spark, SF), sink, ["batch_no"]),
        S.rate(V.samples(spark, SF), "1 hour", grid), S.instant(V.samples(spark, SF), grid),
        runs.tag_phases(V.samples(spark, SF), phases), runs.tag_phases(V.samples(spark, SF), phases, broadcast_rows=0),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text and "Python" not in text


def test_shuffles(spark):
    grid = S.Grid("2024-01-01", "2024-01-02", "1 hour")
    samples = V.samples(spark, SF)
    # Samples by slice, then slices by series; as-of values shuffle combined slices twice over.
    assert plan(S.increase(samples, "1 hour", grid)).count("Exchange hashpartitioning") == 2
    assert plan(S.instant(samples, grid)).count("Exchange hashpartitioning") == 2
    log = V.audit_log(spark, SF)
    assert plan(L.lifecycle_batch(log, order=("timestamp", "seq"))).count("Exchange") == 1
    assert plan(R.read_commit_pairs(log)).count("Exchange") == 1


def test_range_reaches_the_scan(spark):
    text = plan(runs.measured_window(
        V.events(spark, SF), F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-11").cast("timestamp")).select("ts", "value"))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text


@pytest.mark.parametrize("gone", [{"llm"}, {"llm", "corpus_pipeline.py"}])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    here = pathlib.Path(entry.__file__).parent
    for name in {"__spark_entry__.py", "oracle_queries.py", "corpus_pipeline.py"} - gone:
        shutil.copy(here / name, tmp_path)
    shutil.copytree(here / "waybill", tmp_path / "waybill", ignore=lambda d, names: [n for n in names if n in gone or n == "__pycache__"])
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), 'lifecycle_outcomes' in e.oracle_sql())"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.strip() == "True True", said.stderr
