import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, seconds
from waybill.functions import columns as C
from waybill.operators import runs, series as S
from waybill.plans import rules
from waybill.operators.series import Grid
from waybill.schemas import SAMPLE
from waybill.sinks.export import EXPORT_EXPRESSIONS, export_run, read_csv
from waybill.sources.matrix import read_matrix


def sample(metric, t, value, kind="gauge", **labels):
    return (metric, labels, at(t), float(value), kind)


@pytest.fixture(scope="module")
def scraped(spark):
    rows = []
    for t in range(0, 601, 5):
        for b in (1, 2):
            rows.append(sample("kafka_broker_bytes_in_total", t, 1024 * b * t, "counter", instance=f"kafka-{b}"))
            rows.append(sample("kafka_broker_bytes_out_total", t, 2048 * b * t, "counter", instance=f"kafka-{b}"))
            rows.append(sample("kafka_broker_messages_in_total", t, 10 * t, "counter", instance=f"kafka-{b}"))
            rows.append(sample("container_cpu_usage_seconds_total", t, 0.5 * b * t, "counter", name=f"kafka-{b}", id=f"/x/{b}"))
            rows.append(sample("container_memory_usage_bytes", t, 1048576 * 512 * b, name=f"kafka-{b}", id=f"/x/{b}"))
            rows.append(sample("kafka_consumergroup_lag", t, b, partition=str(b)))
            rows.append(sample("jvm_process_cpu_load_ratio", t, 0.1 * b, instance=f"kafka-{b}"))
            rows.append(sample("jvm_heap_used_bytes", t, 1073741824 * b, instance=f"kafka-{b}"))
        for cpu in range(4):
            rows.append(sample("node_cpu_seconds_total", t, 0.75 * t, "counter", cpu=str(cpu), mode="idle"))
            rows.append(sample("node_cpu_seconds_total", t, 0.25 * t, "counter", cpu=str(cpu), mode="user"))
        rows.append(sample("node_memory_MemAvailable_bytes", t, 25))
        rows.append(sample("node_memory_MemTotal_bytes", t, 100))
        rows.append(sample("container_cpu_usage_seconds_total", t, 99 * t, "counter", name="postgres", id="/x/9"))
    return spark.createDataFrame(rows, SAMPLE)


@pytest.mark.parametrize("keep", [False, True])
def test_rules_on_steady_counters(scraped, keep):
    e = rules.Evaluation(scraped, Grid(at(500), at(500), "5 seconds"), keep=keep)
    got = {(r["query"], tuple(r["labels"].items())): r["value"] for r in rules.evaluate(e, rules.RULES).collect()}
    # The window (200, 500] holds samples from 205 on: 295 s of growth over 300 s.
    f = 295 / 300
    want = {
        ("kafka_broker_bytes_in_kb_per_sec", (("instance", "kafka-1"),)): 1 * f,
        ("kafka_broker_bytes_in_kb_per_sec", (("instance", "kafka-2"),)): 2 * f,
        ("kafka_broker_bytes_out_kb_per_sec", (("instance", "kafka-1"),)): 2 * f,
        ("kafka_broker_bytes_out_kb_per_sec", (("instance", "kafka-2"),)): 4 * f,
        ("kafka_broker_throughput_kb_per_sec", (("instance", "kafka-1"),)): 3 * f,
        ("kafka_broker_throughput_kb_per_sec", (("instance", "kafka-2"),)): 6 * f,
        ("kafka_cluster_bytes_in_kb_per_sec", ()): 3 * f,
        ("kafka_cluster_bytes_out_kb_per_sec", ()): 6 * f,
        ("kafka_cluster_throughput_bytes_per_sec", ()): 9 * 1024 * f,
        ("kafka_cluster_messages_per_sec", ()): 20 * f,
        ("kafka_cluster_consumer_lag_messages", ()): 3,
        ("kafka_broker_cpu_percent", (("broker", "kafka-1"),)): 50 * f,
        ("kafka_broker_cpu_percent", (("broker", "kafka-2"),)): 100 * f,
        ("kafka_cluster_cpu_percent", ()): 150 * f,
        ("kafka_cluster_cpu_cores", ()): 1.5 * f,
        ("kafka_host_cpu_cores", ()): 4,
        ("kafka_cluster_cpu_host_percent", ()): 37.5 * f,
        ("kafka_cluster_jvm_cpu_percent", ()): 15,
        ("kafka_broker_container_memory_mb", (("broker", "kafka-1"),)): 512,
        ("kafka_broker_container_memory_mb", (("broker", "kafka-2"),)): 1024,
        ("kafka_cluster_container_memory_gb", ()): 1.5,
        ("jvm_heap_used_gb", ()): 3,
        ("host_cpu_busy_percent", ()): 100 * (1 - 0.75 * f),
        ("host_memory_used_percent", ()): 75,
    }
    assert got == pytest.approx(want)


def test_recorded_rules_are_samples(scraped):
    e = rules.Evaluation(scraped, Grid(at(400), at(500), "50 seconds"))
    rows = rules.recorded(e, ["kafka_cluster_messages_per_sec"])
    assert rows.schema.names == SAMPLE.names and rows.count() == 3
    assert {r["metric"] for r in rows.collect()} == {"kafka_cluster_messages_per_sec"}


def test_export_run(spark, scraped, tmp_path):
    folder = export_run(scraped, "baseline", at(400), at(500), "50 seconds", str(tmp_path), all_metrics=True)
    assert folder.endswith("baseline-19700101-000820")
    meta = spark.read.json(f"{folder}/metadata").first()
    assert meta["run_label"] == "baseline" and meta["step_seconds"] == 50.0 and meta["export_all_metrics"] is True
    csv = spark.read.csv(f"{folder}/selected/csv", header=True, inferSchema=True, escape='"')
    rows = csv.where("query = 'cluster_cpu_cores'").orderBy("timestamp").collect()
    assert [r["timestamp"] for r in rows] == [400.0, 450.0, 500.0]
    # A recorded rule is a series of that name.
    assert {r["series"] for r in csv.where("query = 'cluster_cpu_cores'").collect()} == {'{"__name__": "kafka_cluster_cpu_cores"}'}
    back = read_matrix(spark, f"{folder}/selected/json", lines=True)
    assert back.count() == csv.count() == 7 * 3
    every = spark.read.csv(f"{folder}/all_metrics/csv", header=True, escape='"')
    assert every.select("query").distinct().count() == scraped.select("metric").distinct().count()
    assert any(json.loads(r["series"]) == {"__name__": "jvm_heap_used_bytes", "instance": "kafka-1"} for r in every.collect() if r["series"].startswith("{"))
    lines = [r[0] for r in spark.read.text(f"{folder}/selected/promql").collect()]
    assert f"cluster_cpu_cores = {EXPORT_EXPRESSIONS['cluster_cpu_cores']}" in lines and len(lines) == 12
    assert spark.read.json(f"{folder}/all_metrics/metric_names").count() == scraped.select("metric").distinct().count()


def test_export_bounds_numbers_and_names(spark, tmp_path):
    rows = [(m, {"i": str(i), "q": 'a "b", c'}, at(1_704_067_200 + t + 0.5), 1e10 * (t + 1), "gauge") for m in ("a b", "a/b", "c") for i in range(3) for t in range(0, 300, 10)]
    rows += [("d", {}, at(1_704_067_200), float(v), "gauge") for v in ("inf",)]
    df = spark.createDataFrame(rows, SAMPLE)
    folder = export_run(df, "r", at(1_704_067_200), at(1_704_067_500), "2500 milliseconds", str(tmp_path), all_metrics=True, rows=100, points=7)
    where = f"{folder}/all_metrics"
    for path in pathlib.Path(where, "csv").rglob("*.csv"):
        assert len(path.read_text().splitlines()) <= 101
    docs = [json.loads(line) for path in pathlib.Path(where, "json").rglob("*.txt") for line in path.read_text().splitlines()]
    points = [p for d in docs for p in d["data"]["result"][0]["values"]]
    assert max(len(d["data"]["result"][0]["values"]) for d in docs) == 7 and all(len(path.read_text().splitlines()) <= 14 for path in pathlib.Path(where, "json").rglob("*.txt"))
    assert {type(t) for t, _ in points} == {int, float} and {type(v) for _, v in points} == {str} and "+Inf" in {v for _, v in points}
    text = next(pathlib.Path(where, "json").rglob("*.txt")).read_text()
    assert "E9" not in text.split('"values":[[')[1].split(",")[0]
    want = S.instant(df, Grid(at(1_704_067_200), at(1_704_067_500), "2500 milliseconds")).select("metric", C.labels_key(F.col("labels")), "ts", "value")
    want = sorted(str(tuple(r)) for r in want.collect())
    back = read_matrix(spark, f"{where}/json", lines=True)
    assert sorted(str(tuple(r)) for r in back.select("metric", C.labels_key(F.col("labels")), "ts", "value").collect()) == want
    table = read_csv(spark, f"{where}/csv")
    labels = F.map_filter("labels", lambda k, _: k != "__name__")
    assert sorted(str(tuple(r)) for r in table.select(F.col("labels")["__name__"], C.labels_key(labels), "ts", "value").collect()) == want
    # Names that come out equal do not meet in one file.
    assert {(r["query"], r["labels"]["__name__"]) for r in table.select("query", "labels").collect()} == {("a_b", "a/b"), ("a_b.1", "a b"), ("c", "c"), ("d", "d")}


def test_matrix_file_and_failure(spark, tmp_path):
    doc = {"status": "success", "data": {"resultType": "matrix", "result": [
        {"metric": {"__name__": "up", "job": "a"}, "values": [[1700000000.25, "1"], [1700000010, "0.5"]]},
        {"metric": {}, "values": [[1700000000, "NaN"]]}]}}
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.json").write_text(json.dumps(doc, indent=2))
    rows = read_matrix(spark, str(tmp_path / "ok")).orderBy("series_index", "ts").collect()
    assert [(r["metric"], r["labels"], seconds(r["ts"]), r["series_index"]) for r in rows] == [
        ("up", {"job": "a"}, 1700000000.25, 0), ("up", {"job": "a"}, 1700000010.0, 0), ("", {}, 1700000000.0, 1)]
    assert rows[1]["value"] == 0.5
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text(json.dumps({"status": "error", "error": "x"}))
    with pytest.raises(Exception, match="did not succeed"):
        read_matrix(spark, str(tmp_path / "bad")).collect()


def test_phases_cover_the_run_once(spark):
    run = spark.createDataFrame([("r", at(1000))], "run_label string, start_ts timestamp")
    phases = runs.phase_table(run)
    spans = {r["phase"]: (seconds(r["start_ts"]), round(seconds(r["end_ts"]))) for r in phases.collect()}
    assert spans == {"idle": (1000, 1120), "warm_up": (1120, 1300), "measured": (1300, 2800)}
    ticks = spark.range(900, 3000, 10).select(F.lit("m").alias("metric"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("double").alias("value"))
    for rows in (0, 1000):
        tagged = runs.tag_phases(ticks, phases, bucket_seconds=90, broadcast_rows=rows).groupBy("phase").count().collect()
        assert {r["phase"]: r["count"] for r in tagged} == {"idle": 12, "warm_up": 18, "measured": 150}
    window = runs.measured_window(ticks, F.lit(at(1300)).cast("timestamp"), F.lit(at(1400)).cast("timestamp"))
    assert window.count() == 11


def test_idle_subtraction_and_comparison(spark):
    rows = [("idle", "cpu", 10.0), ("idle", "cpu", 20.0), ("a", "cpu", 45.0), ("b", "cpu", 30.0), ("a", "mem", 1.0)]
    means = runs.run_means(spark.createDataFrame(rows, "run_label string, metric string, value double"))
    assert {(r["run_label"], r["marginal"]) for r in runs.subtract_idle(means, "idle").collect()} == {("a", 30.0), ("b", 15.0)}
    table = {r["metric"]: r for r in runs.compare_runs(means, "idle", ["a", "b"]).collect()}
    assert table["cpu"]["a_overhead_percent"] == 200.0 and table["cpu"]["b_overhead_percent"] == 100.0
    assert table["mem"]["a"] == 1.0 and table["mem"]["a_overhead_percent"] is None


def test_shared_rules_are_made_once_from_the_metrics_they_reach(spark, monkeypatch):
    rows = [("container_cpu_usage_seconds_total", {"id": rules.BROKER_CONTAINERS["kafka-1"], "name": "x"}, at(t), t / 10, "counter") for t in range(0, 500, 5)]
    rows += [("node_cpu_seconds_total", {"cpu": "0", "mode": "idle"}, at(t), t / 10, "counter") for t in range(0, 500, 5)]
    made, asked = [], []
    original, rate = rules.RULES["kafka_broker_cpu_percent"], rules.S.rate
    monkeypatch.setitem(rules.RULES, "kafka_broker_cpu_percent", lambda e: made.append(isinstance(e, rules._Probe)) or original(e))
    monkeypatch.setattr(rules.S, "rate", lambda df, *a, **k: asked.append(df) or rate(df, *a, **k))
    names = ["kafka_broker_cpu_percent", "kafka_cluster_cpu_percent", "kafka_cluster_cpu_cores", "kafka_cluster_cpu_host_percent"]
    for keep in (False, True):
        made.clear(), asked.clear()
        e = rules.Evaluation(spark.createDataFrame(rows, SAMPLE), Grid(at(400), at(500), "50 seconds"), keep=keep)
        out = rules.evaluate(e, rules.RULES, names)
        assert made.count(False) == 1 and made.count(True) == 1 and len(asked) == 1
        # Of the counters only the containers' is evaluated.
        assert {r["metric"] for r in asked[0].select("metric").distinct().collect()} == {"container_cpu_usage_seconds_total"}
        assert "node_cpu_seconds_total" not in asked[0]._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
        found = {r["query"]: r["value"] for r in out.where(F.col("ts") == F.lit(at(450))).collect()}
        assert found["kafka_broker_cpu_percent"] == found["kafka_cluster_cpu_percent"] == pytest.approx(100 * 0.1 * 295 / 300)
        assert found["kafka_cluster_cpu_host_percent"] == found["kafka_cluster_cpu_percent"]
        # Where rules are kept, the union reads the written vector and rewrites no labels any more.
        assert ("RLIKE" in out._jdf.queryExecution().optimizedPlan().toString()) != keep
    e.plan([lambda e: e.rate("kafka_broker_bytes_in_total")])
    assert e.rate("kafka_broker_bytes_in_total").count() == 0 and len(asked) == 2
