import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import seconds
from waybill.functions import columns as C
from waybill.sources import records as src
from waybill.session import micros

GOOD = {
    "eventId": "e", "stage": "BATCH_READ", "consumerGroup": "g", "sourceTopic": "t",
    "timestamp": "2024-02-03T04:05:06Z", "recordCount": 5,
    "partitionRanges": [{"partition": 1, "offsetMin": 10, "offsetMax": 14, "recordCount": 5}],
}


def texts(spark, docs):
    return spark.createDataFrame([(d if isinstance(d, str) or d is None else json.dumps(d),) for d in docs], "value string")


def test_audit_json_accepts_contract(spark):
    commit = {k: v for k, v in GOOD.items() if k != "partitionRanges"} | {"stage": "OFFSET_COMMITTED", "recordCount": 0}
    offset_zone = GOOD | {"timestamp": "2024-02-03T05:05:06+01:00"}
    text_number = GOOD | {"recordCount": "7"}
    wide = GOOD | {"more": [1, 2]}
    good, bad = src.parse_audit(texts(spark, [GOOD, commit, offset_zone, text_number, wide]))
    assert bad.count() == 0
    rows = good.collect()
    assert [r["recordCount"] for r in rows] == [5, 0, 5, 7, 5]
    assert {seconds(r["timestamp"]) for r in rows} == {1706933106.0}
    assert rows[0]["partitionRanges"][0].asDict() == GOOD["partitionRanges"][0]
    assert rows[1]["partitionRanges"] == []


@pytest.mark.parametrize("broken", [
    *[{k: v for k, v in GOOD.items() if k != name} for name in GOOD],
    *[GOOD | {name: None} for name in GOOD],
    GOOD | {"stage": "OTHER"},
    GOOD | {"timestamp": "yesterday"},
    GOOD | {"timestamp": "2024-02-03"},
    GOOD | {"partitionRanges": {"partition": 1}},
    GOOD | {"partitionRanges": [{"partition": 1, "offsetMin": 1, "recordCount": 1}]},
    GOOD | {"partitionRanges": [{"partition": 1, "offsetMin": None, "offsetMax": 1, "recordCount": 1}]},
    "{bad-json}", "", "[]", None,
], ids=lambda d: str(d)[:60])
def test_audit_json_rejects(spark, broken):
    good, bad = src.parse_audit(texts(spark, [broken]))
    assert good.count() == 0 and bad.count() == 1


def test_audit_json_round_trip(spark):
    good, _ = src.parse_audit(texts(spark, [GOOD]))
    text = good.select(C.audit_json().alias("value"))
    assert json.loads(text.first()[0])["timestamp"] == "2024-02-03T04:05:06.000000Z"
    again, _ = src.parse_audit(text)
    assert again.collect() == good.collect()
    commit = good.withColumn("stage", F.lit("OFFSET_COMMITTED")).select(C.audit_json().alias("value"))
    assert "partitionRanges" not in json.loads(commit.first()[0])


def test_iso_text_ignores_session_zone(spark):
    good, _ = src.parse_audit(texts(spark, [GOOD]))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert json.loads(good.select(C.audit_json()).first()[0])["timestamp"] == "2024-02-03T04:05:06.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


OUTCOME = {
    "eventId": "abc", "outcome": "REPLAY_OBSERVED", "consumerGroup": "perf-group", "sourceTopic": "events",
    "firstSeenAt": "2026-03-20T00:00:00Z", "lastSeenAt": "2026-03-20T00:00:05Z", "observedAt": "2026-03-20T00:00:05Z",
    "recordCount": 10, "replayCount": 2, "timeoutCount": 1,
    "partitionRanges": [
        {"partition": 0, "offsetMin": 100, "offsetMax": 104, "recordCount": 5},
        {"partition": 1, "offsetMin": 200, "offsetMax": 204, "recordCount": 5},
    ],
}


def test_outcome_json(spark):
    numeric = OUTCOME | {"firstSeenAt": 1773964800.5, "lastSeenAt": 1773964805, "observedAt": 1773964805.25}
    sparse = {k: OUTCOME[k] for k in ("outcome", "consumerGroup", "sourceTopic")} | {"partitionRanges": None, "extra": 1}
    good, bad = src.parse_outcomes(texts(spark, [OUTCOME, numeric, sparse, "{bad-json}", {**OUTCOME, "outcome": None}]))
    rows = good.collect()
    assert len(rows) == 3 and bad.count() == 2
    assert rows[0]["replayCount"] == 2 and [r["partition"] for r in rows[0]["partitionRanges"]] == [0, 1]
    assert seconds(rows[0]["lastSeenAt"]) - seconds(rows[0]["firstSeenAt"]) == 5
    assert seconds(rows[1]["firstSeenAt"]) == 1773964800.5 and seconds(rows[1]["observedAt"]) == 1773964805.25
    assert rows[2]["recordCount"] == 0 and rows[2]["partitionRanges"] == [] and rows[2]["observedAt"] is None


def test_fingerprint_ignores_order_and_sees_change(spark):
    def hashed(ranges):
        df = spark.createDataFrame([(ranges,)], "r array<struct<partition:int,offsetMin:bigint,offsetMax:bigint,recordCount:int>>")
        return df.select(C.fingerprint(F.lit("g"), F.lit("t"), F.lit(3), F.col("r"))).first()[0]

    import hashlib
    a, b = (0, 1, 2, 2), (1, 7, 7, 1)
    assert hashed([a, b]) == hashed([b, a]) == hashlib.sha256(b"g|t|3|0:1:2:2|1:7:7:1").hexdigest()
    assert hashed([a, (1, 7, 8, 1)]) != hashed([a, b])
    assert hashed([]) == hashlib.sha256(b"g|t|3").hexdigest()


def test_label_helpers(spark):
    df = spark.createDataFrame([({"b": "2", "a": 'x"y'},), ({},)], "labels map<string,string>")
    assert [r[0] for r in df.select(C.series_name(F.col("labels"), F.lit(4))).collect()] == ['{"a": "x\\"y", "b": "2"}', "series_4"]
    assert json.dumps({"a": 'x"y', "b": "2"}, sort_keys=True) == '{"a": "x\\"y", "b": "2"}'
    assert [r[0] for r in df.select(C.labels_key(F.col("labels"))).collect()] == ['{"a":"x\\"y","b":"2"}', "{}"]
    names = spark.createDataFrame([("a b/c",), ("..x..",), ("._.",), ("",)], "n string")
    assert [r[0] for r in names.select(C.file_name(F.col("n"))).collect()] == ["a_b_c", "x", "metric", "metric"]
    blank = spark.createDataFrame([(None,), ("",), (" \t",), ("g",)], "n string")
    assert [r[0] for r in blank.select(C.label_or_unknown(F.col("n"))).collect()] == ["unknown"] * 3 + ["g"]


def test_label_replace_rules(spark):
    df = spark.createDataFrame([({"name": "kafka-7", "broker": "old"},), ({"name": "other"},), ({},)], "labels map<string,string>")

    def run(*args):
        return [r[0] for r in df.select(C.replaced_labels(F.col("labels"), *args)).collect()]

    assert run("broker", "$1", "name", "(kafka-[0-9]+)") == [{"name": "kafka-7", "broker": "kafka-7"}, {"name": "other"}, {}]
    assert run("broker", "all", "id", ".*") == [
        {"name": "kafka-7", "broker": "all"}, {"name": "other", "broker": "all"}, {"broker": "all"}]
    assert run("broker", "", "name", ".*")[0] == {"name": "kafka-7"}
    # The pattern is anchored: a part of the value is no match.
    assert run("broker", "$1", "name", "(kafka)")[0] == {"name": "kafka-7", "broker": "old"}


def test_matchers_and_units(spark):
    df = spark.createDataFrame([({"a": "x1"},), ({},)], "labels map<string,string>")
    test = df.select(C.matches(F.col("labels"), regex={"a": "x"}), C.matches(F.col("labels"), regex={"a": "x.|"}), C.matches(F.col("labels"), eq={"a": ""}))
    assert [tuple(r) for r in test.collect()] == [(False, True, False), (False, True, True)]
    attached = df.select(C.attached_labels(F.col("labels"), {"a": "new", "job": "j"})).collect()
    assert [r[0] for r in attached] == [{"a": "new", "job": "j"}] * 2
    units = spark.range(1).select(C.kib(F.lit(2048.0)), C.mib(F.lit(1048576.0)), C.gib(F.lit(1073741824.0)), C.percent(F.lit(0.25)))
    assert tuple(units.first()) == (2.0, 1.0, 1.0, 25.0)


def test_durations():
    assert micros("90 seconds") == 90_000_000 and micros("5m") == 300_000_000 and micros(3) == 3_000_000
    assert micros("1 hour 30 minutes") == 5_400_000_000 and micros("250ms") == 250_000
    for bad in ("", "soon", "5 parsecs", "5"):
        with pytest.raises(ValueError):
            micros(bad)
