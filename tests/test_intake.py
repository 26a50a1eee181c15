from pyspark.sql import functions as F

from tests.helpers import at, audit_rows
from waybill.functions import columns as C
from waybill.operators.reconcile import read_commit_pairs, unmatched_reads
from waybill.sources import records as src
from waybill.streaming import intake

NOW = {"availableNow": True}


def test_good_quarantined_and_counted_rows_add_up(spark, tmp_path):
    good, bad, totals = str(tmp_path / "good"), str(tmp_path / "bad"), intake.Totals("audit in")
    spark.streams.addListener(totals)
    raw = audit_rows(spark, "e", [("R", t) if t % 2 else ("C", t) for t in range(30)]).select(F.col("eventId").alias("key"), audit_value())
    broken = spark.createDataFrame([("k", "{bad"), (None, None), ("k", '{"stage":"OTHER"}')], raw.schema)
    try:
        for k, part in enumerate([raw.limit(10), broken, raw.unionByName(broken)]):
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            totals.wait(intake.run_intake(stream, good, bad, str(tmp_path / "ck"), name="audit in", trigger=NOW))
        # The last batch is not known as finished: it is read, written and counted again.
        commits = tmp_path / "ck" / "commits"
        for file in ("2", ".2.crc"):
            (commits / file).unlink()
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        totals.wait(intake.run_intake(stream, good, bad, str(tmp_path / "ck"), name="audit in", trigger=NOW))
    finally:
        spark.streams.removeListener(totals)
    assert totals.totals == {"read": 46, "good": 40, "quarantined": 6}
    assert spark.read.parquet(good).count() == 40
    set_aside = spark.read.parquet(bad)
    assert sorted(map(str, (tuple(r) for r in set_aside.select("key", "value").collect()))) == sorted(map(str, [("k", "{bad"), (None, None), ("k", '{"stage":"OTHER"}')] * 2))
    back, _ = src.parse_audit(raw)
    assert spark.read.parquet(good).select(back.columns).exceptAll(back.unionByName(back.limit(0))).count() == 10


def audit_value():
    return C.audit_json().alias("value")


def test_streamed_pairs_equal_the_batch(spark, tmp_path):
    logs = {"both": [("R", 10), ("C", 500)], "twice": [("R", 20), ("R", 900), ("C", 1500)], "never": [("R", 700)], "far": [("R", 30), ("C", 90_000)],
            "clock": [("R", 200_000), ("C", 200_000)]}
    audit = None
    for key, log in logs.items():
        rows = audit_rows(spark, key, log)
        audit = rows if audit is None else audit.unionByName(rows)
    for low, high in ((0, 600), (600, 1000), (1000, 100_000), (100_000, 300_000)):
        seconds = F.unix_seconds("timestamp")
        audit.where((seconds >= low) & (seconds < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = intake.pair_stream(spark.readStream.schema(audit.schema).parquet(str(tmp_path / "in")), "1 hour", "1 minute")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(**NOW).start().awaitTermination()
    got = {r["eventId"]: r for r in intake.pairs_of(spark.read.parquet(str(tmp_path / "out"))).collect()}
    for r in read_commit_pairs(audit.where("eventId in ('both', 'twice', 'clock')")).collect():
        assert got[r["eventId"]] == r
    # A commit beyond the bound is no partner.
    alone = {k for k, r in got.items() if r["commits"] == 0}
    assert alone == {"never", "far"} and {r[0] for r in unmatched_reads(audit).collect()} == {"never"}
    assert got["never"]["first_read"] == got["never"]["last_read"] and at(700).timestamp() == got["never"]["first_read"].timestamp()
