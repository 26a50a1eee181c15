"""Export of a measured run: selected queries, and on request every metric."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waybill.functions.columns import file_name, labels_key, series_name
from waybill.operators.series import Grid, instant, metric_names
from waybill.plans.rules import EXPORT_QUERIES, RULES, Evaluation, evaluate
from waybill.session import broadcast_if_small, cut_lineage

# --- fixed values: the expression each exported query stands for --------------------------------
EXPORT_EXPRESSIONS = {
    "cluster_messages_per_sec": "kafka_cluster_messages_per_sec",
    "cluster_bytes_in_kb_per_sec": "kafka_cluster_bytes_in_kb_per_sec",
    "cluster_bytes_out_kb_per_sec": "kafka_cluster_bytes_out_kb_per_sec",
    "cluster_cpu_host_percent": "kafka_cluster_cpu_host_percent",
    "cluster_cpu_cores": "kafka_cluster_cpu_cores",
    "cluster_cpu_core_percent": "kafka_cluster_cpu_percent",
    "cluster_memory_gb": "kafka_cluster_container_memory_gb",
    "audit_committed_total": 'sum(audit_outcomes_total{outcome="COMMITTED"})',
    "audit_replay_observed_total": 'sum(audit_outcomes_total{outcome="REPLAY_OBSERVED"})',
    "audit_estimated_failed_total": 'sum(audit_outcomes_total{outcome="ESTIMATED_FAILED"})',
    "audit_late_commit_total": 'sum(audit_outcomes_total{outcome="LATE_COMMIT"})',
    "audit_batches_seen_total": "sum(audit_batches_seen_total)",
}
# ------------------------------------------------------------------------------------------------


#: Rows of a file and points of a list at most.
FILE_ROWS = 1_000_000
LIST_POINTS = 11_000


def _seconds_text(ts: Column) -> Column:
    """Epoch seconds as plain digits, with a fraction only where there is one."""
    us = F.unix_micros(ts)
    text = F.rtrim(F.format_string("%d.%06d", F.floor(us / 1_000_000).cast("bigint"), F.pmod(us, F.lit(1_000_000))), F.lit("0"))
    return F.rtrim(text, F.lit("."))


def _value_text(value: Column) -> Column:
    return F.when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").otherwise(value.cast("string"))


def _named(evaluated: DataFrame) -> DataFrame:
    """``labels`` with the series' own name as the label ``__name__``, where a column ``name`` gives one."""
    if "name" not in evaluated.columns:
        return evaluated
    named = F.map_concat(F.create_map(F.lit("__name__"), F.col("name")), F.coalesce("labels", F.create_map().cast("map<string,string>")))
    return evaluated.withColumn("labels", F.when(F.isnull("name"), F.col("labels")).otherwise(named)).drop("name")


def series_rows(evaluated: DataFrame) -> DataFrame:
    """Evaluated values in export form: ``query, series, timestamp, value``; times in epoch seconds."""
    return _named(evaluated).select(
        "query", series_name(F.col("labels")).alias("series"),
        (F.unix_micros("ts") / 1e6).alias("timestamp"), "value",
    )


def matrix_rows(evaluated: DataFrame, grid: Grid, points: int = LIST_POINTS) -> DataFrame:
    """``query`` and a range-query document (``value``) for every series and stretch of ``points`` grid points.

    Times are numbers and values are text. A series of more points has several documents, none with a longer list.
    """
    rows = _placed(_named(evaluated), grid, points)
    point = F.struct(F.unix_micros("ts").alias("us"), F.concat(F.lit("["), _seconds_text(F.col("ts")), F.lit(',"'), _value_text(F.col("value")), F.lit('"]')).alias("text"))
    lists = rows.groupBy("query", "_stretch", "_key").agg(F.array_sort(F.collect_list(point)).alias("points"))
    text = F.concat(
        F.lit('{"status":"success","data":{"resultType":"matrix","result":[{"metric":'), F.col("_key"), F.lit(',"values":['),
        F.array_join("points.text", ","), F.lit("]}]}}"))
    return lists.select("query", text.alias("value"))


def _placed(rows: DataFrame, grid: Grid, points: int) -> DataFrame:
    stretch = F.floor((F.unix_micros("ts") - grid.start_us) / F.lit(grid.step_us * points)).cast("bigint")
    return rows.withColumns({"_key": labels_key(F.col("labels")), "_stretch": stretch})


def _planned(evaluated: DataFrame, grid: Grid, points: int, rows: int) -> DataFrame:
    """The rows dealt out so that a task has about ``rows`` of them at most and a series' stretch lies in one task.

    What each query has in each stretch is counted first; one that has more is cut into parts by its series.
    """
    placed = cut_lineage(_placed(_named(evaluated), grid, points))
    sizes = placed.groupBy("query", "_stretch").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("bigint").alias("_parts"))
    placed = placed.join(broadcast_if_small(sizes), ["query", "_stretch"])
    return placed.withColumn("_part", F.pmod(F.xxhash64("_key"), F.col("_parts"))).repartition("query", "_stretch", "_part")


def write_queries(
    evaluated: DataFrame, out_dir: str, grid: Grid, expressions: dict[str, str] | None = None, rows: int = FILE_ROWS, points: int = LIST_POINTS,
) -> None:
    """CSV and JSON per query (one folder each, a document a line), and the list of expressions.

    No CSV file has more than ``rows`` rows, none of JSON more than that many points, and no list more than ``points``.
    """
    planned = _planned(evaluated, grid, points, rows)
    csv = planned.select(
        "query", series_name(F.col("labels")).alias("series"), _seconds_text(F.col("ts")).alias("timestamp"), _value_text(F.col("value")).alias("value"), "_key", "ts")
    csv = csv.sortWithinPartitions("query", "_key", "ts").drop("_key", "ts")
    csv.write.partitionBy("query").options(header=True, escape='"', maxRecordsPerFile=rows).mode("overwrite").csv(f"{out_dir}/csv")
    # Lists are made where the rows lie: their groups are within what the rows are dealt by.
    documents = matrix_rows(planned.drop("_key", "_stretch", "_parts", "_part"), grid, points)
    documents.sortWithinPartitions("query").write.partitionBy("query").option("maxRecordsPerFile", max(1, rows // points)).mode("overwrite").text(f"{out_dir}/json")
    if expressions:
        lines = [(f"{name} = {text}",) for name, text in expressions.items()]
        evaluated.sparkSession.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/promql")


def read_csv(spark: SparkSession, folder: str) -> DataFrame:
    """``query, labels, ts, value`` of exported CSV files, in the form they were evaluated in (``__name__`` is a label here)."""
    rows = spark.read.schema("series string, timestamp string, value string, query string").csv(folder, header=True, escape='"')
    labels = F.when(F.col("series").startswith("{"), F.from_json("series", "map<string,string>")).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(
        "query", labels.alias("labels"), F.timestamp_micros((F.col("timestamp").cast("decimal(20,6)") * 1_000_000).cast("bigint")).alias("ts"),
        F.col("value").cast("double").alias("value"))


def file_names(metrics: DataFrame) -> DataFrame:
    """``metric`` and the ``query`` its files are named by. Of metrics whose sanitised names are equal the last keeps the plain name, and
    the others get a number: none is merged with another."""
    place = F.row_number().over(Window.partitionBy("_file").orderBy(F.desc("metric"))) - 1
    named = metrics.select("metric", file_name(F.col("metric")).alias("_file")).withColumn("_place", place)
    return named.select("metric", F.when(F.col("_place") == 0, F.col("_file")).otherwise(F.concat("_file", F.lit("."), F.col("_place"))).alias("query"))


def export_run(
    samples: DataFrame, run_label: str, start: str | datetime, end: str | datetime, step: str, out_dir: str,
    all_metrics: bool = False, source: str = "", rows: int = FILE_ROWS, points: int = LIST_POINTS, **options,
) -> str:
    """Write ``<out_dir>/<label>-<end time>`` with metadata, selected queries and optionally all metrics.

    ``rows`` and ``points`` bound files and lists as in ``write_queries``; ``options`` go to :class:`Evaluation`. Inputs that several
    queries share are evaluated once. Series of recorded rules and of metrics carry their name as ``__name__``, sums do not.
    """
    grid = Grid(start, end, step)
    stamp = datetime.fromtimestamp((grid.start_us + grid.last * grid.step_us) / 1e6, timezone.utc).strftime("%Y%m%d-%H%M%S")
    folder = f"{out_dir.rstrip('/')}/{run_label}-{stamp}"
    spark = samples.sparkSession
    metadata = spark.range(1).select(
        F.lit(run_label).alias("run_label"),
        F.lit(grid.start_us / 1e6).alias("start_ts"),
        F.lit(grid.end_us / 1e6).alias("end_ts"),
        F.lit(source).alias("source"),
        F.lit(grid.step_us / 1e6).alias("step_seconds"),
        F.create_map(*[F.lit(x) for item in EXPORT_EXPRESSIONS.items() for x in item]).alias("queries"),
        F.lit(all_metrics).alias("export_all_metrics"),
    )
    metadata.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    evaluation = Evaluation(samples, grid, keep=True, **options)
    recorded = {q: text for q, text in EXPORT_EXPRESSIONS.items() if text in RULES}
    # A constant table of the queries' names.
    names = F.create_map(*[F.lit(x) for item in recorded.items() for x in item])
    selected = evaluate(evaluation, EXPORT_QUERIES).withColumn("name", F.try_element_at(names, F.col("query")))
    write_queries(selected, f"{folder}/selected", grid, EXPORT_EXPRESSIONS, rows, points)
    if all_metrics:
        metrics = cut_lineage(metric_names(samples))
        metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/all_metrics/metric_names")
        every = instant(samples.where(F.col("metric") != ""), grid, evaluation.lookback)
        every = every.join(broadcast_if_small(file_names(metrics)), "metric")
        write_queries(every.withColumnRenamed("metric", "name"), f"{folder}/all_metrics", grid, None, rows, points)
    return folder
