"""Saved range-query results: ``{"status", "data": {"result": [{"metric", "values"}]}}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_RESULT = "array<struct<metric:map<string,string>,values:array<array<string>>>>"
_SCHEMA = f"status string, data struct<resultType:string,result:{_RESULT}>"


def read_matrix(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Samples of saved results: one JSON document per file, or with ``lines`` one per line.

    A document that spans lines is read by one task; prefer lines for large results.
    """
    return _samples(spark.read.schema(_SCHEMA).json(path, multiLine=not lines))


def parse_matrix(df: DataFrame, col: str = "value") -> DataFrame:
    """Samples of results held as text in a column."""
    return _samples(df.select(F.from_json(col, _SCHEMA).alias("_doc")).select("_doc.*"))


def _samples(docs: DataFrame) -> DataFrame:
    """One row per series and value; a result that is not a success stops the query."""
    failed = F.coalesce(F.col("status") != "success", F.lit(True))
    result: Column = F.when(failed, F.raise_error(F.lit("range query did not succeed")).cast(_RESULT)).otherwise(
        F.col("data.result")
    )
    series = docs.select(F.posexplode(result).alias("series_index", "s"))
    pairs = series.select("series_index", F.col("s.metric").alias("m"), F.explode("s.values").alias("v"))
    return pairs.select(
        F.coalesce(F.try_element_at("m", F.lit("__name__")), F.lit("")).alias("metric"),
        F.map_filter("m", lambda k, _: k != "__name__").alias("labels"),
        F.timestamp_micros((F.col("v")[0].cast("decimal(20,6)") * 1_000_000).cast("bigint")).alias("ts"),
        F.col("v")[1].cast("double").alias("value"),
        "series_index",
    )
