"""Item logs and stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmerge import schemas


def write_item_log(raw: DataFrame, path: str) -> None:
    """One JSON line per returned row, texts in full."""
    raw.select("engine", "query", "rank", "title", "url", "snippet", "date", "signals") \
        .write.mode("overwrite").json(path)


def read_item_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ITEM_LOG).json(path)


def read_stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of stored reports, ready for another deduplication run: merge traces of the
    earlier run are cleared. hit_ord is the place in the report."""
    reports = spark.read.schema(schemas.REPORT).json(path)
    rows = reports.select(F.col("query").alias("query_id"), F.posexplode("results").alias("hit_ord", "h"))
    return rows.select("query_id", F.col("hit_ord").cast("bigint").alias("hit_ord"), "h.*") \
        .withColumn("merged_from", F.lit(None).cast(f"map<string,{schemas.ALT_REF}>"))
