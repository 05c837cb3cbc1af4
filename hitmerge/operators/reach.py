"""Reachability: keep rows whose host has a good verdict, count what was dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.functions.urls import probe_target


def with_target(hits: DataFrame) -> DataFrame:
    """Add host and port to test; NULL for URLs that name none."""
    return hits.withColumn("__t", probe_target(F.col("url"))) \
        .withColumns({"host": F.col("__t.host"), "port": F.col("__t.port")}).drop("__t")


def targets(hits: DataFrame) -> DataFrame:
    """Distinct (host, port): each host is tested once."""
    return with_target(hits).filter(F.col("host").isNotNull()).select("host", "port").distinct()


def _good(verdict: DataFrame) -> DataFrame:
    return verdict.filter("ok").select("host", "port")


def reachable(hits: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows on hosts with a good verdict. The side that is broadcast, if any, is chosen by its
    measured size; a hot host is split by the adaptive skew join."""
    return with_target(hits).join(_good(verdict), ["host", "port"], "left_semi").drop("host", "port")


def unreachable(hits: DataFrame, verdict: DataFrame) -> DataFrame:
    """The other rows: bad or missing verdict, or no host at all."""
    return with_target(hits).join(_good(verdict), ["host", "port"], "left_anti").drop("host", "port")


def _hosts(hits: DataFrame, verdict: DataFrame) -> DataFrame:
    per_host = with_target(hits).groupBy("query_id", "host", "port").agg(F.count(F.lit(1)).alias("rows"))
    known = verdict.groupBy("host", "port").agg(F.max("ok").alias("good"))
    return per_host.join(known, ["host", "port"], "left").withColumn("known", F.col("good").isNotNull()) \
        .withColumn("good", F.coalesce("good", F.lit(False)))


def reach_stats(hits: DataFrame, verdict: DataFrame) -> DataFrame:
    """Per query: hosts tested, hosts good, hosts whose verdict was there, rows dropped and kept. Rows are first
    counted per host, so the verdict join and the final sums run over hosts, not rows."""
    named = F.col("host").isNotNull()
    return _hosts(hits, verdict).groupBy("query_id").agg(
        F.count_if(named).alias("hosts_probed"), F.count_if(named & F.col("good")).alias("hosts_ok"),
        F.count_if(named & F.col("known")).alias("hosts_known"),
        F.sum(F.when(F.col("good"), 0).otherwise(F.col("rows"))).alias("dropped_items"),
        F.sum(F.when(F.col("good"), F.col("rows")).otherwise(0)).alias("kept"))


def unreachable_hosts(hits: DataFrame, verdict: DataFrame) -> DataFrame:
    """query_id, address of every host without a good verdict, one row each."""
    bad = _hosts(hits, verdict).filter(F.col("host").isNotNull() & ~F.col("good"))
    bracketed = F.when(F.contains("host", F.lit(":")), F.concat(F.lit("["), F.col("host"), F.lit("]"))) \
        .otherwise(F.col("host"))
    return bad.select("query_id", F.concat_ws(":", bracketed, F.col("port")).alias("address"))


def funnel(pool: DataFrame, deduped: DataFrame, kept: DataFrame) -> DataFrame:
    """Per query: pool rows, candidates after deduplication, rows returned in the end."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))

    return counted(pool, "raw").join(counted(deduped, "candidates"), "query_id", "left") \
        .join(counted(kept, "returned"), "query_id", "left") \
        .select("query_id", "raw", F.coalesce("candidates", F.lit(0)).alias("candidates"),
                F.coalesce("returned", F.lit(0)).alias("returned"))
