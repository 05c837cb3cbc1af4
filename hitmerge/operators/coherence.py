"""Bucket coherence: does an engine's whole list answer more than the query's first word?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.terms import query_terms, rest_pattern
from hitmerge.session import cut_lineage

BROADCAST_QUERIES = 10_000  # counted; so few patterns go to the rows, as few queries would deal the texts to few tasks


def query_patterns(queries: DataFrame) -> DataFrame:
    """query_id, evaluable, pattern; terms are cut once per distinct query text."""
    terms = queries.select("query").distinct().withColumn("t", query_terms(F.col("query"))) \
        .select("query",
                ((F.size("t.anchor") > 0) & (F.size("t.rest") >= fv.MIN_REST_TERMS)).alias("evaluable"),
                rest_pattern(F.col("t.rest")).alias("pattern"))
    return queries.select("query_id", "query").join(terms, "query").select(
        "query_id", "evaluable", "pattern")


def bucket_scores(raw: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, engine, coherence: share of the uncapped rows that echo a later query term;
    NULL when the bucket or the query is too small to tell."""
    text = F.lower(F.concat_ws(" ", F.col("title"), F.col("snippet"), F.col("url")))
    patterns = cut_lineage(query_patterns(queries))
    if patterns.count() <= BROADCAST_QUERIES:
        patterns = F.broadcast(patterns)
    rows = raw.select("query_id", "engine", text.alias("text")).join(patterns, "query_id")
    hit = F.when(F.col("evaluable"), F.regexp_like(F.col("text"), F.col("pattern")).cast("int"))
    return rows.select("query_id", "engine", hit.alias("hit")).groupBy("query_id", "engine").agg(
        F.when(F.count(F.lit(1)) >= fv.MIN_BUCKET_ROWS, F.avg("hit")).alias("coherence"))


def judge_decoys(scores: DataFrame) -> DataFrame:
    """Add decoy: a low score counts only when another engine of the query proves that the
    query's words can be echoed at all. A label; no row is removed."""
    witness = F.max("coherence").over(W.partitionBy("query_id")) >= fv.WITNESS_FROM
    return scores.withColumn("decoy", F.coalesce(
        witness & (F.col("coherence") < fv.DECOY_BELOW), F.lit(False)))
