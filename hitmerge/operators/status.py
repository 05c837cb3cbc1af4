"""Engine status: outcomes per engine, failure classes, latency, overlap, text health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.text import repair_mojibake


def engines(spark: SparkSession) -> DataFrame:
    """Engine dimension: engine, paid, most rows per request (NULL: no limit)."""
    rows = [(e, e in fv.PAID_ENGINES, fv.ENGINE_LIMITS[e]) for e in fv.ALL_ENGINES]
    return spark.createDataFrame(rows, "engine string, paid boolean, max_rows int")


def default_engines(dimension: DataFrame, with_key: DataFrame) -> DataFrame:
    """Engines used when none are named: the free ones and those a key exists for."""
    return dimension.join(with_key.select("engine").distinct().withColumn("key", F.lit(True)), "engine", "left") \
        .filter(~F.col("paid") | F.col("key").isNotNull()).drop("key")


def engine_status(fetch_log: DataFrame, raw: DataFrame, scores: DataFrame | None = None,
                  cap: int = fv.PER_ENGINE_CAP) -> DataFrame:
    """One row per engine asked, failures included: ok, capped row count, latency, error and, when
    judged scores are given, coherence and decoy. A failed engine has count 0 and no coherence."""
    counts = raw.filter("url <> ''").groupBy("query_id", "engine").agg(F.count(F.lit(1)).alias("n"))
    out = fetch_log.join(counts, ["query_id", "engine"], "left")
    cols = ["query_id", "engine", "ok",
            F.when(F.col("ok"), F.least(F.coalesce("n", F.lit(0)), F.lit(cap))).otherwise(0).alias("count"),
            "latency_ms", "error"]
    if scores is None:
        return out.select(*cols)
    return out.join(scores, ["query_id", "engine"], "left").select(
        *cols, F.when(F.col("ok"), F.col("coherence")).alias("coherence"),
        (F.col("ok") & F.coalesce("decoy", F.lit(False))).alias("decoy"))


def failure_class(error: Column, ok: Column, count: Column) -> Column:
    """Why an engine gave nothing, from its error text. Latency says nothing about health: a fast
    answer without rows is a throttled one."""
    out = F.when(F.lit(False), "")
    for name, pattern in fv.ERROR_PATTERNS:
        out = out.when(error.rlike(pattern), name)
    return out.when((error != "") | ~ok, "other").when(count == 0, "empty").otherwise("none")


def failure_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("engine", failure_class(F.col("error"), F.col("ok"), F.col("count")).alias("class")) \
        .agg(F.count(F.lit(1)).alias("n"))


def page_body_class(body: Column) -> Column:
    """ok, throttled or short: a body below the size of any real result page is not parsed."""
    return F.when(F.octet_length(body) >= fv.MIN_PAGE_BYTES, "ok") \
        .when(F.contains(body, F.lit(fv.PUNISH_MARKER)), "throttled").otherwise("short")


def latency_envelope(fetch_log: DataFrame) -> DataFrame:
    """Per round: elapsed, slowest engine and its latency, and the tail after it."""
    start = F.min(F.unix_millis("arrived_at") - F.col("latency_ms"))
    return fetch_log.groupBy("query_id").agg(
        (F.max(F.unix_millis("arrived_at")) - start).alias("elapsed_ms"),
        F.max("latency_ms").alias("slowest_ms"),
        F.min_by("engine", F.struct((-F.col("latency_ms")).alias("l"), "engine")).alias("slowest_engine")) \
        .withColumn("tail_ms", F.col("elapsed_ms") - F.col("slowest_ms"))


def engine_overlap(raw: DataFrame) -> DataFrame:
    """Per query and engine pair: shared URLs, both sizes and the Jaccard of the two lists. Pairs
    are formed inside one URL's engine set, which the number of engines bounds."""
    per_url = raw.groupBy("query_id", "url").agg(F.array_sort(F.collect_set("engine")).alias("e"))
    sizes = per_url.select("query_id", F.explode("e").alias("engine")).groupBy("query_id", "engine") \
        .agg(F.count(F.lit(1)).alias("n"))
    pairs = F.flatten(F.transform("e", lambda x: F.transform(
        F.filter("e", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    shared = per_url.filter(F.size("e") > 1).select("query_id", F.explode(pairs).alias("p")) \
        .groupBy("query_id", "p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes.withColumnsRenamed({"engine": "a", "n": "n_a"}), ["query_id", "a"]) \
        .join(sizes.withColumnsRenamed({"engine": "b", "n": "n_b"}), ["query_id", "b"]) \
        .select("query_id", "a", "b", "shared", "n_a", "n_b",
                (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def text_health(raw: DataFrame, exact_length: int = 400) -> DataFrame:
    """Per engine and text field: rows, share of mojibake, of Markdown and of empty texts, median,
    largest and total length, and the rows of exactly ``exact_length`` characters."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("title", "snippet")])
    rows = raw.select("engine", F.explode(fields).alias("x")).select("engine", "x.field", "x.text")
    n = F.length("text")
    share = lambda cond: F.avg(cond.cast("int"))
    return rows.groupBy("engine", "field").agg(
        F.count(F.lit(1)).alias("rows"),
        share(repair_mojibake(F.col("text")) != F.col("text")).alias("mojibake_rate"),
        share(F.col("text").rlike(r"!\[|\]\(")).alias("markdown_rate"),
        share(F.col("text") == "").alias("empty_rate"),
        F.median(n).alias("median_chars"), F.max(n).alias("max_chars"), F.sum(n).alias("total_chars"),
        F.count_if(n == exact_length).alias("exact_rows"))

