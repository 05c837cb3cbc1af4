"""The three whole jobs: a search round from landed rows, deduplication of stored results, and the
evaluation of judged lists."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.operators import coherence, dedup, hits, quality, reach, status
from hitmerge.session import cut_lineage


class Round(NamedTuple):
    """hits, merge trace and one envelope (``report``) per query."""
    hits: DataFrame
    absorbed: DataFrame
    engine_status: DataFrame
    report: DataFrame
    unreachable: DataFrame


def _status_list(engine_status: DataFrame) -> DataFrame:
    """The engines of a round as one sorted array; empty texts, unknown scores and false flags are left out."""
    row = F.struct("engine", "ok", "count", "latency_ms", F.when(F.col("error") != "", F.col("error")).alias("error"), "coherence",
                   F.when(F.col("decoy"), True).alias("decoy"))
    return engine_status.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("engine_status"))


def _histogram(counts: DataFrame, key: str, out: str) -> DataFrame:
    return counts.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(out))


def envelope(queries: DataFrame, fetch_log: DataFrame, engine_status: DataFrame, stats: DataFrame, veto: DataFrame, passed: DataFrame,
             reached: DataFrame, unreachable: DataFrame) -> DataFrame:
    """One row per query: what the report says about the round besides its hits. Its arrays are bounded by the engines, the
    kinds of evidence and the hosts of one round."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    stage = lambda name, before, after, merged: F.struct(F.lit(name).alias("stage"), zero(before).alias("before"),
                                                         zero(after).alias("after"), zero(merged).alias("merged"))
    ended = fetch_log.groupBy("query_id").agg(F.array_sort(F.collect_set("engine")).alias("engines"), F.max("arrived_at").alias("generated_at"))
    dead = unreachable.groupBy("query_id").agg(F.array_sort(F.collect_list("address")).alias("unreachable"))
    rows = queries.select("query_id", "query").join(ended, "query_id", "left")
    for part in (status.latency_envelope(fetch_log).select("query_id", "elapsed_ms"), _status_list(engine_status), stats,
                 _histogram(veto, "veto", "veto"), _histogram(passed, "evidence", "pass"), reached, dead):
        rows = rows.join(part, "query_id", "left")
    stages = F.when(zero("raw") > 1, F.array(
        stage("d1_url_exact", "raw", "d1_url_exact_after", "d1_url_exact_merged"),
        stage("d2_judged", "d1_url_exact_after", "final", "d2_judged_merged")))
    none = F.array().cast("array<struct<stage:string,before:bigint,after:bigint,merged:bigint>>")
    return rows.select(
        "query_id", "query", F.coalesce("engines", F.array().cast("array<string>")).alias("engines"), "generated_at",
        zero("elapsed_ms").alias("elapsed_ms"), "engine_status",
        F.struct(F.coalesce("mode", F.lit(dedup.MODE)).alias("mode"), F.coalesce("threshold", F.lit(dedup.fv.TITLE_MIN)).alias("threshold"),
                 zero("raw").alias("raw"), zero("final").alias("final"), zero("total_merged").alias("total_merged"),
                 F.coalesce(stages, none).alias("stages"), "veto", "pass").alias("dedup"),
        F.struct(F.lit(True).alias("enabled"), zero("hosts_probed").alias("hosts_probed"), zero("hosts_ok").alias("hosts_ok"),
                 zero("dropped_items").alias("dropped_items"), zero("kept").alias("kept"), zero("hosts_known").alias("prefetched"),
                 "unreachable").alias("reachability"),
        F.struct(zero("final").alias("candidates"), zero("kept").alias("returned")).alias("stats"))


def search_round(raw: DataFrame, queries: DataFrame, fetch_log: DataFrame, verdict: DataFrame,
                 mode: str = "default", cap: int = dedup.fv.PER_ENGINE_CAP) -> Round:
    """raw rows -> capped, merged, deduplicated, reachable hits with status and envelope. ``cap`` drops the rows of an
    engine's list beyond it, whatever limit was asked for."""
    answered = fetch_log.filter("ok").select("query_id", "engine")
    served = raw.join(answered, ["query_id", "engine"], "left_semi")
    scores = coherence.judge_decoys(coherence.bucket_scores(served, queries))
    engine_status = status.engine_status(fetch_log, served, scores, cap)
    # The index behind a missing rank counts all rows of the list, so ranks come before the cap.
    listed = hits.cap_per_engine(hits.drop_blank_urls(hits.with_rank(served)), cap)
    pool = cut_lineage(hits.pool(listed))
    feats = cut_lineage(dedup.features(pool, mode))
    owners = dedup.find_owners(pool, mode, feats=feats)
    deduped = cut_lineage(dedup.absorb(pool, owners))
    kept = reach.reachable(deduped, verdict)
    unreachable = reach.unreachable_hosts(deduped, verdict)
    report = envelope(queries, fetch_log, engine_status, dedup.dedup_stats(pool, owners), dedup.veto_histogram(pool, owners, mode, feats),
                      dedup.pass_histogram(owners), reach.reach_stats(deduped, verdict), unreachable)
    return Round(kept, dedup.absorbed_urls(pool, owners), engine_status, report, unreachable)


def offline_dedup(stored: DataFrame, mode: str = "default") -> dedup.DedupResult:
    """Deduplicate the rows of stored reports again, all reports at once."""
    return dedup.dedup(stored.drop("merged_from"), mode)


def evaluate(judged: DataFrame, caps: DataFrame) -> dict[str, DataFrame]:
    """Every table of the engine comparison."""
    return {
        "metrics": quality.metric_table(judged, caps), "noise": quality.noise_floor(judged),
        "flips": quality.flip_audit(judged), "spearman": quality.spearman(judged),
        "variance": quality.variance_split(judged), "ranges": quality.range_ratio(judged),
        "cells": quality.cell_table(judged),
    }
