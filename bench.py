"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm the JVM on the small part of the work it shares with the others, then
is timed from building the plan to the last row. ``dedup_rows_per_sec`` is the comparable figure:
rows of the pool deduplicated per second, candidate search to statistics."""

import json
import os
import time

from hitmerge.operators import dedup, hits
from hitmerge.plans import derived
from hitmerge.plans.queries import QUERIES
from hitmerge.session import build_session, cut_lineage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "exact_url_merge", "norm_url_default", "coherence_scores", "page_merge", "candidate_pairs", "dedup_hits",
    "dedup_stats", "veto_histogram", "doc_dedup", "reachable_hits", "search_round", "engine_status",
    "engine_overlap", "text_health", "landed_json", "html_hits", "vertical_domain", "query_terms",
    "rate_variants", "noise_floor", "variance_split", "invalid_flags", "stream_merge",
]


def timed(fn):
    start = time.perf_counter()
    out = fn()
    return round(time.perf_counter() - start, 3), out


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = build_session(f"local[{CPUS}]", int(CPUS), app="bench", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    drain(QUERIES["dedup_hits"](spark, SF_DIR))
    times = {name: timed(lambda: drain(QUERIES[name](spark, SF_DIR)))[0] for name in HEADLINE}

    pool = cut_lineage(hits.pool(derived.raw_hits(spark, SF_DIR)))
    docs = cut_lineage(derived.document_hits(spark, SF_DIR).repartition(int(CPUS)))

    def core(rows):
        r = dedup.dedup(rows)
        drain(r.hits)
        drain(dedup.dedup_stats(rows, r.owners))

    page_sec, doc_sec = timed(lambda: core(pool))[0], timed(lambda: core(docs))[0]
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "dedup_pages": {"rows": pool.count(), "sec": page_sec, "rows_per_sec": round(pool.count() / page_sec)},
        "dedup_documents": {"rows": docs.count(), "sec": doc_sec, "rows_per_sec": round(docs.count() / doc_sec)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
