"""Result pages of one engine merged into one list with early stop."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.columns import trim_white
from hitmerge.functions.urls import clean_shell_url, unwrap_redirect, url_class


def page_merge(rows: DataFrame, engine: str, limit: int, page_log: DataFrame | None = None,
               max_pages: int | None = None) -> DataFrame:
    """Rows (query_id, page, pos, title, url, ...) of an engine as its final ranked list.

    The first occurrence of a key wins; pages from the stop page on are left out; the list is cut
    at ``limit`` and ranked. ``page_log`` (query_id, page, ok, body_bytes) tells failed pages.
    A reached limit needs no stop rule of its own: later rows rank behind the cut anyway."""
    rule = fv.PAGING[engine]
    most = fv.ENGINE_LIMITS[engine]
    limit = min(max(limit, 1), most) if most else max(limit, 1)
    pages = max_pages or rule["max_pages"]
    if engine == "bing":
        pages = min(pages, math.ceil(limit / fv.BING_ROWS_PER_PAGE))

    asked = rows.filter(F.col("page") <= pages)
    listed = asked.filter(F.col("url") != "")
    if rule["key"] == "shell":
        listed = listed.filter((trim_white(F.col("title")) != "")
                               & ~url_class(F.col("url")).isin("media", "transit")) \
            .withColumn("url", clean_shell_url(F.col("url")))
    elif rule["key"] == "redirect":
        listed = listed.withColumn("url", unwrap_redirect(F.col("url")))

    keep = [c for c in listed.columns if c not in ("query_id", "url", "page", "pos")]
    first = listed.groupBy("query_id", "url").agg(
        F.min_by(F.struct("page", "pos", *keep), F.struct("page", "pos")).alias("first")) \
        .select("query_id", "url", *[F.col("first")[c].alias(c) for c in ["page", "pos", *keep]])

    stops = None
    if rule["stop_on_no_new"] or rule["stop_on_empty"]:
        # A page of rows without links is not an empty page.
        counted = first if rule["stop_on_no_new"] else asked
        start = 2 if rule["stop_on_no_new"] else 1
        per_page = counted.groupBy("query_id").agg(
            *[F.count_if(F.col("page") == p).alias(f"p{p}") for p in range(1, pages + 1)])
        stops = per_page.select("query_id", F.coalesce(
            *[F.when(F.col(f"p{p}") == 0, p) for p in range(start, pages + 1)],
            F.lit(pages + 1)).alias("stop"))
    if page_log is not None:
        bad = ~F.col("ok")
        if engine == "quark":
            bad = bad | (F.col("body_bytes") < fv.MIN_PAGE_BYTES)
        failed = page_log.filter(bad).groupBy("query_id").agg(F.min("page").alias("stop"))
        stops = failed if stops is None else stops.unionByName(failed) \
            .groupBy("query_id").agg(F.min("stop").alias("stop"))
    if stops is not None:
        first = first.join(stops, "query_id", "left") \
            .filter(F.col("stop").isNull() | (F.col("page") < F.col("stop"))).drop("stop")
    order = W.partitionBy("query_id").orderBy("page", "pos")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
