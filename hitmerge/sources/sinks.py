"""Report sinks: nested JSON, JSON lines, text.

Each hit is one row of the text and line sinks, and each URL it absorbed is a row of its own behind it, so no
row grows with the data; lines are sorted by range partitions. The nested object holds a whole round: it
is for rounds whose engine lists are capped, which bounds it. Larger pools are written as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.text import positions_text, truncate_chars
from hitmerge.operators.numbering import number_rows

KEY = ["query_id", "hit_ord"]
ENVELOPE = ["query", "engines", "generated_at", "elapsed_ms", "engine_status", "dedup", "reachability", "stats"]


def _word(name: str) -> Column:
    return F.lit(fv.REPORT_WORDS[name])


def _sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def _hit(trace: Column | None = None) -> Column:
    """Field order and omitted empties as in the report format."""
    signals = F.struct(*[F.col("signals")[f].alias(f) for f in (
        "score", "score_level", "rerank_score", "authority_score", "source", "card_type")])
    return F.struct(
        "engine", _sorted_map(F.col("positions")).alias("positions"), "title", "snippet", "url",
        F.when(F.col("date") != "", F.col("date")).alias("date"),
        *([] if trace is None else [F.when(F.size(trace) > 0, trace).alias("merged_from")]),
        F.when(F.col("signals").isNotNull(), signals).alias("signals"))


def _alternative() -> Column:
    """What is kept of an absorbed URL, from the columns of the merge trace."""
    return F.struct(F.when(F.col("title") != "", F.col("title")).alias("title"), "engine",
                    F.when(F.col("reason") != "", F.col("reason")).alias("reason"))


def _traces(absorbed: DataFrame, hits: DataFrame) -> DataFrame:
    """Merge trace of the hits that are reported."""
    return absorbed.withColumnRenamed("survivor", "hit_ord").join(hits.select(*KEY), KEY, "left_semi")


def report_json(report: DataFrame, hits: DataFrame, absorbed: DataFrame) -> DataFrame:
    """query_id, json: one object per round, its hits in pool order as ``results``."""
    trace = _traces(absorbed, hits).groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("url", _alternative())))).alias("trace"))
    rows = hits.join(trace, KEY, "left").select(*KEY, _hit(F.col("trace")).alias("hit"))
    results = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("hit_ord", F.to_json("hit").alias("json")))).alias("rows"))
    body = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("")), F.lit("]"))
    head = F.regexp_replace(F.to_json(F.struct(*ENVELOPE)), r"\}$", "")
    return report.join(results, "query_id", "left").select("query_id", F.concat(head, F.lit(',"results":'), body, F.lit("}")).alias("json"))


def report_lines(report: DataFrame, hits: DataFrame, absorbed: DataFrame) -> DataFrame:
    """query_id, line, sub, json: line -1 is the envelope, then each hit in pool order (``sub`` empty) and behind it
    one line for each URL it absorbed (``sub`` is the URL), ``{"merged_from":{url:{...}}}`` of the hit before it."""
    head = report.select("query_id", F.lit(-1).cast("bigint").alias("line"), F.lit("").alias("sub"), F.to_json(F.struct(*ENVELOPE)).alias("json"))
    line = F.col("hit_ord").cast("bigint").alias("line")
    traces = _traces(absorbed, hits).select("query_id", line, F.col("url").alias("sub"), F.to_json(F.struct(
        F.create_map(F.col("url"), _alternative()).alias("merged_from"))).alias("json"))
    return head.unionByName(hits.select("query_id", line, F.lit("").alias("sub"), F.to_json(_hit()).alias("json"))).unionByName(traces)


def hit_block(number: Column) -> Column:
    """Lines of one hit; an empty line stands between hits."""
    lines = F.array_compact(F.array(
        F.when(number > 1, ""),
        F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.col("url")),
        F.concat(_word("title"), truncate_chars(F.col("title"), 90)),
        F.concat(_word("hit_by"), F.array_join("engine", " / "), F.lit("  "), positions_text(F.col("positions"))),
        F.when(F.col("snippet") != "", F.concat(_word("snippet"), truncate_chars(F.col("snippet"), 120)))))
    return F.array_join(lines, "\n")


def alternative_line() -> Column:
    return F.concat(
        _word("alternative"), truncate_chars(F.col("url"), 70),
        F.when(F.col("title") != "", F.concat(_word("quote"), truncate_chars(F.col("title"), 40), _word("quote_end"))).otherwise(""),
        F.lit("  ["), F.array_join("engine", "/"), F.lit("] "), F.col("reason"))


def header_block() -> Column:
    """Lines before the hits, from the envelope; a round without hits says so."""
    n = lambda c: F.col(c).cast("string")
    stage = lambda x: F.concat(F.lit(" | "), x["stage"], F.lit(" "), x["before"].cast("string"), _word("arrow"), x["after"].cast("string"),
                               _word("merged"), x["merged"].cast("string"), _word("merged_end"))
    return F.concat_ws(
        "\n", F.concat(_word("query"), F.col("query")), F.concat(_word("engines"), F.array_join("engines", ", ")),
        F.concat(_word("elapsed"), n("elapsed_ms"), F.lit(" ms")),
        F.concat(_word("raw"), n("dedup.raw"), _word("final"), n("dedup.final"), _word("returned"), n("stats.returned")),
        F.concat(_word("dedup"), F.col("dedup.mode"), _word("mode"), F.format_string("%.2f", F.col("dedup.threshold")), _word("mode_end"),
                 F.array_join(F.transform("dedup.stages", stage), "")),
        F.concat(_word("reach"), n("reachability.hosts_probed"), _word("reach_ok"), n("reachability.hosts_ok"), _word("dropped"),
                 n("reachability.dropped_items"), _word("dropped_end")),
        F.lit("=" * 78), F.when(F.col("stats.returned") == 0, _word("nothing")))


def status_line(s: Column) -> Column:
    """One engine in the status block."""
    return F.concat(
        F.format_string("  %-10s %-4s %3d %s  %5d ms", s["engine"], F.when(s["ok"], "OK").otherwise("FAIL"),
                        s["count"].cast("bigint"), _word("rows"), s["latency_ms"].cast("bigint")),
        F.coalesce(F.concat(F.lit("  "), truncate_chars(s["error"], 90)), F.lit("")))


def report_text(report: DataFrame, hits: DataFrame, absorbed: DataFrame) -> DataFrame:
    """query_id, section, line, sub, text: header (0), hits and the URLs they absorbed (1), engine status (2); a hit or
    a block is one value with line breaks inside."""
    zero, none = F.lit(0).cast("bigint").alias("line"), F.lit("").alias("sub")
    head = report.select("query_id", F.lit(0).alias("section"), zero, none, header_block().alias("text"))
    placed = number_rows(hits, ["query_id"], "hit_ord", "__n")
    body = placed.select("query_id", F.lit(1).alias("section"), F.col("__n").alias("line"), none, hit_block(F.col("__n") + 1).alias("text"))
    traces = _traces(absorbed, hits).join(placed.select(*KEY, "__n"), KEY).select(
        "query_id", F.lit(1).alias("section"), F.col("__n").alias("line"), F.col("url").alias("sub"), alternative_line().alias("text"))
    tail = report.where(F.size("engine_status") > 0).select("query_id", F.lit(2).alias("section"), zero, none, F.array_join(F.concat(
        F.when(F.col("stats.returned") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit("-" * 78), _word("status")), F.transform("engine_status", status_line)), "\n").alias("text"))
    return head.unionByName(body).unionByName(traces).unionByName(tail)


def write_lines(lines: DataFrame, path: str, value: str, *order: str) -> None:
    """Text files in order; range partitions also split a single large round."""
    lines.repartitionByRange("query_id", *order).sortWithinPartitions("query_id", *order) \
        .select(F.col(value).alias("value")).write.mode("overwrite").text(path)
