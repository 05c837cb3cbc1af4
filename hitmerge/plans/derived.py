"""Product tables derived from the given tables by rule, so every query grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge import schemas
from hitmerge.functions.columns import squeeze_white
from hitmerge.functions.urls import probe_target
from hitmerge.operators.numbering import number_rows

QUERY_TEXTS = {
    "en": "thanedble portal ingre", "fr": "lement portal eaux", "de": "schein portal ung",
    "es": "cion portal ado",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _engine(n: Column) -> Column:
    names = F.array(*[F.lit(e) for e in fv.ALL_ENGINES])
    return F.get(names, F.pmod(n, F.lit(len(fv.ALL_ENGINES))).cast("int"))


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, url, query_id, title, snippet (the text of all paragraphs) of raw pages."""
    html = F.col("html")
    body = F.regexp_replace(F.regexp_extract(html, "(?s)</h1>(.*?)</article>", 1), "</?b>", "")
    return pages.select(
        "page_id", "url", F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1).alias("query_id"),
        F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        squeeze_white(F.regexp_replace(body, "<[^>]*>", " ")).alias("snippet"))


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of nine engines over four queries: every page once, some again from a second engine
    with a site name in the title, some from a third with another spelling of the URL."""
    p = page_fields(table(spark, sf_dir, "pages"))
    pid = F.col("page_id")

    def listed(shift: int, url: Column, title: Column) -> Column:
        score = F.when(pid % 4 == 0, (pid % 100) / F.lit(100.0))
        return F.struct(
            _engine(pid + shift).alias("engine"), url.alias("url"), title.alias("title"),
            F.when(pid % 3 == 1, F.concat(F.lit("2024-01-"), F.lpad((pid % 28 + 1).cast("string"), 2, "0")))
            .otherwise("").alias("date"),
            F.when(pid % 2 == 0, F.struct(
                score.alias("score"), F.when(pid % 6 == 0, "high").alias("score_level"),
                F.lit(None).cast("double").alias("rerank_score"),
                F.lit(None).cast("double").alias("authority_score"),
                F.when(pid % 4 == 2, F.concat(F.lit("site "), (pid % 7).cast("string"))).alias("source"),
                F.lit(None).cast("string").alias("card_type"))).cast(schemas.SIGNALS).alias("signals"))

    rows = F.array_compact(F.array(
        listed(0, F.col("url"), F.col("title")),
        F.when(pid % 3 == 0, listed(4, F.col("url"), F.concat(F.col("title"), F.lit(" - Portal")))),
        F.when((pid % 5 == 0) & ~F.contains("url", F.lit("page=")), listed(
            7, F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?utm_source=x")), F.col("title")))))
    flat = p.select("page_id", "query_id", "snippet", F.explode(rows).alias("r")) \
        .select("page_id", "query_id", "snippet", "r.*")
    # One engine can list a page at most once per rule, so (page_id, url) orders its rows. They carry the texts of pages
    # and there are 36 lists only, so their ranges are short.
    placed = number_rows(flat.withColumn("__slot", F.col("page_id") * 2 + F.endswith(
        "url", F.lit("?utm_source=x")).cast("int")), ["query_id", "engine"], "__slot", "ord", chunk=1 << 14)
    query = F.coalesce(*[F.when(F.col("query_id") == k, v) for k, v in QUERY_TEXTS.items()], F.lit(""))
    return placed.select("query_id", query.alias("query"), "engine", "ord", (F.col("ord") + 1).alias("rank"),
                         "title", "url", "snippet", "date", "signals")


def queries(raw: DataFrame) -> DataFrame:
    return raw.select("query_id", "query").distinct()


def host_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "pages").select(probe_target(F.col("url")).alias("t")) \
        .filter("t is not null").select("t.host", "t.port").distinct()
    return t.withColumn("ok", F.length("host") % 5 != 0)


ERROR_TEXTS = [
    "Exa: HTTP 0 缺少 API Key", "SerpApi: 超时/取消: context deadline exceeded",
    "Tavily: HTTP 429 Too Many Requests", "Metaso: HTTP 503 Service Unavailable",
    "Quark: 首页被反爬限流（1200B 惩罚页，非解析问题）", "Quark: 首页响应过短（900B），疑似错误页",
    "Qianfan: 响应非预期 JSON: invalid character", "未实现的引擎", "已放弃（全局超时）",
]


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per engine answer; the round is the day."""
    e = table(spark, sf_dir, "events")
    texts = F.array(*[F.lit(t) for t in ERROR_TEXTS])
    bad = F.col("event_type") == "error"
    return e.select(
        F.date_format("ts", "yyyy-MM-dd").alias("query_id"), _engine(F.col("user_id")).alias("engine"),
        (~bad).alias("ok"), F.floor(F.col("value") * 100).cast("bigint").alias("latency_ms"),
        F.when(bad, F.get(texts, F.pmod(F.col("event_id"), F.lit(len(ERROR_TEXTS))).cast("int")))
        .otherwise("").alias("error"),
        F.col("ts").cast("timestamp").alias("arrived_at"), F.col("event_id").alias("event_id"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged lists: engine = source, keyword = language, labels from quality and toxicity."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = number_rows(d.select("doc_id", "source", "lang", "quality", "toxic"), ["source", "lang"],
                       "doc_id", "__pos")
    off = (F.col("toxic") == 1) & (F.col("quality") == 0)
    return rows.select(
        F.col("source").alias("engine"), F.col("lang").alias("keyword_id"), (F.col("__pos") + 1).alias("rank"),
        (F.col("toxic") == 1).alias("ad"), off.alias("off"), (F.col("quality") == 0).alias("bad"))


def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a result pool: the whole text is the snippet, its first line the title."""
    d = table(spark, sf_dir, "documents")
    slug = F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")
    return d.select(
        F.col("lang").alias("query_id"), F.col("doc_id").alias("hit_ord"),
        F.array("source").alias("engine"), F.create_map("source", F.lit(1).cast("bigint")).alias("positions"),
        F.regexp_extract("text", "^([^\n.]*)", 1).alias("title"), F.col("text").alias("snippet"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/"),
                 slug).alias("url"),
        F.lit(None).cast("string").alias("date"), F.lit(None).cast(schemas.SIGNALS).alias("signals"))


def judged_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged lists of engines that gave no answer to some keywords."""
    return judged(spark, sf_dir).filter((F.ascii(F.substring("engine", -1, 1)) + F.ascii(F.substring("keyword_id", -1, 1))) % 4 != 0)


def garbled_titles(raw: DataFrame) -> DataFrame:
    """Every third title in quotation marks and decoded by the wrong character set."""
    quoted = F.concat(F.lit("„"), F.col("title"), F.lit("“"))
    return raw.withColumn("title", F.when(F.col("ord") % 3 == 0, F.decode(F.encode(quoted, "UTF-8"), "ISO-8859-1")).otherwise(F.col("title")))


def document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a pool, and of every third also a continuation: same title, longer address, the text up to a half or
    to three quarters. Documents have even ``hit_ord``, continuations odd."""
    docs = document_hits(spark, sf_dir)
    n = F.col("hit_ord")
    some = docs.filter(n % 3 == 0)
    longer = F.concat(F.col("url"), F.substring(F.lit("continuationofthepage"), F.lit(1), (8 + n % 13).cast("int")))
    part = F.substring(F.col("snippet"), F.lit(1), F.floor(F.length("snippet") * F.when(n % 2 == 0, 3).otherwise(2) / 4).cast("int"))
    return docs.withColumn("hit_ord", n * 2).unionByName(some.withColumns({"url": longer, "snippet": part, "hit_ord": n * 2 + 1}))
