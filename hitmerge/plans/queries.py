"""Registered queries, each with the SQL that checks it. All read whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge import schemas
from hitmerge.functions import terms, text, urls
from hitmerge.functions.columns import first_non_blank
from hitmerge.operators import coherence, dedup, hits, paging, quality, reach, status, verticals
from hitmerge.operators.kept_dedup import KeptDedup
from hitmerge.plans import derived, jobs
from hitmerge.plans import oracle as o
from hitmerge.session import cut_lineage, ensure_checkpoint_dir
from hitmerge.sources import landed, logs, pages as page_source, sinks
from hitmerge.streaming import rounds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def c(name: str) -> Column:
    return F.col(name)


def _raw(spark, sf):
    return derived.raw_hits(spark, sf)


def _pool(spark, sf):
    return cut_lineage(hits.pool(_raw(spark, sf)))


def _deduped(spark, sf):
    pool = _pool(spark, sf)
    return pool, dedup.dedup(pool)


def _stage(spark) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"


def _joined(arr: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(arr), sep)


# ---- pool ----------------------------------------------------------------------------------
@query("exact_url_merge", o.with_(o.POOL) + """SELECT query_id, url, engines, '(' || positions || ')' AS positions,
 title, md5(snippet) AS snippet_md5, coalesce(date, '') AS date FROM pool""")
def exact_url_merge(spark, sf):
    return hits.exact_merge(_raw(spark, sf)).select(
        "query_id", "url", F.array_join("engine", "/").alias("engines"),
        text.positions_text(c("positions")).alias("positions"), "title", F.md5("snippet").alias("snippet_md5"),
        F.coalesce("date", F.lit("")).alias("date"))


@query("signals_merge", o.with_(o.POOL) + """SELECT query_id, url, CASE WHEN score > 0 THEN score END AS score,
 score_level, source, score > 0 OR score_level IS NOT NULL OR source IS NOT NULL AS has_signals
 FROM pool WHERE score > 0 OR score_level IS NOT NULL OR source IS NOT NULL""")
def signals_merge(spark, sf):
    return hits.exact_merge(_raw(spark, sf)).filter("signals is not null").select(
        "query_id", "url", "signals.score", "signals.score_level", "signals.source",
        c("signals").isNotNull().alias("has_signals"))


@query("pool_order", o.with_(o.POOL) + "SELECT query_id, hit_ord, url FROM pool")
def pool_order(spark, sf):
    return hits.pool(_raw(spark, sf)).select("query_id", "hit_ord", "url")


@query("engine_cap", o.with_(o.RAW) + "SELECT query_id, engine, ord, url FROM raw WHERE rank <= 15")
def engine_cap(spark, sf):
    return hits.cap_per_engine(hits.drop_blank_urls(_raw(spark, sf))).select("query_id", "engine", "ord", "url")


@query("rank_fallback", o.with_(o.RAW) + """SELECT query_id, engine, url,
 CASE WHEN rank % 3 = 0 THEN ord + 1 ELSE rank + 100 END AS rank FROM raw""")
def rank_fallback(spark, sf):
    given = F.when(c("rank") % 3 == 0, F.lit(0)).otherwise(c("rank") + 100)
    return hits.with_rank(_raw(spark, sf).withColumn("rank", given)).select("query_id", "engine", "url", "rank")


@query("union_engines", o.with_(o.RAW) + "SELECT engine, count(*) AS n, count(DISTINCT url) AS urls FROM raw GROUP BY engine")
def union_engines(spark, sf):
    # The lists lie in one table here, which is read once; separate lists are united in landed_json.
    return _raw(spark, sf).groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls"))


@query("requested_limits", "SELECT event_id, CASE ({e})[user_id % 9 + 1] {w} ELSE greatest(user_id, 1) END AS rows FROM events".format(
    e=o.ENGINES, w=" ".join(f"WHEN '{k}' THEN least(greatest(user_id, 1), {v})" for k, v in fv.ENGINE_LIMITS.items() if v)))
def requested_limits(spark, sf):
    e = derived.table(spark, sf, "events")
    return e.select("event_id", hits.requested_limit(c("user_id"), derived._engine(c("user_id"))).alias("rows"))


_PAGED = """SELECT query_id, engine, 1 + (ord // 4) AS page, ord AS pos, title, url FROM raw
 WHERE engine IN ('bing', 'quark', 'serpapi')"""


def _paged(spark, sf):
    """Lists of the paging engines cut into pages of four; the last pages repeat earlier URLs."""
    raw = _raw(spark, sf).filter(c("engine").isin(*fv.PAGING))
    return raw.select("query_id", "engine", (1 + F.floor(c("ord") / 4)).alias("page"), c("ord").alias("pos"),
                      "title", "url")


def _page_log(rows):
    """Page 3 of two of the queries failed."""
    return rows.select("query_id", "page").distinct().select(
        "query_id", "page", (~((c("page") == 3) & c("query_id").isin("de", "fr"))).alias("ok"),
        F.lit(9000).alias("body_bytes"))


@query("page_merge", o.with_(o.RAW, f"pg AS ({_PAGED})", """lim AS (SELECT *, CASE engine WHEN 'bing' THEN 2 ELSE 3 END AS pages FROM pg),
first AS (SELECT query_id, engine, url, arg_min({'page': page, 'pos': pos, 'title': title}, page * 1000000 + pos) AS r
 FROM lim WHERE page <= pages AND NOT (page >= 3 AND query_id IN ('de', 'fr')) GROUP BY ALL)""") + """
SELECT query_id, engine, url, r.title AS title, row_number() OVER (PARTITION BY query_id, engine ORDER BY r.page, r.pos) AS rank
 FROM first QUALIFY row_number() OVER (PARTITION BY query_id, engine ORDER BY r.page, r.pos) <= 15""")
def page_merge(spark, sf):
    rows = cut_lineage(_paged(spark, sf))
    parts = []
    for e in fv.PAGING:
        own = rows.filter(c("engine") == e)
        parts.append(paging.page_merge(own, e, fv.PER_ENGINE_CAP, _page_log(own)).select(
            "query_id", "engine", "url", "title", "rank"))
    return hits.union_engines(*parts)


# ---- URLs ----------------------------------------------------------------------------------
def _norm_query(mode):
    @query(f"norm_url_{mode}", o.with_(o.url_ctes("pages", mode=mode)) + "SELECT page_id, norm_url FROM u")
    def norm(spark, sf):
        return derived.table(spark, sf, "pages").select("page_id", urls.norm_url(c("url"), mode).alias("norm_url"))


for _mode in ("default", "minimal", "none"):
    _norm_query(_mode)


@query("url_parts", o.with_(o.url_ctes("pages")) + """SELECT page_id, host, site, head,
 array_to_string(list_sort(list_transform(list_filter(string_split(substr(x.q, 2), '&'), lambda k: k <> ''),
 lambda k: lower(string_split(k, '=')[1]))), '&') AS query_keys, x.host AS target_host,
 CASE WHEN x.scheme = 'https' THEN '443' ELSE '80' END AS target_port FROM u""")
def url_parts(spark, sf):
    p = derived.table(spark, sf, "pages").withColumn("t", urls.probe_target(c("url")))
    return p.select("page_id", urls.host_of(c("url")).alias("host"),
                    urls.registrable_site(urls.host_of(c("url"))).alias("site"),
                    urls.head_segment(c("url")).alias("head"), urls.query_keys(c("url")).alias("query_keys"),
                    c("t.host").alias("target_host"), c("t.port").alias("target_port"))


@query("redirect_unwrap", """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN
 'https://www.bing.com/ck/a?!&p=7&u=a1*' || page_id || '&ntb=1' ELSE url END AS target FROM pages""")
def redirect_unwrap(spark, sf):
    # Spark breaks the code into lines of 76; an address holds none.
    coded = F.rtrim(F.translate(F.base64(F.encode("url", "UTF-8")), "+/\r\n", "-_"), F.lit("="))
    payload = F.when(c("page_id") % 3 == 2, F.concat(F.lit("*"), c("page_id").cast("string"))).otherwise(coded)
    wrapped = F.concat(F.lit("https://www.bing.com/ck/a?!&p=7&u=a1"), payload, F.lit("&ntb=1"))
    link = F.when(c("page_id") % 3 == 0, c("url")).otherwise(wrapped)
    return derived.table(spark, sf, "pages").select("page_id", urls.unwrap_redirect(link).alias("target"))


# Addresses of every kind, made from the page number; works as Spark and as DuckDB SQL.
_SHELLS = """CASE page_id % 8
 WHEN 0 THEN 'https://baike.quark.cn/baike?id=' || page_id || '&uc_param_str=x&from=y&q=a%20b'
 WHEN 1 THEN 'https://page.sm.cn/blm/video-page-' || page_id || '/video?h=www.bilibili.com'
 WHEN 2 THEN 'https://m.quark.cn/s/' || page_id || '?q=x'
 WHEN 3 THEN 'https://m.quark.cn/s?q=x&qtab=image&sid=' || page_id
 WHEN 4 THEN 'https://p.quark.cn/' || page_id || '/char?entity=x'
 WHEN 5 THEN 'https://page.sm.cn/blm/midpage-' || page_id || '/index?sid=1&q=x'
 ELSE url END"""


@query("shell_clean", f"""SELECT page_id, CASE page_id % 8
 WHEN 0 THEN 'https://baike.quark.cn/baike?id=' || page_id || '&q=a%20b'
 WHEN 3 THEN 'https://m.quark.cn/s?q=x&qtab=image'
 WHEN 5 THEN 'https://page.sm.cn/blm/midpage-' || page_id || '/index?q=x' ELSE {_SHELLS} END AS cleaned FROM pages""")
def shell_clean(spark, sf):
    return derived.table(spark, sf, "pages").select(
        "page_id", urls.clean_shell_url(F.expr(_SHELLS)).alias("cleaned"))


@query("url_class_counts", """SELECT CASE WHEN page_id % 8 IN (0, 5) THEN 'shell' WHEN page_id % 8 IN (1, 3, 4) THEN 'media'
 WHEN page_id % 8 = 2 THEN 'transit' ELSE 'external' END AS url_class, count(*) AS n FROM pages GROUP BY 1""")
def url_class_counts(spark, sf):
    return derived.table(spark, sf, "pages").groupBy(urls.url_class(F.expr(_SHELLS)).alias("url_class")).agg(
        F.count(F.lit(1)).alias("n"))


@query("media_transit_drop", f"SELECT page_id, {_SHELLS} AS url FROM pages WHERE page_id % 8 IN (0, 5, 6, 7)")
def media_transit_drop(spark, sf):
    p = derived.table(spark, sf, "pages").select("page_id", F.expr(_SHELLS).alias("url"))
    return hits.only_web_links(hits.drop_media_and_transit(p))


# ---- text ----------------------------------------------------------------------------------
_TITLES = o.with_(o.PAGES, f"""tt AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN title || ' - Portal' WHEN 1 THEN title || '_Site | News'
 ELSE title END AS title FROM p), t1 AS (SELECT *, {o.strip_once(o.trim('title'))} AS s1 FROM tt),
t2 AS (SELECT *, {o.strip_once('s1')} AS s2 FROM t1)""")


def _titles(spark, sf):
    p = derived.page_fields(derived.table(spark, sf, "pages"))
    pid = c("page_id") % 4
    return p.withColumn("title", F.when(pid == 0, F.concat("title", F.lit(" - Portal"))).when(
        pid == 1, F.concat("title", F.lit("_Site | News"))).otherwise(c("title")))


@query("site_suffix", _TITLES + "SELECT page_id, s2 AS stripped FROM t2")
def site_suffix(spark, sf):
    return _titles(spark, sf).select("page_id", text.strip_site_suffix(c("title")).alias("stripped"))


@query("norm_title", _TITLES + f"SELECT page_id, {o.norm_text('s2')} AS norm_title FROM t2")
def norm_title(spark, sf):
    return _titles(spark, sf).select("page_id", text.norm_title(c("title")).alias("norm_title"))


@query("norm_text", f"SELECT doc_id, md5({o.norm_text('text')}) AS digest FROM documents")
def norm_text(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", F.md5(text.norm_text(c("text"))).alias("digest"))


_NOISY = "'![img](http://x/' || doc_id || '.png) ' || text || ' [more](https://e.x/' || doc_id || ')'"


@query("snippet_clean", "WITH t AS (SELECT doc_id, " + o.squeeze(
    f"regexp_replace(regexp_replace({_NOISY}, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')")
    + " AS t FROM documents) SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM t")
def snippet_clean(spark, sf):
    d = derived.table(spark, sf, "documents").select("doc_id", text.clean_snippet(F.expr(_NOISY)).alias("t"))
    return d.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query("first_non_blank", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN source ELSE 'both' END AS picked FROM documents""")
def first_non_blank_query(spark, sf):
    d = c("doc_id") % 3
    a = F.when(d == 0, c("lang")).when(d == 1, "　 \t").otherwise("both")
    return derived.table(spark, sf, "documents").select(
        "doc_id", first_non_blank(F.lit(""), F.lit(None).cast("string"), a, c("source")).alias("picked"))


@query("mojibake_repair", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[^\x{00}-\x{FF}]') OR NOT regexp_matches(text, '[^\x{00}-\x{7F}]')
 THEN length(text) ELSE strlen(text) END AS chars,
 regexp_matches(text, '[^\x{00}-\x{FF}]') OR NOT regexp_matches(text, '[^\x{00}-\x{7F}]') AS restored FROM documents""")
def mojibake_repair(spark, sf):
    """Every text is garbled first; the ones that can be told apart come back whole."""
    garbled = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    d = derived.table(spark, sf, "documents").withColumn("fixed", text.repair_mojibake(garbled))
    return d.select("doc_id", F.length("fixed").alias("chars"), (c("fixed") == c("text")).alias("restored"))


@query("ngram_counts", o.with_(o.PAGES, f"n AS (SELECT *, {o.norm_text('url')} AS nu, {o.norm_text('title')} AS nt, {o.norm_text('snippet')} AS ns FROM p)")
       + f"SELECT page_id, len({o.ngrams('nu', 4)}) AS url_grams, len({o.ngrams('nt', 3)}) AS title_grams, len({o.ngrams('ns', 3)}) AS snippet_grams FROM n")
def ngram_counts(spark, sf):
    size = lambda col, n: F.size(text.ngrams(c(col), n))
    return derived.page_fields(derived.table(spark, sf, "pages")).select(
        "page_id", size("url", 4).alias("url_grams"), size("title", 3).alias("title_grams"),
        size("snippet", 3).alias("snippet_grams"))


@query("title_jaccard", o.with_(o.PAGES, f"n AS (SELECT *, {o.norm_text('title')} AS nt, {o.norm_text('snippet')} AS ns FROM p)")
       + f"SELECT page_id, round({o.jaccard(o.ngrams('nt', 3), o.ngrams('ns', 3))}, 6) AS similarity FROM n")
def title_jaccard(spark, sf):
    return derived.page_fields(derived.table(spark, sf, "pages")).select("page_id", F.round(text.jaccard(
        text.ngrams(c("title"), 3), text.ngrams(c("snippet"), 3)), 6).alias("similarity"))


@query("number_sets", o.with_(o.PAGES) + r"""SELECT page_id, array_to_string(list_sort(list_distinct(
 regexp_extract_all(url || ' ' || title, '\p{Nd}+'))), ',') AS numbers FROM p""")
def number_sets(spark, sf):
    return derived.page_fields(derived.table(spark, sf, "pages")).select(
        "page_id", _joined(text.number_set(c("url"), c("title"))).alias("numbers"))


@query("query_locale", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')
 THEN 'cn' ELSE 'us' END AS country, CASE WHEN doc_id % 4 = 0 OR regexp_matches(text, '[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]')
 THEN 'zh-cn' ELSE 'en' END AS language FROM documents""")
def query_locale(spark, sf):
    q = F.when(c("doc_id") % 4 == 0, F.concat("text", F.lit(" 微生物"))).otherwise(c("text"))
    return derived.table(spark, sf, "documents").select("doc_id", text.query_locale(q).alias("l")) \
        .select("doc_id", "l.country", "l.language")


@query("card_type", """SELECT event_id, CASE event_id % 3 WHEN 1 THEN 'ss_' || event_type ELSE '' END AS card_type FROM events""")
def card_type(spark, sf):
    e = c("event_id") % 3
    attr = F.when(e == 0, F.replace("props", F.lit('"k"'), F.lit('"sc"'))) \
        .when(e == 1, F.concat(F.lit('{"sc": " ss_'), c("event_type"), F.lit(' "}'))).otherwise("broken {")
    return derived.table(spark, sf, "events").select("event_id", text.card_type(attr).alias("card_type"))


@query("truncate_chars", "SELECT doc_id, CASE WHEN length(text) <= 90 THEN text ELSE rtrim(substr(text, 1, 89), ' ') || '…' END AS short FROM documents")
def truncate_chars(spark, sf):
    return derived.table(spark, sf, "documents").select("doc_id", text.truncate_chars(c("text"), 90).alias("short"))


# ---- query terms and routing ---------------------------------------------------------------
_STEM = ("CASE WHEN regexp_matches(w, '[^\\x{00}-\\x{7F}]') OR w LIKE '%ss' THEN w "
         "WHEN w LIKE '%ing' AND length(w) >= 7 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) >= 6 THEN w[:-3] "
         "WHEN w LIKE '%es' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%s' AND length(w) >= 5 THEN w[:-2] ELSE w END")
_OPS = "|".join(fv.QUERY_OPERATORS)
_TERMS = f"""tok AS (SELECT conv_id, turn, list_filter(string_split({o.squeeze('text')}, ' '), lambda t: t <> ''
 AND t NOT IN ('OR', 'AND', 'NOT', '|', '&') AND NOT starts_with(t, '-') AND NOT regexp_matches(t, '(?i)^[+-]?({_OPS}):')) AS toks
 FROM conversations),
tt AS (SELECT conv_id, turn, list_transform(toks, lambda t: list_transform(list_filter(
 regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+(?:\\.[0-9]+)+|[\\p{{L}}\\p{{N}}]+'),
 lambda w: length(w) >= 2 AND w NOT IN {o._IN(fv.STOP_WORDS)}), lambda w: {_STEM})) AS tt FROM tok),
fp AS (SELECT *, list_position(list_transform(tt, lambda x: len(x) > 0), true) AS p FROM tt),
ar AS (SELECT conv_id, turn, coalesce(tt[p], []) AS anchor, coalesce(flatten(tt[p + 1:]), []) AS rest FROM fp)"""


@query("query_terms", o.with_(_TERMS) + """SELECT conv_id, turn, array_to_string(anchor, ',') AS anchor,
 array_to_string(list_sort(list_distinct(list_filter(rest, lambda t: len(list_filter(anchor, lambda a: contains(t, a) OR contains(a, t))) = 0))), ',') AS rest
 FROM ar""")
def query_terms(spark, sf):
    d = derived.table(spark, sf, "conversations").withColumn("t", terms.query_terms(c("text")))
    return d.select("conv_id", "turn", F.array_join("t.anchor", ",").alias("anchor"), _joined(c("t.rest")).alias("rest"))


_PATTERNS = "CASE query_id WHEN 'en' THEN 'portal|ingre' WHEN 'fr' THEN 'portal|eaux' WHEN 'de' THEN 'portal|\\bung\\b' ELSE 'portal|\\bado\\b' END"
_SCORES = f"""sc AS (SELECT query_id, engine, CASE WHEN count(*) >= 4 THEN avg(regexp_matches(lower(title || ' ' || snippet || ' ' || url),
 {_PATTERNS})::INT) END AS coherence FROM raw GROUP BY ALL)"""


@query("coherence_scores", o.with_(o.RAW, _SCORES) + "SELECT query_id, engine, round(coherence, 6) AS coherence FROM sc")
def coherence_scores(spark, sf):
    raw = _raw(spark, sf)
    return coherence.bucket_scores(raw, derived.queries(raw)).withColumn("coherence", F.round("coherence", 6))


@query("decoy_engines", o.with_(o.RAW, _SCORES) + """SELECT query_id, engine, coalesce(coherence < 0.3
 AND max(coherence) OVER (PARTITION BY query_id) >= 0.5, false) AS decoy FROM sc""")
def decoy_engines(spark, sf):
    raw = _raw(spark, sf)
    return coherence.judge_decoys(coherence.bucket_scores(raw, derived.queries(raw))).select("query_id", "engine", "decoy")


_DOMAIN = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words.split()) + f" THEN '{d}'"
                             for d, words in fv.DOMAIN_KEYWORDS) + " ELSE '' END"


@query("vertical_domain", f"SELECT conv_id, turn, {_DOMAIN} AS domain FROM conversations")
def vertical_domain(spark, sf):
    return derived.table(spark, sf, "conversations").select(
        "conv_id", "turn", verticals.vertical_domain(c("text")).alias("domain"))


def _catalog(spark, sf):
    n = derived.table(spark, sf, "nation")
    domains = F.array(*[F.lit(d) for d, _ in fv.DOMAIN_KEYWORDS])
    need = lambda cond: F.struct(cond.alias("required"))
    return n.select(
        F.get(domains, (c("n_nationkey") % len(fv.DOMAIN_KEYWORDS)).cast("int")).alias("domain"),
        c("n_nationkey").alias("pos"), F.when(c("n_nationkey") % 5 == 4, "").otherwise(F.lower("n_name")).alias("sub_domain"),
        F.concat(F.lit("about "), F.lower("n_name")).alias("description"),
        F.create_map(F.lit("region"), need(c("n_regionkey") % 2 == 0), F.lit("lang"), need(c("n_nationkey") % 3 > 0)).alias("params"))


@query("sub_domain", o.with_(f"""q AS (SELECT conv_id * 1000 + turn AS query_id, text, {_DOMAIN} AS domain,
 list_filter(string_split({o.squeeze("replace(lower(text), '，', ' ')")}, ' '), lambda w: length(w) >= 2) AS words FROM conversations)""",
 f"""cat AS (SELECT ({o._L([d for d, _ in fv.DOMAIN_KEYWORDS])})[n_nationkey % 16 + 1] AS domain, n_nationkey AS pos,
 CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE lower(n_name) END AS sub, 'about ' || lower(n_name) AS descr,
 list_filter([CASE WHEN n_nationkey % 3 > 0 THEN 'lang' END, CASE WHEN n_regionkey % 2 = 0 THEN 'region' END], lambda x: x IS NOT NULL) AS req FROM nation)""",
 """best AS (SELECT query_id, arg_min({'tag': CASE WHEN sub <> '' THEN sub ELSE domain END, 'req': req},
 (len(list_filter(words, lambda w: contains(sub, w) OR contains(descr, w))) = 0)::INT * 1000 + pos) AS b
 FROM q JOIN cat USING (domain) GROUP BY query_id)""") + """
SELECT query_id, domain, coalesce(b.tag, '') AS tag, coalesce(array_to_string(b.req, ','), '') AS required
 FROM q LEFT JOIN best USING (query_id)""")
def sub_domain(spark, sf):
    q = derived.table(spark, sf, "conversations").select(
        (c("conv_id") * 1000 + c("turn")).alias("query_id"), c("text").alias("query"))
    return verticals.resolve_sub_domain(q, _catalog(spark, sf)).select(
        "query_id", "domain", "tag", F.array_join("required", ",").alias("required"))


# ---- deduplication -------------------------------------------------------------------------
@query("candidate_pairs", o.with_(o.DEDUP) + """SELECT query_id, count(*) FILTER (WHERE su) AS url_pairs, count(*) FILTER (WHERE st) AS title_pairs,
 count(*) FILTER (WHERE ss) AS snippet_pairs, count(*) AS candidate_pairs FROM c1 GROUP BY query_id""")
def candidate_pairs(spark, sf):
    return dedup.candidate_counts(_pool(spark, sf)).filter("candidate_pairs > 0")


@query("pair_decisions", o.with_(o.DEDUP) + "SELECT query_id, owner AS survivor, j AS absorbed, reason FROM own")
def pair_decisions(spark, sf):
    _, r = _deduped(spark, sf)
    return r.owners.select("query_id", c("owner").alias("survivor"), c("pos").alias("absorbed"), "reason")


@query("kept_decisions", o.with_(o.DEDUP) + "SELECT query_id, owner AS survivor, j AS absorbed, reason FROM own")
def kept_decisions(spark, sf):
    """The decisions of the whole pool, kept up to date while its rows come in two lots in no order."""
    raw = _raw(spark, sf).withColumn("lot", F.pmod(F.xxhash64("url", "engine", "ord"), F.lit(2)))
    kept = KeptDedup(spark, _stage(spark), parts=16)
    for lot in range(2):
        now = hits.exact_merge(raw.where(c("lot") <= lot).join(raw.where(c("lot") == lot).select("query_id", "url"), ["query_id", "url"], "left_semi").drop("lot"))
        kept.add(now, lot)
    return kept.owners().select("query_id", c("owner").alias("survivor"), c("pos").alias("absorbed"), "reason")


@query("veto_histogram", o.with_(o.DEDUP) + """SELECT e.query_id, veto, count(*) AS n FROM e JOIN s5 ON s5.query_id = e.query_id AND s5.i = e.i
 LEFT JOIN own ON own.query_id = e.query_id AND own.j = e.j WHERE veto IS NOT NULL AND (owner IS NULL OR owner > e.i) GROUP BY ALL""")
def veto_histogram(spark, sf):
    pool, r = _deduped(spark, sf)
    return dedup.veto_histogram(pool, r.owners)


@query("pass_histogram", o.with_(o.DEDUP) + """SELECT query_id, evidence, count(*) AS n FROM (SELECT query_id, unnest(string_split(reason, ',')) AS evidence FROM own)
 WHERE NOT starts_with(evidence, 'd1:') GROUP BY ALL""")
def pass_histogram(spark, sf):
    return dedup.pass_histogram(_deduped(spark, sf)[1].owners)


@query("dedup_hits", o.with_(o.SURVIVORS) + """SELECT kept.query_id, kept.hit_ord, url, title, md5(snippet) AS snippet_md5,
 '(' || positions || ')' AS positions, coalesce(date, '') AS date, CASE WHEN score > 0 THEN score END AS score, source
 FROM kept JOIN kpos ON kpos.query_id = kept.query_id AND kpos.hit_ord = kept.hit_ord""")
def dedup_hits(spark, sf):
    return _deduped(spark, sf)[1].hits.select(
        "query_id", "hit_ord", "url", "title", F.md5("snippet").alias("snippet_md5"),
        text.positions_text(c("positions")).alias("positions"), F.coalesce("date", F.lit("")).alias("date"),
        "signals.score", "signals.source")


@query("merged_from", o.with_(o.DEDUP) + """SELECT own.query_id, own.owner AS survivor, f.url, f.title, f.engines, own.reason
 FROM own JOIN f ON f.query_id = own.query_id AND f.hit_ord = own.j""")
def merged_from(spark, sf):
    return _deduped(spark, sf)[1].absorbed.select(
        "query_id", "survivor", "url", "title", F.array_join("engine", "/").alias("engines"), "reason")


@query("dedup_stats", o.with_(o.DEDUP) + """SELECT f.query_id, 'conservative' AS mode, 0.9 AS threshold, count(*) AS raw, count(*) - count(own.j) AS final,
 count(own.j) AS total_merged, count(*) FILTER (WHERE reason LIKE 'd1:url%') AS d1_url_exact_merged,
 count(*) FILTER (WHERE reason NOT LIKE 'd1:url%') AS d2_judged_merged,
 count(*) - count(*) FILTER (WHERE reason LIKE 'd1:url%') AS d1_url_exact_after
 FROM f LEFT JOIN own ON own.query_id = f.query_id AND own.j = f.hit_ord GROUP BY f.query_id""")
def dedup_stats(spark, sf):
    pool, r = _deduped(spark, sf)
    return dedup.dedup_stats(pool, r.owners)


_DOC = "translate(doc_id::VARCHAR, '0123456789', 'abcdefghij')"
_DOCS = f"""docs AS (SELECT lang AS query_id, doc_id AS hit_ord, regexp_extract(text, '^([^\\n.]*)', 1) AS title, text AS snippet,
 'https://' || source || '.example.org/' || lang || '/' || {_DOC} AS url, source AS engines FROM documents)"""
_DOC_DEDUP = o.with_(_DOCS, o.feature_ctes("docs"), o.pair_ctes(), o.owner_ctes())


@query("doc_dedup", _DOC_DEDUP + "SELECT query_id, owner AS survivor, j AS absorbed, reason FROM own")
def doc_dedup(spark, sf):
    """Whole documents as snippets: copies and near copies inside one source."""
    docs = cut_lineage(derived.document_hits(spark, sf))
    return dedup.find_owners(docs).select("query_id", c("owner").alias("survivor"), c("pos").alias("absorbed"), "reason")


@query("merge_audit", _DOC_DEDUP + """SELECT own.query_id, owner AS survivor, own.j AS absorbed, own.reason, round(usim, 6) AS url_sim, round(tsim, 6) AS title_sim,
 round(ssim, 6) AS snippet_sim, round(least(tsim - 0.9, CASE WHEN contains(own.reason, 'text_high') THEN ssim - 0.85 ELSE usim - 0.7 END), 6) AS margin,
 round(least(tsim - 0.9, CASE WHEN contains(own.reason, 'text_high') THEN ssim - 0.85 ELSE usim - 0.7 END), 6) < 0.05 AS review
 FROM own JOIN e ON e.query_id = own.query_id AND e.i = own.owner AND e.j = own.j WHERE own.reason NOT LIKE 'd1:url%'""")
def merge_audit(spark, sf):
    docs = cut_lineage(derived.document_hits(spark, sf))
    a = dedup.merge_audit(docs, dedup.find_owners(docs))
    return a.withColumns({n: F.round(n, 6) for n in ("url_sim", "title_sim", "snippet_sim")})


def _near_misses(docs):
    """The given table is read again for the texts, which are not stored a second time; features and texts serve both steps."""
    feats = cut_lineage(dedup.features(docs))
    texts = dedup.texts_of(docs, feats)
    return dedup.near_misses(docs, dedup.find_owners(docs, feats=feats, texts=texts), feats=feats, texts=texts)


@query("near_misses", _DOC_DEDUP + """SELECT * FROM (SELECT e.query_id, e.i, e.j, round(least(CASE WHEN c3.sh THEN greatest(0.9 - e.tsim, 0.85 - e.ssim) END,
 greatest(0.7 - e.usim, 0.9 - e.tsim)), 6) AS gap FROM e JOIN c3 USING (query_id, i, j) JOIN s5 ON s5.query_id = e.query_id AND s5.i = e.i
 LEFT JOIN own ON own.query_id = e.query_id AND own.j = e.j
 WHERE e.veto IS NULL AND e.reason IS NULL AND (owner IS NULL OR owner > e.i)) WHERE gap < 0.15""")
def near_misses(spark, sf):
    return _near_misses(derived.document_hits(spark, sf))


@query("near_misses_parts")
def near_misses_parts(spark, sf):
    """With continuations of documents, which miss by their text or by their address."""
    return _near_misses(derived.document_parts(spark, sf))


@query("doc_veto_histogram", _DOC_DEDUP + """SELECT e.query_id, veto, count(*) AS n FROM e JOIN s5 ON s5.query_id = e.query_id AND s5.i = e.i
 LEFT JOIN own ON own.query_id = e.query_id AND own.j = e.j WHERE veto IS NOT NULL AND (owner IS NULL OR owner > e.i) GROUP BY ALL""")
def doc_veto_histogram(spark, sf):
    docs = cut_lineage(derived.document_hits(spark, sf))
    feats = cut_lineage(dedup.features(docs))
    return dedup.veto_histogram(docs, dedup.find_owners(docs, feats=feats), feats=feats)


@query("doc_pass_histogram", _DOC_DEDUP + """SELECT query_id, evidence, count(*) AS n FROM (SELECT query_id, unnest(string_split(reason, ',')) AS evidence FROM own)
 WHERE NOT starts_with(evidence, 'd1:') GROUP BY ALL""")
def doc_pass_histogram(spark, sf):
    return dedup.pass_histogram(dedup.find_owners(cut_lineage(derived.document_hits(spark, sf))))


# ---- reachability --------------------------------------------------------------------------
_REACH = f"kt AS (SELECT query_id, url, {o.TARGET} FROM kept)"


def _candidates(spark, sf):
    pool, r = _deduped(spark, sf)
    return pool, cut_lineage(r.hits), derived.host_verdict(spark, sf)


@query("reachable_hits", o.with_(o.SURVIVORS, o.VERDICT, _REACH) + "SELECT query_id, url FROM kt SEMI JOIN (SELECT * FROM v WHERE ok) g USING (host, port)")
def reachable_hits(spark, sf):
    _, deduped, verdict = _candidates(spark, sf)
    return reach.reachable(deduped, verdict).select("query_id", "url")


@query("unreachable_hits", o.with_(o.SURVIVORS, o.VERDICT, _REACH) + "SELECT query_id, url FROM kt ANTI JOIN (SELECT * FROM v WHERE ok) g USING (host, port)")
def unreachable_hits(spark, sf):
    _, deduped, verdict = _candidates(spark, sf)
    return reach.unreachable(deduped, verdict).select("query_id", "url")


@query("reach_stats", o.with_(o.SURVIVORS, o.VERDICT, _REACH) + """SELECT query_id, count(DISTINCT (host, port)) AS hosts_probed,
 count(DISTINCT (host, port)) FILTER (WHERE ok) AS hosts_ok, count(DISTINCT (host, port)) AS hosts_known, count(*) FILTER (WHERE NOT ok) AS dropped_items,
 count(*) FILTER (WHERE ok) AS kept FROM kt JOIN v USING (host, port) GROUP BY query_id""")
def reach_stats(spark, sf):
    _, deduped, verdict = _candidates(spark, sf)
    return reach.reach_stats(deduped, verdict)


@query("unreachable_hosts", o.with_(o.SURVIVORS, o.VERDICT, _REACH) + "SELECT DISTINCT query_id, host || ':' || port AS address FROM kt JOIN v USING (host, port) WHERE NOT ok")
def unreachable_hosts(spark, sf):
    _, deduped, verdict = _candidates(spark, sf)
    return reach.unreachable_hosts(deduped, verdict)


@query("funnel", o.with_(o.SURVIVORS, o.VERDICT, _REACH) + """SELECT query_id, (SELECT count(*) FROM pool WHERE pool.query_id = kt.query_id) AS raw,
 count(*) AS candidates, count(*) FILTER (WHERE ok) AS returned FROM kt JOIN v USING (host, port) GROUP BY query_id""")
def funnel(spark, sf):
    pool, deduped, verdict = _candidates(spark, sf)
    return reach.funnel(pool, deduped, reach.reachable(deduped, verdict))


# ---- engine status -------------------------------------------------------------------------
_ROUND_LOG = o.FETCH + """,
rl AS (SELECT (['en', 'fr', 'de', 'es'])[event_id % 4 + 1] AS query_id, engine,
 arg_max({'ok': ok, 'latency_ms': latency_ms, 'error': error, 'at': arrived_at}, event_id) AS r FROM fl GROUP BY ALL)"""


def _round_log(spark, sf):
    """The last answer of each engine in each of the four rounds."""
    log = derived.fetch_log(spark, sf)
    rounds_ = F.array(*[F.lit(q) for q in ("en", "fr", "de", "es")])
    return log.withColumn("query_id", F.get(rounds_, (c("event_id") % 4).cast("int"))).groupBy("query_id", "engine").agg(
        F.max_by(F.struct("ok", "latency_ms", "error", "arrived_at"), "event_id").alias("r")).select("query_id", "engine", "r.*")


@query("engine_status", o.with_(o.RAW, _SCORES, _ROUND_LOG, "n AS (SELECT query_id, engine, count(*) AS n FROM raw GROUP BY ALL)",
       """jd AS (SELECT *, coalesce(coherence < 0.3 AND max(coherence) OVER (PARTITION BY query_id) >= 0.5, false) AS decoy FROM sc)""") + """
SELECT rl.query_id, rl.engine, r.ok, CASE WHEN r.ok THEN least(coalesce(n, 0), 15) ELSE 0 END AS count, r.latency_ms, r.error,
 CASE WHEN r.ok THEN round(coherence, 6) END AS coherence, r.ok AND coalesce(decoy, false) AS decoy FROM rl LEFT JOIN n USING (query_id, engine) LEFT JOIN jd USING (query_id, engine)""")
def engine_status(spark, sf):
    raw = _raw(spark, sf)
    scores = coherence.judge_decoys(coherence.bucket_scores(raw, derived.queries(raw)))
    return status.engine_status(_round_log(spark, sf), raw, scores).withColumn("coherence", F.round("coherence", 6))


@query("failure_classes", o.with_(o.FETCH) + """SELECT engine, CASE WHEN ok THEN CASE WHEN latency_ms % 7 = 0 THEN 'empty' ELSE 'none' END ELSE
 (['missing_key', 'timeout', 'quota', 'http_status', 'throttled', 'short_page', 'bad_json', 'unknown_engine', 'timeout'])[event_id % 9 + 1] END AS class,
 count(*) AS n FROM fl GROUP BY ALL""")
def failure_classes(spark, sf):
    log = derived.fetch_log(spark, sf)
    return status.failure_counts(log.withColumn("count", F.when(c("ok") & (c("latency_ms") % 7 != 0), 5).otherwise(0)))


@query("latency_envelope", o.with_(o.FETCH) + """SELECT query_id, max(epoch_us(arrived_at) // 1000) - min(epoch_us(arrived_at) // 1000 - latency_ms) AS elapsed_ms,
 max(latency_ms) AS slowest_ms, arg_min(engine, (-latency_ms, engine)) AS slowest_engine,
 max(epoch_us(arrived_at) // 1000) - min(epoch_us(arrived_at) // 1000 - latency_ms) - max(latency_ms) AS tail_ms FROM fl GROUP BY query_id""")
def latency_envelope(spark, sf):
    return status.latency_envelope(derived.fetch_log(spark, sf))


@query("text_health", o.with_(o.RAW) + r"""SELECT engine, field, count(*) AS rows, round(avg(garbled::INT), 6) AS mojibake_rate,
 round(avg(regexp_matches(text, '!\[|\]\(')::INT), 6) AS markdown_rate, round(avg((n = 0)::INT), 6) AS empty_rate,
 median(n) AS median_chars, max(n) AS max_chars, sum(n) AS total_chars,
 count(*) FILTER (WHERE n = 400) AS exact_rows
 FROM (SELECT engine, 'title' AS field, title AS text, ord % 3 = 0 AS garbled,
  CASE WHEN ord % 3 = 0 THEN strlen('„' || title || '“') ELSE length(title) END AS n FROM raw
  UNION ALL SELECT engine, 'snippet', snippet, false, length(snippet) FROM raw) GROUP BY ALL""")
def text_health(spark, sf):
    """Every third title was decoded by the wrong character set."""
    h = status.text_health(derived.garbled_titles(_raw(spark, sf)))
    return h.withColumns({n: F.round(n, 6) for n in ("mojibake_rate", "markdown_rate", "empty_rate")})


@query("engine_overlap", o.with_(o.RAW, "u AS (SELECT DISTINCT query_id, url, engine FROM raw)", "s AS (SELECT query_id, engine, count(*) AS n FROM u GROUP BY ALL)",
       "b AS (SELECT x.query_id, x.engine AS a, y.engine AS b, count(*) AS shared FROM u x JOIN u y ON x.query_id = y.query_id AND x.url = y.url AND x.engine < y.engine GROUP BY ALL)") + """
SELECT b.query_id, b.a, b.b, shared, s1.n AS n_a, s2.n AS n_b, round(shared / (s1.n + s2.n - shared)::DOUBLE, 6) AS jaccard
 FROM b JOIN s s1 ON s1.query_id = b.query_id AND s1.engine = b.a JOIN s s2 ON s2.query_id = b.query_id AND s2.engine = b.b""")
def engine_overlap(spark, sf):
    return status.engine_overlap(_raw(spark, sf)).withColumn("jaccard", F.round("jaccard", 6))


@query("page_body_class", f"""SELECT CASE WHEN strlen(html) >= 4096 THEN 'ok' WHEN page_id % 2 = 0 THEN 'throttled' ELSE 'short' END AS class, count(*) AS n FROM
 (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN html || '{fv.PUNISH_MARKER}' ELSE html END AS html FROM pages) GROUP BY 1""")
def page_body_class(spark, sf):
    body = F.when(c("page_id") % 2 == 0, F.concat("html", F.lit(fv.PUNISH_MARKER))).otherwise(c("html"))
    return derived.table(spark, sf, "pages").groupBy(status.page_body_class(body).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("default_engines", o.with_(o.FETCH) + f"""SELECT engine, engine NOT IN {o._IN(fv.FREE_ENGINES)} AS paid FROM (SELECT unnest({o.ENGINES}) AS engine) e
 WHERE engine IN {o._IN(fv.FREE_ENGINES)} OR engine IN (SELECT engine FROM fl WHERE ok AND latency_ms > 2000)""")
def default_engines(spark, sf):
    keyed = derived.fetch_log(spark, sf).filter("ok and latency_ms > 2000")
    return status.default_engines(status.engines(spark), keyed).select("engine", "paid")


# ---- quality -------------------------------------------------------------------------------
def _caps(spark, sf):
    return derived.table(spark, sf, "documents").select(c("source").alias("engine")).distinct() \
        .withColumn("cap", F.when(F.length("engine") == 4, 10).otherwise(20))


def _rate_query(name, expression, column, fn, source=None):
    @query(name, o.with_(o.cell_ctes(), *(source or [])) + f"SELECT engine, label, round({expression}, 6) AS {column} FROM cells "
           + ("JOIN caps USING (engine) " if source else "") + "GROUP BY ALL")
    def run(spark, sf):
        return fn(spark, sf)


_CAPW = "((cap + 1) * bad - ranks) / (cap * (cap + 1) / 2.0)"
_rate_query("overall_rate", "avg(bad / n::DOUBLE)", "overall", lambda s, d: quality.overall_rate(derived.judged(s, d)))
_rate_query("topk_rate", "avg(top / least(n, 15)::DOUBLE)", "top15", lambda s, d: quality.topk_rate(derived.judged(s, d)))
_rate_query("rank_weighted_rate", f"avg({o.W})", "weighted", lambda s, d: quality.rank_weighted_rate(derived.judged(s, d)))
_rate_query("fixed_scale_rate", "avg((21 * bad - ranks) / 210.0)", "fixed", lambda s, d: quality.fixed_scale_rate(derived.judged(s, d)))
_rate_query("pooled_rate", "sum((n + 1) * bad - ranks) / sum(n * (n + 1) / 2.0)", "pooled", lambda s, d: quality.pooled_rate(derived.judged(s, d)))
_rate_query("cap_scale_rate", f"avg({_CAPW})", "capped", lambda s, d: quality.cap_scale_rate(derived.judged(s, d), _caps(s, d)), [o.CAPS])


@query("rate_variants", o.with_(o.cell_ctes(), o.CAPS) + f"""SELECT engine, label, round(avg(bad / n::DOUBLE), 6) AS overall,
 round(avg(top / least(n, 15)::DOUBLE), 6) AS top15, round(avg({o.W}), 6) AS weighted, round(avg((21 * bad - ranks) / 210.0), 6) AS fixed,
 round(avg({_CAPW}), 6) AS capped, round(sum((n + 1) * bad - ranks) / sum(n * (n + 1) / 2.0), 6) AS pooled FROM cells JOIN caps USING (engine) GROUP BY ALL""")
def rate_variants(spark, sf):
    return quality.metric_table(derived.judged(spark, sf), _caps(spark, sf))


@query("noise_floor", o.with_(o.cell_ctes(), o.NOISE_CTE) + "SELECT * FROM nf")
def noise_floor(spark, sf):
    return quality.noise_floor(derived.judged(spark, sf))


@query("flip_audit", o.with_(o.cell_ctes(), o.NOISE_CTE, o.MEANS) + """SELECT label, a.engine AS a, b.engine AS b, round(abs(a.x - b.x), 6) AS gap,
 round(abs(a.x - b.x), 6) > two_se AS significant FROM m a JOIN m b USING (label) JOIN nf USING (label)
 WHERE a.engine < b.engine AND sign(a.x - b.x) * sign(a.y - b.y) < 0""")
def flip_audit(spark, sf):
    return quality.flip_audit(derived.judged(spark, sf))


_AVG_RANK = lambda v: f"rank() OVER (PARTITION BY label ORDER BY {v}) + (count(*) OVER (PARTITION BY label, {v}) - 1) / 2.0"


@query("spearman", o.with_(o.cell_ctes(), o.MEANS, f"r AS (SELECT label, {_AVG_RANK('x')} AS rx, {_AVG_RANK('y')} AS ry, {_AVG_RANK('z')} AS rz FROM m)") + """
SELECT label, round(corr(rx, ry), 6) AS top15_rho, round(corr(rx, rz), 6) AS weighted_rho FROM r GROUP BY label""")
def spearman(spark, sf):
    return quality.spearman(derived.judged(spark, sf))


@query("variance_split", o.with_(o.cell_ctes(), """d AS (SELECT label, bad / n::DOUBLE AS v, avg(bad / n::DOUBLE) OVER (PARTITION BY label) AS m,
 avg(bad / n::DOUBLE) OVER (PARTITION BY label, keyword_id) AS mk, avg(bad / n::DOUBLE) OVER (PARTITION BY label, engine) AS me FROM cells),
s AS (SELECT label, sum((v - m) ** 2) AS t, sum((mk - m) ** 2) AS k, sum((me - m) ** 2) AS e FROM d GROUP BY label)""") + """
SELECT label, round(CASE WHEN t > 0 THEN k / t END, 6) AS keyword_share, round(CASE WHEN t > 0 THEN e / t END, 6) AS engine_share,
 round(CASE WHEN t > 0 THEN (t - k - e) / t END, 6) AS residual_share FROM s""")
def variance_split(spark, sf):
    return quality.variance_split(derived.judged(spark, sf))


@query("variance_split_gaps", "WITH RECURSIVE " + o.with_(o.cell_ctes(), """c AS (SELECT label, engine, keyword_id, bad / n::DOUBLE AS v FROM cells
 WHERE (ascii(right(engine, 1)) + ascii(right(keyword_id, 1))) % 4 <> 0),
d AS (SELECT label, v, avg(v) OVER (PARTITION BY label) AS m, avg(v) OVER (PARTITION BY label, keyword_id) AS mk, avg(v) OVER (PARTITION BY label, engine) AS me FROM c),
s AS (SELECT label, sum((v - m) ** 2) AS t, sum((v - mk) ** 2) AS rk, sum((v - me) ** 2) AS re FROM d GROUP BY label),
f AS (SELECT 0 AS step, label, engine, keyword_id, v AS r FROM c UNION ALL
 SELECT step + 1, label, engine, keyword_id, r - avg(r) OVER (PARTITION BY label, engine) FROM (
  SELECT step, label, engine, keyword_id, r - avg(r) OVER (PARTITION BY label, keyword_id) AS r FROM f) WHERE step < 200),
b AS (SELECT label, sum(r ** 2) AS rb FROM f WHERE step = 200 GROUP BY label)""").removeprefix("WITH ") + """
SELECT label, round(CASE WHEN t > 0 THEN (t - rk + re - rb) / 2 / t END, 6) AS keyword_share,
 round(CASE WHEN t > 0 THEN (t - re + rk - rb) / 2 / t END, 6) AS engine_share, round(CASE WHEN t > 0 THEN rb / t END, 6) AS residual_share
 FROM s JOIN b USING (label)""")
def variance_split_gaps(spark, sf):
    """Some engines gave no answer to some keywords; the SQL takes means out in turn until nothing changes."""
    return quality.fitted_variance_split(derived.judged_with_gaps(spark, sf))


@query("range_ratio", o.with_(o.cell_ctes(), """k AS (SELECT label, max(v) - min(v) AS k FROM (SELECT label, keyword_id, avg(bad / n::DOUBLE) AS v FROM cells GROUP BY ALL) GROUP BY label),
e AS (SELECT label, max(v) - min(v) AS e FROM (SELECT label, engine, avg(bad / n::DOUBLE) AS v FROM cells GROUP BY ALL) GROUP BY label)""") + """
SELECT label, round(k, 6) AS keyword_range, round(e, 6) AS engine_range, round(CASE WHEN e > 0 THEN k / e END, 6) AS ratio FROM k JOIN e USING (label)""")
def range_ratio(spark, sf):
    return quality.range_ratio(derived.judged(spark, sf))


@query("keyword_means", o.with_(o.cell_ctes()) + "SELECT keyword_id, label, round(avg(bad / n::DOUBLE), 6) AS mean_rate FROM cells GROUP BY ALL")
def keyword_means(spark, sf):
    return quality.keyword_means(derived.judged(spark, sf))


@query("cell_collapse", o.with_(o.cell_ctes()) + "SELECT engine, keyword_id, label, n, round(bad / n::DOUBLE, 6) AS rate, bad = n AS collapsed FROM cells")
def cell_collapse(spark, sf):
    return quality.cell_table(derived.judged(spark, sf))


@query("label_precedence", o.with_(o.JUDGED) + """SELECT engine, keyword_id, count(*) AS n, count(*) FILTER (WHERE ad) AS ad, count(*) FILTER (WHERE off) AS off,
 count(*) FILTER (WHERE bad) AS bad FROM j GROUP BY ALL""")
def label_precedence(spark, sf):
    j = quality.with_precedence(derived.judged(spark, sf))
    return j.groupBy("engine", "keyword_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(x).alias(x) for x in quality.LABELS])


@query("invalid_flags", r"""WITH d AS (SELECT doc_id, text, regexp_extract(text, '^([^\n.]*)', 1) AS title FROM documents),
s AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '[\n。！？.!?]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 20) AS seg FROM d)
SELECT doc_id, trim(text, ' ') = '' AS empty_snippet, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') = regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g') AS title_only,
 len(seg) > len(list_distinct(seg)) AS repeated_segment FROM s""")
def invalid_flags(spark, sf):
    d = derived.table(spark, sf, "documents").select("doc_id", c("text").alias("snippet"),
                                                     F.regexp_extract("text", "^([^\n.]*)", 1).alias("title"))
    return quality.invalid_flags(d).drop("snippet", "title")


# ---- sources, sinks, streams ---------------------------------------------------------------
def _responses(raw, engine):
    """Result lists of one engine written as that engine's JSON responses, one per query."""
    r = raw.filter(c("engine") == engine)
    item = {
        "tavily": F.struct(c("ord"), c("title"), c("url"), c("snippet").alias("content"), F.lit("").alias("snippet"), c("signals.score").alias("score")),
        "serpapi": F.struct(c("ord"), c("title"), c("url").alias("link"), c("snippet"), c("date"), c("signals.source").alias("source")),
        "tinyfish": F.struct(c("ord"), (c("rank") % 4).alias("position"), c("title"), c("url"), c("snippet"), c("date"), F.lit("").alias("site_name")),
        "metaso": F.struct(c("ord"), c("title"), c("url").alias("link"), c("signals.score_level").alias("score"), c("snippet"), c("date")),
        "exa": F.struct(c("ord"), c("title"), c("url"), c("snippet").alias("text"), c("date").alias("publishedDate")),
        "qianfan": F.struct(c("ord"), c("title"), c("url"), F.lit(" ").alias("snippet"), c("snippet").alias("content"), c("date"),
                            c("signals.score").alias("rerank_score"), F.lit("").alias("website")),
        "anysearch": F.struct(c("ord"), F.lit("").alias("title"), c("title").alias("name"), c("url").alias("link"), c("snippet")),
    }[engine]
    # Pages of 50 results keep a response bounded; its number is part of the query id.
    paged = r.withColumn("query_id", F.concat_ws("/", "query_id", F.floor(c("ord") / 50).cast("string")))
    lists = paged.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = {"serpapi": F.struct(c("items").alias("organic_results")), "metaso": F.struct(c("items").alias("webpages")),
            "qianfan": F.struct(c("items").alias("references")),
            "anysearch": F.struct(F.lit(0).alias("code"), F.struct(c("items").alias("results")).alias("data")),
            }.get(engine, F.struct(c("items").alias("results")))
    return lists.select("query_id", "query", body.alias("body"))


@query("landed_json", o.with_(o.RAW) + f"""SELECT query_id || '/' || (ord // 50) AS query_id, engine,
 CASE WHEN engine = 'tinyfish' AND rank % 4 > 0 THEN rank % 4 ELSE ord % 50 + 1 END AS rank, {o.trim('title')} AS title, url,
 md5({o.squeeze('snippet')}) AS snippet_md5,
 CASE WHEN engine IN ('tavily', 'anysearch') THEN '' ELSE date END AS date, CASE WHEN engine = 'tavily' AND score > 0 THEN score END AS score,
 CASE WHEN engine = 'metaso' AND score_level <> '' THEN score_level END AS score_level,
 CASE WHEN engine = 'serpapi' AND source <> '' THEN source END AS source,
 CASE WHEN engine = 'qianfan' AND score > 0 THEN score END AS rerank_score
 FROM raw WHERE engine NOT IN ('bing', 'quark')""")
def landed_json(spark, sf):
    parts, raw = [], cut_lineage(_raw(spark, sf))
    for engine in landed.ENGINES:
        path = _stage(spark)
        _responses(raw, engine).write.json(path)
        parts.append(landed.read_landed(spark, path, engine))
    return hits.union_engines(*parts).select(
        "query_id", "engine", "rank", "title", "url", F.md5("snippet").alias("snippet_md5"), "date",
        "signals.score", "signals.score_level", "signals.source", "signals.rerank_score")


@query("item_log", o.with_(o.RAW) + """SELECT engine, query, rank, title, url, md5(snippet) AS snippet_md5, date, score, source FROM
 (SELECT * REPLACE (CASE WHEN source = '' THEN NULL ELSE source END AS source) FROM raw)""")
def item_log(spark, sf):
    path = _stage(spark)
    logs.write_item_log(_raw(spark, sf), path)
    return logs.read_item_log(spark, path).select(
        "engine", "query", "rank", "title", "url", F.md5("snippet").alias("snippet_md5"), "date", "signals.score", "signals.source")


_MARKUP = {
    "bing": "<ol><li class=\"b_algo\"><h2><a href=\"{url}\">{title}</a></h2><div class=\"b_caption\"><p>{snippet}</p></div></li>"
            "<li class=\"b_algo\"><h2><a href=\"javascript:;\">skip</a></h2></li></ol>",
    "quark": "<div class=\"sc\" data-sc='{{\"sc\":\"ss_text\"}}'><a class=\"qk-link-wrapper\" data-openpageurl=\"{url}\"><span class=\"qk-title-text\">{title}</span>"
             "<div class=\"qk-paragraph-text\">x</div></a><a class=\"qk-link-wrapper\"><div class=\"qk-paragraph-text\">{snippet}</div></a></div>",
}
_PLAIN = lambda x: "replace(replace(replace(replace(replace(" + x + ", '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"


@query("html_hits", o.with_(o.PAGES) + "SELECT page_id AS page, engine, url, " + o.squeeze(_PLAIN("title")) + " AS title, "
       + f"CASE WHEN snippet = '' AND engine = 'quark' THEN 'x' ELSE {o.squeeze(_PLAIN('snippet'))} END AS snippet, "
       + "CASE engine WHEN 'quark' THEN 'ss_text' END AS card_type FROM p, (SELECT unnest(['bing', 'quark']) AS engine) e")
def html_hits(spark, sf):
    p = derived.page_fields(derived.table(spark, sf, "pages"))
    parts = []
    for engine, markup in _MARKUP.items():
        html = F.lit(markup.replace("{{", "{").replace("}}", "}"))
        for name in ("url", "title", "snippet"):
            html = F.replace(html, F.lit("{" + name + "}"), c(name))
        rows = page_source.html_rows(p.select("query_id", c("page_id").alias("page"), html.alias("html")), engine)
        parts.append(rows.select("page", F.lit(engine).alias("engine"), "url", text.squeeze_white(c("title")).alias("title"),
                                 "snippet", "signals.card_type"))
    return hits.union_engines(*parts)


@query("page_articles", o.with_(o.PAGES) + "SELECT page_id AS page, md5(" + o.squeeze(_PLAIN("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")) + ") AS title_md5, md5("
       + o.squeeze(_PLAIN("snippet")) + ") AS snippet_md5 FROM p")
def page_articles(spark, sf):
    """The extractor over the landed pages themselves: one container, its title and all of its paragraphs."""
    p = derived.table(spark, sf, "pages").select(F.lit("q").alias("query_id"), c("page_id").alias("page"), "html")
    rows = page_source.html_rows(p, "page")
    return rows.select("page", F.md5(text.squeeze_white(c("title"))).alias("title_md5"), F.md5(text.squeeze_white(c("snippet"))).alias("snippet_md5"))


def _staged_stream(spark, sf):
    """The lists as landed rows: each engine answers a few seconds after its round started, one
    engine after the deadline."""
    r = _raw(spark, sf)
    n = F.array_position(F.array(*[F.lit(e) for e in fv.ALL_ENGINES]), c("engine"))
    start = F.timestamp_seconds(1_700_000_000 + F.ascii("query_id") * 600)
    path = _stage(spark)
    r.withColumn("round_start", start).withColumn("arrived_at", F.timestamp_seconds(
        F.unix_timestamp("round_start") + F.when(c("engine") == "serpapi", 75).otherwise(n * 4))) \
        .select(*rounds.RAW_COLUMNS, "round_start", "arrived_at").write.json(path)
    return path


@query("stream_merge", o.with_(o.POOL.replace("raw AS (", "raw0 AS (", 1) .replace("ranks AS (", "raw AS (SELECT * FROM raw0 WHERE engine <> 'serpapi'),\nranks AS (", 1))
       + "SELECT query_id, hit_ord, url, '(' || positions || ')' AS positions FROM pool")
def stream_merge(spark, sf):
    """Rows within the deadline, merged batch by batch; the pool equals the batch result."""
    table, marks = _stage(spark), _stage(spark)
    rows = rounds.within_deadline(rounds.read_rows(spark, _staged_stream(spark, sf), files_per_batch=2))
    rounds.merge_stream(rows, table, marks).awaitTermination()
    return rounds.current_pool(spark, table).select("query_id", "hit_ord", "url", text.positions_text(c("positions")).alias("positions"))


def _append(spark, df, schema):
    out, marks = _stage(spark), _stage(spark)
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append") \
        .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("stream_new_hosts", o.with_(o.RAW) + f"SELECT DISTINCT {o.TARGET} FROM raw WHERE engine <> 'serpapi'")
def stream_new_hosts(spark, sf):
    rows = rounds.within_deadline(rounds.read_rows(spark, _staged_stream(spark, sf)))
    return _append(spark, rounds.new_hosts(rows, "2 days").select("host", "port"), "host string, port string")


@query("stream_reach", o.with_(o.RAW, o.VERDICT, f"rt AS (SELECT *, {o.TARGET} FROM raw)", "last AS (SELECT max(ascii(query_id)) AS a FROM raw)") + """
SELECT query_id, engine, url, coalesce(g.ok, false) AS reachable FROM rt CROSS JOIN last LEFT JOIN (SELECT * FROM v WHERE ok) g USING (host, port)
 WHERE g.ok OR ascii(query_id) < a""")
def stream_reach(spark, sf):
    """Rows of all rounds with the verdicts that come in while their round runs; rows of the last round still wait for theirs."""
    tested, path = _stage(spark), _staged_stream(spark, sf)
    starts = spark.read.schema(rounds.STREAM_ROW).json(path).select("round_start").distinct()
    derived.host_verdict(spark, sf).select("host", "port", "ok").crossJoin(F.broadcast(starts)).select(
        "host", "port", "ok", (c("round_start") + F.expr("INTERVAL 30 SECONDS")).alias("tested_at")).write.json(tested)
    verdicts = spark.readStream.schema("host string, port string, ok boolean, tested_at timestamp").json(tested)
    out = rounds.with_verdicts(rounds.read_rows(spark, path), verdicts, delay="1 minute")
    return _append(spark, out.select("query_id", "engine", "url", "reachable"), "query_id string, engine string, url string, reachable boolean")


def _asked_and_rows(spark, sf):
    """Streams of the requests (every engine of every round) and of the landed rows."""
    asked, path = _stage(spark), _staged_stream(spark, sf)
    engines = F.explode(F.array(*[F.lit(e) for e in fv.ALL_ENGINES])).alias("engine")
    spark.read.schema(rounds.STREAM_ROW).json(path).select("query_id", "round_start").distinct() \
        .select("query_id", engines, "round_start").write.json(asked)
    return spark.readStream.schema("query_id string, engine string, round_start timestamp").json(asked), rounds.read_rows(spark, path)


def _ledger(spark, sf):
    table, marks = _stage(spark), _stage(spark)
    asked, rows = _asked_and_rows(spark, sf)
    rounds.ledger_stream(rounds.ledger(rows, asked, delay="10 seconds"), table, marks).awaitTermination()
    return table


@query("stream_deadline", o.with_(o.RAW) + "SELECT query_id, engine, url FROM raw WHERE engine = 'serpapi'")
def stream_deadline(spark, sf):
    """Rows that came after the deadline of their round, kept apart by the job that also writes the status."""
    return rounds.late_rows(spark, _ledger(spark, sf)).select("query_id", "engine", "url")


@query("stream_round", o.with_(o.RAW, "c AS (SELECT query_id, engine, count(*) AS n FROM raw GROUP BY ALL)",
       f"eng AS (SELECT unnest({o.ENGINES}) AS engine, unnest(range(1, 10)) AS i)",
       "q AS (SELECT DISTINCT query_id, 600 * ascii(query_id) AS start FROM raw)",
       "seen AS (SELECT max(start + CASE engine WHEN 'serpapi' THEN 75 ELSE i * 4 END) AS last FROM c JOIN q USING (query_id) JOIN eng USING (engine))") + f"""
SELECT query_id, engine, CASE WHEN n IS NULL THEN 'silent' WHEN engine = 'serpapi' THEN 'late' ELSE 'ok' END AS outcome,
 CASE WHEN engine = 'serpapi' THEN 0 ELSE least(coalesce(n, 0), 15) END AS count, CASE WHEN engine = 'serpapi' THEN coalesce(n, 0) ELSE 0 END AS too_late,
 CASE WHEN n > 0 AND engine <> 'serpapi' THEN i * 4000 END AS latency_ms,
 CASE WHEN n > 0 AND engine <> 'serpapi' THEN '' ELSE '{fv.ABANDONED}' END AS error
 FROM q CROSS JOIN eng CROSS JOIN seen LEFT JOIN c USING (query_id, engine) WHERE start + 60 <= last - 10""")
def stream_round(spark, sf):
    """Status of every asked engine by a timer at the deadline of its round: in time, late or silent."""
    return rounds.round_status(spark, _ledger(spark, sf)).select("query_id", "engine", "outcome", "count", "too_late", "latency_ms", "error")


@query("stream_status", o.with_(o.RAW, "c AS (SELECT query_id, engine, count(*) AS n FROM raw GROUP BY ALL)",
       f"eng AS (SELECT unnest({o.ENGINES}) AS engine, unnest(range(1, 10)) AS i)", "q AS (SELECT DISTINCT query_id FROM raw)") + f"""
SELECT query_id, engine, coalesce(n, 0) > 0 AND engine <> 'serpapi' AS ok, CASE WHEN engine = 'serpapi' THEN 0 ELSE least(coalesce(n, 0), 15) END AS count,
 CASE WHEN engine = 'serpapi' THEN coalesce(n, 0) ELSE 0 END AS too_late, CASE WHEN n > 0 AND engine <> 'serpapi' THEN i * 4000 END AS latency_ms,
 CASE WHEN coalesce(n, 0) > 0 AND engine <> 'serpapi' THEN '' ELSE '{fv.ABANDONED}' END AS error
 FROM q CROSS JOIN eng LEFT JOIN c USING (query_id, engine) WHERE ascii(query_id) < (SELECT max(ascii(query_id)) FROM q)""")
def stream_status(spark, sf):
    """Status of the rounds the watermark has closed, silent engines included."""
    asked, rows = _asked_and_rows(spark, sf)
    st = rounds.closed_status(rows, asked)
    out = _append(spark, st, "query_id string, engine string, ok boolean, count bigint, too_late bigint, latency_ms bigint, error string")
    return out


# ---- whole jobs ----------------------------------------------------------------------------
_ROUND_RAW = o.RAW.replace("\nraw AS (", "\nraw0 AS (") + ",\n" + _ROUND_LOG + """,
raw AS (SELECT raw0.* FROM raw0 JOIN rl USING (query_id, engine) WHERE r.ok AND raw0.rank <= 15)"""


@query("search_round", o.with_(o.SURVIVORS.replace(o.RAW, _ROUND_RAW), o.VERDICT, f"kt AS (SELECT *, {o.TARGET} FROM kept)") + """
SELECT kt.query_id, kt.hit_ord, kt.url, kt.title, '(' || kpos.positions || ')' AS positions FROM kt
 JOIN kpos ON kpos.query_id = kt.query_id AND kpos.hit_ord = kt.hit_ord JOIN v ON v.host = kt.host AND v.port = kt.port AND v.ok""")
def search_round(spark, sf):
    r = _round(spark, sf)
    return r.hits.select("query_id", "hit_ord", "url", "title", text.positions_text(c("positions")).alias("positions"))


# ---- whole reports -------------------------------------------------------------------------
_EL = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n - 1}), ' ') || '…' END"
_REPORT = o.with_(
    o.SURVIVORS.replace(o.RAW, _ROUND_RAW), o.VERDICT, f"kt AS (SELECT *, {o.TARGET} FROM kept)",
    """fin AS (SELECT kt.*, kpos.positions, row_number() OVER (PARTITION BY kt.query_id ORDER BY kt.hit_ord) - 1 AS n FROM kt
 JOIN kpos ON kpos.query_id = kt.query_id AND kpos.hit_ord = kt.hit_ord JOIN v ON v.host = kt.host AND v.port = kt.port AND v.ok)""",
    """alt AS (SELECT fin.query_id, fin.hit_ord, fin.n, f.url, f.title, f.engines, own.reason FROM own JOIN fin ON fin.query_id = own.query_id
 AND fin.hit_ord = own.owner JOIN f ON f.query_id = own.query_id AND f.hit_ord = own.j)""",
    "served AS (SELECT raw0.* FROM raw0 JOIN rl USING (query_id, engine) WHERE r.ok)", _SCORES.replace("FROM raw GROUP", "FROM served GROUP"),
    "jd AS (SELECT *, coalesce(coherence < 0.3 AND max(coherence) OVER (PARTITION BY query_id) >= 0.5, false) AS decoy FROM sc)",
    "cnt AS (SELECT query_id, engine, count(*) AS n FROM served GROUP BY ALL)",
    """st AS (SELECT rl.query_id, rl.engine, r.ok AS ok, CASE WHEN r.ok THEN least(coalesce(n, 0), 15) ELSE 0 END AS count, r.latency_ms AS latency_ms,
 r.error AS error, CASE WHEN r.ok THEN coherence END AS coherence, r.ok AND coalesce(decoy, false) AS decoy
 FROM rl LEFT JOIN cnt USING (query_id, engine) LEFT JOIN jd USING (query_id, engine))""",
    """ds AS (SELECT f.query_id, count(*) AS raw, count(*) - count(own.j) AS final, count(own.j) AS merged,
 count(*) FILTER (WHERE reason LIKE 'd1:url%') AS um FROM f LEFT JOIN own ON own.query_id = f.query_id AND own.j = f.hit_ord GROUP BY f.query_id)""",
    """ve AS (SELECT query_id, string_agg(veto || '=' || n, ',' ORDER BY veto) AS veto FROM (SELECT e.query_id, veto, count(*) AS n FROM e
 JOIN s5 ON s5.query_id = e.query_id AND s5.i = e.i LEFT JOIN own ON own.query_id = e.query_id AND own.j = e.j
 WHERE veto IS NOT NULL AND (owner IS NULL OR owner > e.i) GROUP BY ALL) GROUP BY query_id)""",
    """pa AS (SELECT query_id, string_agg(ev || '=' || n, ',' ORDER BY ev) AS pass FROM (SELECT query_id, ev, count(*) AS n FROM
 (SELECT query_id, unnest(string_split(reason, ',')) AS ev FROM own) WHERE NOT starts_with(ev, 'd1:') GROUP BY ALL) GROUP BY query_id)""",
    """rs AS (SELECT query_id, count(DISTINCT (host, port)) AS probed, count(DISTINCT (host, port)) FILTER (WHERE ok) AS good,
 count(*) FILTER (WHERE NOT ok) AS dropped, count(*) FILTER (WHERE ok) AS kept,
 string_agg(DISTINCT CASE WHEN NOT ok THEN host || ':' || port END, ',' ORDER BY CASE WHEN NOT ok THEN host || ':' || port END) AS dead
 FROM kt JOIN v USING (host, port) GROUP BY query_id)""",
    """rd AS (SELECT query_id, string_agg(engine, ', ' ORDER BY engine) AS engines, max(r.at) AS generated_at,
 max(epoch_us(r.at) // 1000) - min(epoch_us(r.at) // 1000 - r.latency_ms) AS elapsed_ms FROM rl GROUP BY query_id)""",
    "qs AS (SELECT DISTINCT query_id, query FROM raw0)",
    """rep AS (SELECT qs.query_id, qs.query, engines, generated_at, elapsed_ms, coalesce(raw, 0) AS raw, coalesce(final, 0) AS final, coalesce(merged, 0) AS merged,
 coalesce(um, 0) AS um, veto, pass, coalesce(probed, 0) AS probed, coalesce(good, 0) AS good, coalesce(dropped, 0) AS dropped, coalesce(kept, 0) AS kept, dead
 FROM qs LEFT JOIN rd USING (query_id) LEFT JOIN ds USING (query_id) LEFT JOIN ve USING (query_id) LEFT JOIN pa USING (query_id) LEFT JOIN rs USING (query_id))""")
_STAGES = lambda sep: ("CASE WHEN raw > 1 THEN '" + sep + "d1_url_exact ' || raw || '→' || (raw - um) || '(合并' || um || ')' || '" + sep
                       + "d2_judged ' || (raw - um) || '→' || final || '(合并' || (merged - um) || ')' ELSE '' END")


def _round(spark, sf):
    raw = _raw(spark, sf)
    return jobs.search_round(raw, derived.queries(raw), _round_log(spark, sf), derived.host_verdict(spark, sf))


def _nested(spark, sf):
    r = _round(spark, sf)
    return sinks.report_json(r.report, r.hits, r.absorbed)


@query("stored_report", _REPORT + "SELECT query AS query_id, n AS hit_ord, url, title FROM fin JOIN qs USING (query_id)")
def stored_report(spark, sf):
    """Reports written and read back as a pool: the traces of the earlier run are gone."""
    path = _stage(spark)
    _nested(spark, sf).select(c("json").alias("value")).write.text(path)
    return logs.read_stored_reports(spark, path).filter("merged_from is null").select("query_id", "hit_ord", "url", "title")


@query("report_json", _REPORT + f"""SELECT rep.query_id, query, engines, epoch_us(generated_at) // 1000 AS generated_ms, elapsed_ms,
 (SELECT string_agg(concat_ws(':', engine, ok, count, latency_ms, error, round(coherence, 6)::DOUBLE, CASE WHEN decoy THEN 'decoy' END), '|' ORDER BY engine) FROM st
  WHERE st.query_id = rep.query_id) AS status, 'conservative' AS mode, 0.9 AS threshold, raw, final, merged AS total_merged, {_STAGES('')} AS stages,
 coalesce(veto, '') AS veto, coalesce(pass, '') AS pass, true AS enabled, probed AS hosts_probed, good AS hosts_ok, dropped AS dropped_items, kept, probed AS prefetched,
 coalesce(dead, '') AS unreachable, final AS candidates, kept AS returned, coalesce((SELECT string_agg(concat_ws('~', url, title, md5(snippet), '(' || positions || ')', coalesce(date, ''),
  CASE WHEN score > 0 THEN score::DOUBLE END, source, (SELECT string_agg(alt.url || '<' || alt.title || '<' || alt.engines || '<' || alt.reason, '<' ORDER BY alt.url) FROM alt
   WHERE alt.query_id = fin.query_id AND alt.hit_ord = fin.hit_ord)), chr(10) ORDER BY n) FROM fin WHERE fin.query_id = rep.query_id), '') AS results FROM rep""")
def report_json(spark, sf):
    """The nested reports, parsed back and written out flat."""
    status_ = "array<struct<engine:string,ok:boolean,count:bigint,latency_ms:bigint,error:string,coherence:double,decoy:boolean>>"
    dedup_ = ("struct<mode:string,threshold:double,raw:bigint,final:bigint,total_merged:bigint,stages:array<struct<stage:string,before:bigint,after:bigint,"
              "merged:bigint>>,veto:map<string,bigint>,pass:map<string,bigint>>")
    reach_ = ("struct<enabled:boolean,hosts_probed:bigint,hosts_ok:bigint,dropped_items:bigint,kept:bigint,prefetched:bigint,unreachable:array<string>>")
    schema = (f"query string, engines array<string>, generated_at timestamp, elapsed_ms bigint, engine_status {status_}, dedup {dedup_}, "
              f"reachability {reach_}, stats struct<candidates:bigint,returned:bigint>, results array<{schemas.HIT}>")
    r = _nested(spark, sf).select("query_id", F.from_json("json", schema).alias("r")).select("query_id", "r.*")
    pairs = lambda m: F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ","), F.lit(""))
    state = lambda x: F.concat_ws(":", x["engine"], x["ok"].cast("string"), x["count"].cast("string"), x["latency_ms"].cast("string"),
                                  F.coalesce(x["error"], F.lit("")), F.round(x["coherence"], 6).cast("string"), F.when(x["decoy"], "decoy"))
    stage = lambda x: F.concat(x["stage"], F.lit(" "), x["before"], F.lit("→"), x["after"], F.lit("(合并"), x["merged"], F.lit(")"))
    alt = lambda e: F.concat_ws("<", e["key"], F.coalesce(e["value"]["title"], F.lit("")), F.array_join(e["value"]["engine"], "/"), e["value"]["reason"])
    hit = lambda h: F.concat_ws("~", h["url"], h["title"], F.md5(h["snippet"]), text.positions_text(h["positions"]), F.coalesce(h["date"], F.lit("")),
                                h["signals"]["score"].cast("string"), h["signals"]["source"],
                                F.array_join(F.transform(F.array_sort(F.map_entries(h["merged_from"])), alt), "<"))
    return r.select(
        "query_id", "query", F.array_join("engines", ", ").alias("engines"), F.unix_millis("generated_at").alias("generated_ms"), "elapsed_ms",
        F.array_join(F.transform("engine_status", state), "|").alias("status"), "dedup.mode", "dedup.threshold", "dedup.raw", "dedup.final",
        "dedup.total_merged", F.array_join(F.transform("dedup.stages", stage), "").alias("stages"), pairs(c("dedup.veto")).alias("veto"),
        pairs(c("dedup.pass")).alias("pass"), *[f"reachability.{x}" for x in ("enabled", "hosts_probed", "hosts_ok", "dropped_items", "kept", "prefetched")],
        F.coalesce(F.array_join("reachability.unreachable", ","), F.lit("")).alias("unreachable"), "stats.candidates", "stats.returned",
        F.array_join(F.transform("results", hit), "\n").alias("results"))


@query("report_jsonl", _REPORT + """SELECT query_id, -1 AS line, '' AS sub, query AS url, raw || '/' || final || '/' || kept AS title, '' AS extra FROM rep
 UNION ALL SELECT query_id, hit_ord, '', url, title, md5(snippet) FROM fin
 UNION ALL SELECT query_id, hit_ord, url, url, title, engines || ' ' || reason FROM alt""")
def report_jsonl(spark, sf):
    r = _round(spark, sf)
    lines = sinks.report_lines(r.report, r.hits, r.absorbed)
    j = lambda path: F.get_json_object("json", path)
    alt = F.from_json(j("$.merged_from"), f"map<string,{schemas.ALT_REF}>")
    one = F.map_entries(alt)[0]
    meta, hit = c("line") < 0, c("sub") == ""
    return lines.select(
        "query_id", "line", "sub", F.when(meta, j("$.query")).when(hit, j("$.url")).otherwise(one["key"]).alias("url"),
        F.when(meta, F.concat_ws("/", j("$.dedup.raw"), j("$.dedup.final"), j("$.stats.returned"))).when(hit, j("$.title"))
        .otherwise(F.coalesce(one["value"]["title"], F.lit(""))).alias("title"),
        F.when(meta, "").when(hit, F.md5(j("$.snippet"))).otherwise(F.concat_ws(" ", F.array_join(one["value"]["engine"], "/"), one["value"]["reason"])).alias("extra"))


@query("report_text", _REPORT + f"""SELECT query_id, n AS line, '' AS sub, CASE WHEN n > 0 THEN chr(10) ELSE '' END || '[' || (n + 1) || '] ' || url ||
 chr(10) || '    标题: ' || {_EL('title', 90)} || chr(10) || '    命中: ' || regexp_replace(replace(positions, ', ', ' / '), '#[0-9]+', '', 'g') || '  (' || positions || ')' ||
 CASE WHEN snippet <> '' THEN chr(10) || '    摘要: ' || {_EL('snippet', 120)} ELSE '' END AS text FROM fin
 UNION ALL SELECT query_id, n, url, '    备用: ' || {_EL('url', 70)} || CASE WHEN title <> '' THEN '  《' || {_EL('title', 40)} || '》' ELSE '' END || '  [' || engines || '] ' || reason FROM alt""")
def report_text(spark, sf):
    r = _round(spark, sf)
    return sinks.report_text(r.report, r.hits, r.absorbed).filter("section = 1").select("query_id", "line", "sub", "text")


@query("report_header", _REPORT + f"""SELECT query_id, 0 AS section, concat_ws(chr(10), '查询: ' || query, '引擎: ' || engines, '耗时: ' || elapsed_ms || ' ms',
 '候选 ' || raw || ' → 去重后 ' || final || ' → 可达 ' || kept, '去重: conservative 档（恒开，标题阈值 0.90）' || {_STAGES(' | ')},
 '可达性预检: 探测 ' || probed || ' 个域名，可达 ' || good || '，剔除 ' || dropped || ' 条', repeat('=', 78), CASE WHEN kept = 0 THEN '没有结果。' END) AS text FROM rep
 UNION ALL SELECT rep.query_id, 2, CASE WHEN kept > 0 THEN chr(10) ELSE '' END || repeat('-', 78) || chr(10) || '引擎状态:' || chr(10) ||
  (SELECT string_agg('  ' || rpad(engine, 10, ' ') || ' ' || CASE WHEN ok THEN 'OK  ' ELSE 'FAIL' END || ' ' || lpad(count::VARCHAR, 3, ' ') || ' 条  ' ||
   lpad(latency_ms::VARCHAR, greatest(5, length(latency_ms::VARCHAR))::INT, ' ') || ' ms' || CASE WHEN error <> '' THEN '  ' || {_EL('error', 90)} ELSE '' END, chr(10) ORDER BY engine)
   FROM st WHERE st.query_id = rep.query_id) FROM rep""")
def report_header(spark, sf):
    r = _round(spark, sf)
    return sinks.report_text(r.report, r.hits, r.absorbed).filter("section <> 1").select("query_id", "section", "text")
