"""DuckDB SQL with the same results as the registered queries, written independently of them."""

from __future__ import annotations

from hitmerge import fixed_values as fv
from hitmerge.plans.derived import ERROR_TEXTS, QUERY_TEXTS

_L = lambda xs: "[" + ",".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"
_IN = lambda xs: "(" + ",".join("'" + x + "'" for x in xs) + ")"
ENGINES = _L(fv.ALL_ENGINES)
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NOISE = "[" + WS + r"\x1C-\x1F\-_|—–·,，。！!？?：:；;（）()\[\]【】\"''`]"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def norm_text(x: str) -> str:
    return f"regexp_replace(lower({x}), '{NOISE}', '', 'g')"


def strip_once(x: str) -> str:
    sep = r"|｜—–·_\-"
    head = f"regexp_replace(regexp_extract({x}, '(?s)^(.+)[{sep}]([^{sep}]*)$', 1), '[ \\t]+$', '')"
    tail = f"regexp_replace(regexp_extract({x}, '(?s)^(.+)[{sep}]([^{sep}]*)$', 2), '^[{WS}]+|[{WS}]+$', '', 'g')"
    return (f"CASE WHEN {head} <> '' AND {tail} <> '' AND length({tail}) <= 12 AND NOT "
            f"regexp_matches({tail}, '[，。！？；：、,.;!?:\\t\\n]') THEN {head} ELSE {x} END")


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({trim(x)}, '[{WS}]+', ' ', 'g')"


def ngrams(x: str, n: int) -> str:
    return (f"CASE WHEN {x} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({x}) - {n - 1}, 1)"
            f" + 1), lambda i: substr({x}, i, {n}))) END")


def jaccard(a: str, b: str) -> str:
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / "
            f"(len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END")


_BODY = squeeze("regexp_replace(regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')")
PAGES = f"""p AS (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) AS query_id,
 regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {_BODY} AS snippet, html FROM pages)"""

_QTEXT = "CASE query_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in QUERY_TEXTS.items()) + " ELSE '' END"
RAW = PAGES + f""",
listed AS (
 SELECT page_id, query_id, snippet, ({ENGINES})[page_id % 9 + 1] AS engine, url, title FROM p
 UNION ALL SELECT page_id, query_id, snippet, ({ENGINES})[(page_id + 4) % 9 + 1], url, title || ' - Portal'
  FROM p WHERE page_id % 3 = 0
 UNION ALL SELECT page_id, query_id, snippet, ({ENGINES})[(page_id + 7) % 9 + 1],
  regexp_replace(url, '[?#].*$', '') || '?utm_source=x', title FROM p WHERE page_id % 5 = 0 AND url NOT LIKE '%page=%'),
raw AS (SELECT query_id, {_QTEXT} AS query, engine,
 row_number() OVER (PARTITION BY query_id, engine ORDER BY page_id * 2 + (url LIKE '%?utm_source=x')::INT) - 1 AS ord,
 row_number() OVER (PARTITION BY query_id, engine ORDER BY page_id * 2 + (url LIKE '%?utm_source=x')::INT) AS rank,
 title, url, snippet,
 CASE WHEN page_id % 3 = 1 THEN '2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS date,
 CASE WHEN page_id % 4 = 0 THEN (page_id % 100) / 100.0 END AS score,
 CASE WHEN page_id % 6 = 0 THEN 'high' ELSE '' END AS score_level,
 CASE WHEN page_id % 4 = 2 THEN 'site ' || (page_id % 7) ELSE '' END AS source FROM listed)"""

POOL = RAW + """,
ranks AS (SELECT query_id, url, engine, min(rank) AS rank FROM raw GROUP BY ALL),
pos AS (SELECT query_id, url, string_agg(engine || '#' || rank, ', ' ORDER BY engine) AS positions,
 string_agg(engine, '/' ORDER BY engine) AS engines, list_sort(list(engine)) AS elist FROM ranks GROUP BY ALL),
pool0 AS (SELECT query_id, url, arg_min(title, (-strlen(title), engine, ord)) AS title,
 arg_min(snippet, (-strlen(snippet), engine, ord)) AS snippet,
 arg_min(date, (engine, ord)) FILTER (WHERE date <> '') AS date, min((engine, ord)) AS fs,
 max(score) AS score, arg_min(score_level, (engine, ord)) FILTER (WHERE score_level <> '') AS score_level,
 arg_min(source, (engine, ord)) FILTER (WHERE source <> '') AS source FROM raw GROUP BY query_id, url),
pool AS (SELECT pool0.*, positions, engines, elist,
 row_number() OVER (PARTITION BY pool0.query_id ORDER BY fs) - 1 AS hit_ord
 FROM pool0 JOIN pos USING (query_id, url))"""


def url_ctes(source: str, name: str = "u", mode: str = "default") -> str:
    keys = {"default": fv.TRACKING_MINIMAL + fv.TRACKING_EXTRA, "minimal": fv.TRACKING_MINIMAL, "none": [""]}[mode]
    return f"""{name}0 AS (SELECT *, regexp_extract(url, '^(https?)://([^/?#:]+)(:[0-9]+)?([^?#]*)(\\?[^#]*)?',
 ['scheme', 'host', 'port', 'path', 'q']) AS x FROM {source}),
{name}1 AS (SELECT *, lower(x.host) AS host, string_split(lower(x.host), '.') AS labels,
 list_sort(list_transform(list_filter(string_split(substr(x.q, 2), '&'),
  lambda k: k <> '' AND lower(string_split(k, '=')[1]) NOT IN {_IN(keys)}),
  lambda k: CASE WHEN contains(k, '=') THEN k ELSE k || '=' END)) AS qs FROM {name}0),
{name} AS (SELECT *, host || CASE WHEN rtrim(x.path, '/') = '' THEN '/' ELSE rtrim(x.path, '/') END ||
 CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS norm_url,
 CASE WHEN len(labels) >= 3 AND array_to_string(labels[-2:], '.') IN {_IN(fv.TWO_LEVEL_SUFFIXES)}
 THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS site,
 coalesce(list_filter(string_split(x.path, '/'), lambda s: s <> '')[1], '') AS head FROM {name}1)"""


def feature_ctes(source: str) -> str:
    return url_ctes(source) + f""",
t1 AS (SELECT *, {strip_once(trim("title"))} AS s1 FROM u),
t2 AS (SELECT *, {strip_once("s1")} AS s2 FROM t1),
f AS (SELECT *, {norm_text("s2")} AS tkey, {norm_text("title")} AS ttext, {norm_text("snippet")} AS skey,
 {norm_text("url")} AS utext, list_distinct(regexp_extract_all(url || ' ' || title, '\\p{{Nd}}+')) AS nums FROM t2)"""


def pair_ctes() -> str:
    tj = f"CASE WHEN a.ttext = '' OR b.ttext = '' THEN 0.0 WHEN a.ttext = b.ttext THEN 1.0 ELSE {jaccard(ngrams('a.ttext', 3), ngrams('b.ttext', 3))} END"
    uj = jaccard(ngrams("a.utext", 4), ngrams("b.utext", 4))
    sj = f"CASE WHEN a.skey = '' OR b.skey = '' THEN 0.0 WHEN a.skey = b.skey THEN 1.0 ELSE {jaccard(ngrams('a.skey', 3), ngrams('b.skey', 3))} END"
    return f"""c0 AS (SELECT a.query_id, a.hit_ord AS i, b.hit_ord AS j, a AS a, b AS b FROM f a JOIN f b
 ON a.query_id = b.query_id AND a.hit_ord < b.hit_ord AND ((a.norm_url = b.norm_url AND a.norm_url <> '')
 OR (a.tkey = b.tkey AND a.tkey <> '') OR (a.skey = b.skey AND a.skey <> ''))),
c1 AS (SELECT *, a.norm_url = b.norm_url AS su, a.tkey = b.tkey AND a.tkey <> '' AS st,
 a.skey = b.skey AND a.skey <> '' AS ss, a.host = b.host AS sh, a.site = b.site AS ssite,
 a.head = b.head AND a.head <> '' AS shd,
 CASE WHEN len(a.nums) = 0 AND len(b.nums) = 0 THEN 1.0 ELSE {jaccard("a.nums", "b.nums")} END AS nov FROM c0),
c2 AS (SELECT *, CASE WHEN su THEN NULL WHEN NOT ssite THEN 'veto:cross_site' WHEN NOT shd THEN 'veto:diff_section'
 WHEN nov < 0.3 THEN 'veto:diff_numbers' END AS veto FROM c1),
c3 AS (SELECT *, CASE WHEN su OR veto IS NOT NULL THEN 0.0 ELSE {tj} END AS tsim,
 CASE WHEN su OR veto IS NOT NULL THEN 0.0 ELSE {uj} END AS usim,
 CASE WHEN su OR veto IS NOT NULL OR NOT sh THEN 0.0 ELSE {sj} END AS ssim FROM c2),
e AS (SELECT query_id, i, j, veto, tsim, usim, ssim, CASE WHEN su THEN 'd1:url_exact,same_url'
 WHEN veto IS NOT NULL THEN NULL
 WHEN sh AND tsim >= 0.9 AND ssim >= 0.85 THEN concat_ws(',', CASE WHEN st THEN 'd1:title_exact' END,
  CASE WHEN ss THEN 'd1:snippet_exact' END, 'same_site_path,text_high')
 WHEN usim >= 0.7 AND tsim >= 0.9 THEN concat_ws(',', CASE WHEN st THEN 'd1:title_exact' END,
  CASE WHEN ss THEN 'd1:snippet_exact' END, 'url+title_high', CASE WHEN sh THEN 'same_host' ELSE 'same_site' END)
 END AS reason FROM c3),
k AS (SELECT query_id, i, j, reason FROM e WHERE reason IS NOT NULL)"""


def owner_ctes(rounds: int = 5) -> str:
    out = ["d0 AS (SELECT query_id, hit_ord AS j FROM f WHERE false)"]
    for n in range(1, rounds + 1):
        out.append(f"""s{n} AS (SELECT query_id, hit_ord AS i FROM f WHERE NOT EXISTS (SELECT 1 FROM k
 WHERE k.query_id = f.query_id AND k.j = f.hit_ord AND NOT EXISTS (SELECT 1 FROM d{n - 1} d
 WHERE d.query_id = k.query_id AND d.j = k.i)))""")
        out.append(f"d{n} AS (SELECT DISTINCT k.query_id, k.j FROM k JOIN s{n} USING (query_id, i))")
    out.append(f"""own AS (SELECT query_id, j, min(i) AS owner, arg_min(reason, i) AS reason
 FROM k JOIN s{rounds} USING (query_id, i) GROUP BY query_id, j)""")
    return ",\n".join(out)


DEDUP = POOL + ",\n" + feature_ctes("pool") + ",\n" + pair_ctes() + ",\n" + owner_ctes()
SURVIVORS = DEDUP + """,
g AS (SELECT f.*, coalesce(own.owner, f.hit_ord) AS keeper FROM f LEFT JOIN own
 ON own.query_id = f.query_id AND own.j = f.hit_ord),
kept AS (SELECT query_id, keeper AS hit_ord, arg_min(title, (-strlen(title), hit_ord)) AS title,
 arg_min(snippet, (-strlen(snippet), hit_ord)) AS snippet, arg_min(url, hit_ord) AS url,
 arg_min(date, hit_ord) FILTER (WHERE date IS NOT NULL) AS date, max(score) AS score,
 arg_min(source, hit_ord) FILTER (WHERE source IS NOT NULL) AS source FROM g GROUP BY query_id, keeper),
kpos AS (SELECT query_id, keeper AS hit_ord, string_agg(engine || '#' || rank, ', ' ORDER BY engine) AS positions
 FROM (SELECT g.query_id, g.keeper, r.engine, min(r.rank) AS rank FROM g JOIN ranks r USING (query_id, url) GROUP BY ALL)
 GROUP BY query_id, keeper)"""
VERDICT = """v AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
 CASE WHEN url LIKE 'https:%' THEN '443' ELSE '80' END AS port,
 length(regexp_extract(url, '^https?://([^/?#:]+)', 1)) % 5 <> 0 AS ok FROM pages)"""
TARGET = """regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
 CASE WHEN url LIKE 'https:%' THEN '443' ELSE '80' END AS port"""
FETCH = f"""fl AS (SELECT strftime(ts, '%Y-%m-%d') AS query_id, ({ENGINES})[user_id % 9 + 1] AS engine,
 event_type <> 'error' AS ok, floor(value * 100)::BIGINT AS latency_ms,
 CASE WHEN event_type = 'error' THEN ({_L(ERROR_TEXTS)})[event_id % {len(ERROR_TEXTS)} + 1] ELSE '' END AS error,
 ts AS arrived_at, event_id FROM events)"""
JUDGED = """j AS (SELECT source AS engine, lang AS keyword_id,
 row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank,
 toxic = 1 AND NOT (toxic = 1 AND quality = 0) AS ad, toxic = 1 AND quality = 0 AS off, quality = 0 AS bad
 FROM documents JOIN labels USING (doc_id))"""
CAPS = "caps AS (SELECT DISTINCT source AS engine, CASE WHEN length(source) = 4 THEN 10 ELSE 20 END AS cap FROM documents)"


def cell_ctes(k: int = 15) -> str:
    parts = " UNION ALL ".join(
        f"SELECT engine, keyword_id, '{c}' AS label, count(*) AS n, count(*) FILTER (WHERE {c}) AS bad, "
        f"count(*) FILTER (WHERE {c} AND rank <= {k}) AS top, coalesce(sum(rank) FILTER (WHERE {c}), 0) AS ranks "
        "FROM j GROUP BY engine, keyword_id" for c in ("ad", "off", "bad"))
    return JUDGED + f",\ncells AS ({parts})"


W = "((n + 1) * bad - ranks) / (n * (n + 1) / 2.0)"
MEANS = f"""m AS (SELECT engine, label, round(avg(bad / n::DOUBLE), 6) AS x,
 round(avg(top / least(n, 15)::DOUBLE), 6) AS y, round(avg({W}), 6) AS z FROM cells GROUP BY ALL)"""
NOISE_CTE = """sp AS (SELECT engine, label, avg(bad / n::DOUBLE) AS rate,
 stddev_samp(bad / n::DOUBLE) / sqrt(count(*)) AS se FROM cells GROUP BY ALL),
nf AS (SELECT label, round(median(se), 6) AS median_se, round(2 * median(se), 6) AS two_se,
 round(max(rate) - min(rate), 6) AS engine_range, max(rate) - min(rate) > 2 * median(se) AS separable
 FROM sp GROUP BY label)"""
