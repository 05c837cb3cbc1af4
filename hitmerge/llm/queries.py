"""The numbered operators over the given tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as hits: ``doc_id`` names the hit, ``source`` is its engine, the text its snippet."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("hit_ord"), F.col("source").alias("engine"), F.col("text").alias("snippet"))


def tokenizer() -> dict:
    import public_tokenizers as given

    return {"vocabulary": given.path("byte_bpe_50k.tiktoken"), "pattern": given.PATTERN, "special": (("<|endoftext|>", 50256),)}


@register
def op6_token_counts(spark, sf_dir):
    from hitmerge.llm.tokens import count_tokens

    n = count_tokens(hits(spark, sf_dir), **tokenizer())
    return n.select(F.col("hit_ord").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@register
def op1_ngram_jaccard_join(spark, sf_dir):
    from hitmerge.llm.near_hits import near_hits

    return near_hits(hits(spark, sf_dir), percent=85, words=4).withColumnRenamed("hit_ord", "doc_id")


_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
ORACLES["op1_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1:i + 4], ' '))) AS s
    FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT y, c FROM reach JOIN link USING (x))
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(c) AS c FROM reach GROUP BY 1) r ON r.x = d.doc_id"""


def held_out(doc_id="doc_id"):
    """Rows whose language and labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


@register
def op2_language_id(spark, sf_dir):
    from hitmerge.llm.language import fit, identify

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select(F.col("text").alias("snippet"), F.col("lang").alias("locale")))
    return identify(hits(spark, sf_dir), model).select(
        F.col("hit_ord").alias("doc_id"), held_out("hit_ord").alias("held_out"), F.col("locale").alias("lang_pred"), "score", "ambiguous")


@register
def op4_mix_sources(spark, sf_dir):
    from hitmerge.llm.mixing import mix_engines

    m = mix_engines(hits(spark, sf_dir))
    return m.select(F.col("hit_ord").alias("doc_id"), "size", F.col("engine_size").alias("source_size"), "target", "taken")


ORACLES["op4_mix_sources"] = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
c AS (SELECT *, CAST(floor(log2(size + 1) * 2) AS BIGINT) AS step, coalesce(doc_id, 0) % 1024 AS salt FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(3 * source_size) OVER (
      ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, max(level) OVER () * weight) AS target,
    ('0x' || substr(md5(coalesce(source, '') || '#11'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM l),
r AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY step DESC, salt, doc_id, size) AS rank FROM c),
q AS (SELECT r.*, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS q
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, start + k * 0.6180339887498949::DOUBLE - floor(start + k * 0.6180339887498949::DOUBLE) AS o FROM q, range(32) AS k(k)),
m AS (SELECT *, CAST(least(3, floor(o + rank * q) - floor(o + (rank - 1) * q)) AS BIGINT) * size AS taken FROM o),
b AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken) - any_value(target)), k) AS place FROM m GROUP BY source, k)
SELECT doc_id, size, source_size, target, taken FROM m JOIN b ON m.source IS NOT DISTINCT FROM b.source AND m.k = b.k WHERE place = 1"""


@register
def op5_best_fit_packing(spark, sf_dir):
    from hitmerge.llm.packing import pack_hits

    return pack_hits(hits(spark, sf_dir), **tokenizer()).withColumnRenamed("hit_ord", "doc_id")


@register
def op3_html_extraction(spark, sf_dir):
    from hitmerge.llm.article import main_text

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body"))
    return main_text(pages).select("page_id", "url", F.col("snippet").alias("text"), F.char_length("snippet").cast("long").alias("n_chars"))


@register
def op10_fingerprints(spark, sf_dir):
    from hitmerge.llm.fingerprints import fingerprints, printable

    return fingerprints(hits(spark, sf_dir)).select(
        F.col("hit_ord").alias("doc_id"), "n_chars", "edited_sha256", printable(F.col("print")).alias("fingerprint"),
        printable(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


@register
def op8_toxicity(spark, sf_dir):
    from hitmerge.llm.toxicity import fit, judge

    judged = table(spark, sf_dir, "labels").where(~held_out()).select(F.col("doc_id").alias("hit_ord"), (F.col("toxic") == 1).alias("bad"))
    examples = fit(judged, hits(spark, sf_dir))
    return judge(hits(spark, sf_dir), examples).select(
        F.col("hit_ord").alias("doc_id"), held_out("hit_ord").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register
def op9_embedding_near_dedup(spark, sf_dir):
    from hitmerge.llm.neighbours import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLES["op9_embedding_near_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT y, c FROM reach JOIN link USING (x)),
n AS (SELECT x, count(*) AS n FROM link GROUP BY 1)
SELECT d.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.c AS component_id, d.vec_id = r.c AS kept
FROM embeddings d LEFT JOIN n ON n.x = d.vec_id JOIN (SELECT x, min(c) AS c FROM reach GROUP BY 1) r ON r.x = d.vec_id"""


@register
def op7_substring_dedup(spark, sf_dir):
    from hitmerge.llm.passages import repeated_passages

    found = repeated_passages(hits(spark, sf_dir))
    return found.select(F.col("hit_ord").alias("doc_id"), "start", "n_words", F.col("first_ord").alias("first_doc_id"), "first_start",
                        "first_words", "similarity")


@register
def op13_conversation_repair(spark, sf_dir):
    from hitmerge.llm.conversations import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")))


ORACLES["op13_conversation_repair"] = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    -- crc32: a byte is added, then eight times a bit is shifted out (-1).
    xor(list_reduce([4294967295] || flatten(list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS f FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS k FROM c WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, k) AS i FROM d),
q AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND (before || r) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM q GROUP BY 1),
-- State 0: nothing kept, 1: after s, 2: after u, 3: after a. A turn made to fit leads to 2, or from 2 to 3.
made(s, t, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (3, 2, 'user'), (2, 3, 'assistant')),
kept(r, s, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
more AS (
  SELECT s, s AS t, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM made
  UNION ALL SELECT s, t, 3, 'I', [role || ':'] FROM made
  UNION ALL SELECT a.s, b.t, 6, 'II', [a.role || ':', b.role || ':'] FROM made a JOIN made b ON a.t = b.s),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM n
  UNION ALL
  SELECT conv_id, i, s, cost, audit, lines FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.t AS s, w.cost + m.cost + e.cost AS cost, w.audit || m.audit || e.letter AS audit,
      w.lines || m.lines || e.lines AS lines,
      row_number() OVER (PARTITION BY w.conv_id, e.t ORDER BY w.cost + m.cost + e.cost, w.audit || m.audit || e.letter) AS place
    FROM walk w JOIN more m ON m.s = w.s JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.i = w.i + 1,
      LATERAL (
        SELECT m.t AS t, 4 AS cost, 'D' AS letter, CAST([] AS VARCHAR[]) AS lines
        UNION ALL SELECT k.t, CASE q.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [q.role || ':' || q.text] FROM kept k
          WHERE k.s = m.t AND k.r = q.r AND q.fault IN ('', 'truncated')
        UNION ALL SELECT v.t, CASE q.fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [v.role || ':' || q.text] FROM made v
          WHERE v.s = m.t AND q.fault IN ('', 'truncated')) e) WHERE place = 1),
best AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS place FROM (
    SELECT w.conv_id, w.cost + m.cost AS cost, w.audit || m.audit AS audit, w.lines || m.lines AS lines
    FROM walk w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.rows = w.i JOIN more m ON m.s = w.s WHERE m.t IN (0, 3))),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(n.gaps, 0) AS BIGINT) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate,
  coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id AND b.place = 1"""


@register
def op12_ranked_search(spark, sf_dir):
    from hitmerge.llm.ranking import index, search

    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search(index(hits(spark, sf_dir)), asked).select(F.col("query_id").alias("item_id"), "rank", F.col("hit_ord").alias("doc_id"), "score")


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLES["op12_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents),
g AS (SELECT CAST(count(*) AS BIGINT) AS hits, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
m AS (SELECT k, doc_id, 75 + (25 * len(t) * hits) // total AS m FROM d, g WHERE len(t) > 0),
b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
i AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(t) AS term FROM b) GROUP BY 1, 2),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) SEMI JOIN i USING (term) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * hits + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, hits),
s AS (
  SELECT q, k, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY 1, 2 HAVING score > 0),
r AS (SELECT q, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM s JOIN m USING (k))
SELECT b.item_id, rank, doc_id, score FROM r JOIN b USING (q) WHERE rank <= 20"""


@register
def op11_quality_classifier(spark, sf_dir):
    from hitmerge.llm.line_quality import fit, judge

    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False)).alias("held_out")
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("hit_ord"), (F.col("quality") == 0).alias("bad"), out).where("not held_out")
    found = judge(hits(spark, sf_dir), fit(judged, hits(spark, sf_dir))).withColumnRenamed("hit_ord", "doc_id")
    return found.select("doc_id", out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "bad_lines")
