import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from hitmerge.functions import text
from hitmerge.operators import dedup

HIT = ("query_id string, hit_ord bigint, engine array<string>, positions map<string,bigint>, title string, "
       "snippet string, url string, date string, signals struct<score:double,score_level:string,rerank_score:double,"
       "authority_score:double,source:string,card_type:string>")


def table(spark, rows):
    full = []
    for i, r in enumerate(rows):
        url, title, snippet, engines = (list(r) + [[]])[:4] if len(r) < 4 else r[:4]
        query = r[4] if len(r) > 4 else "q"
        full.append((query, i, list(engines), {e: i + 1 for e in engines}, title, snippet, url, None, None))
    return spark.createDataFrame(full, HIT)


def owners(spark, rows, **kw):
    return {r["pos"]: (r["owner"], r["reason"]) for r in dedup.find_owners(table(spark, rows), **kw).collect()}


SAME = "a text that is long enough for its shingles to pass every threshold of this decision"
MERGED = {
    "trailing slash": [("https://kiln.test/wares/%E9%87%89/", "Blue glazes", "one text"),
                       ("https://kiln.test/wares/%E9%87%89", "Blue glazes - Kiln", "another text")],
    "escaped path": [("https://kiln.test/wares/釉/4", "Glaze", "one"), ("https://kiln.test/wares/%e9%87%89/4", "Glaze | Kiln", "two")],
    "tracking key": [("https://kiln.test/wares/mug", "Mugs", "one"), ("https://kiln.test/wares/mug?yclid=77&_gl=3", "Mugs", "two")],
    "harmless parameter": [("https://www.kiln.test/ask/5561203", "Why does glaze crawl? - Kiln", "an answer"),
                           ("https://www.kiln.test/ask/5561203?reply", "Why does glaze crawl? - Kiln", "an answer")],
    "subdomain": [("https://www.kiln.test/story_long_name_7781", "Kiln reopens", SAME), ("https://m.kiln.test/story_long_name_7781", "Kiln reopens", SAME)],
}
KEPT = {
    "escaped slash": ([("https://kiln.test/blue%2Fred", "one title", "one"), ("https://kiln.test/blue/red", "two title", "two")], None),
    "home page": ([("https://kiln.test/", "Wares and prices", "home"), ("https://kiln.test/wares/62", "Wares and prices", "list")], "veto:diff_section"),
    "other site": ([("https://kiln.test/wares/1", "The same headline", "the same text"), ("https://oven.test/news/1", "The same headline", "the same text")],
                   "veto:cross_site"),
    "other numbers": ([("https://kiln.test/wares/40115", "Gallery - Kiln", "first page"), ("https://kiln.test/wares/88732", "Gallery - Kiln", "second page")],
                      "veto:diff_numbers"),
}


def test_literal_cases(spark):
    """All cases in one job, each as its own query."""
    rows, at = [], {}
    for name, pair in [*MERGED.items(), *((k, v[0]) for k, v in KEPT.items())]:
        at[name] = len(rows)
        rows += [(*r, [], name) for r in pair]
    hits = table(spark, rows)
    found = dedup.find_owners(hits)
    got = {r["query_id"]: (r["pos"], r["owner"], r["reason"]) for r in found.collect()}
    assert set(got) == set(MERGED)
    for name in MERGED:
        assert got[name][:2] == (at[name] + 1, at[name])
    assert got["trailing slash"][2] == "d1:url_exact,same_url"
    assert got["harmless parameter"][2] == "d1:title_exact,d1:snippet_exact,same_site_path,text_high"
    assert got["subdomain"][2] == "d1:title_exact,d1:snippet_exact,url+title_high,same_site"
    vetoes = {r["query_id"]: r["veto"] for r in dedup.veto_histogram(hits, found).collect()}
    assert vetoes == {k: v for k, (_, v) in KEPT.items() if v}


def test_merge_keeps_everything(spark):
    rows = [("https://x.com/a", "主条目标题", SAME, ["exa"]), ("https://x.com/a/", "备用条目的长标题", SAME, ["tavily", "exa"])]
    r = dedup.dedup(table(spark, rows))
    hit, alt = r.hits.collect()[0], r.absorbed.collect()[0]
    assert r.hits.count() == 1 and hit["url"] == "https://x.com/a" and hit["title"] == "备用条目的长标题"
    assert hit["engine"] == ["exa", "tavily"] and hit["positions"] == {"exa": 1, "tavily": 2}
    assert (alt["url"], alt["title"], alt["engine"]) == ("https://x.com/a/", "备用条目的长标题", ["tavily", "exa"])
    assert alt["reason"] == "d1:url_exact,same_url" and alt["survivor"] == 0


def test_empty_and_single(spark):
    assert owners(spark, []) == {}
    assert owners(spark, [("https://x.com/a", "t", "s")]) == {}


def test_not_transitive(spark):
    """a-b and b-c match, a-c does not: c survives."""
    n = "https://a.com/s/{}"
    rows = [(n.format("1-2-3"), "标题", SAME), (n.format("3-4-5-2"), "标题", SAME), (n.format("5-4-6-7"), "标题", SAME)]
    got = owners(spark, rows)
    assert got[1][0] == 0 and 2 not in got


# ---- against a direct walk over all pairs --------------------------------------------------
def grams(t, n):
    return {t[i:i + n] for i in range(max(len(t) - n + 1, 1))} if t else set()


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def walk(rows):
    """The decision as a plain loop over collected feature rows."""
    gone, veto = {}, {}
    for a, b in combinations(rows, 2):
        if a["pos"] in gone or b["pos"] in gone:
            continue
        if a["norm_url"] and a["norm_url"] == b["norm_url"]:
            gone[b["pos"]] = (a["pos"], "d1:url_exact,same_url")
            continue
        d1 = [n for n, k in (("d1:title_exact", "tkey"), ("d1:snippet_exact", "snip")) if a[k] and a[k] == b[k]]
        if not d1:
            continue
        site = a["host"] and b["host"] and a["site"] == b["site"]
        na, nb = set(a["nums"]), set(b["nums"])
        overlap = len(na & nb) / len(na | nb) if na | nb else 1.0
        why = ("veto:cross_site" if not site else "veto:diff_section" if not a["head_key"] or a["head_key"] != b["head_key"]
               else "veto:diff_numbers" if overlap < 0.3 else None)
        if why:
            veto[why] = veto.get(why, 0) + 1
            continue
        t = jac(grams(a["ttext"], 3), grams(b["ttext"], 3))
        s = jac(grams(a["snip"], 3), grams(b["snip"], 3))
        u = jac(grams(a["utext"], 4), grams(b["utext"], 4))
        if a["host"] == b["host"] and t >= 0.9 and s >= 0.85:
            gone[b["pos"]] = (a["pos"], ",".join(d1 + ["same_site_path", "text_high"]))
        elif u >= 0.7 and t >= 0.9:
            gone[b["pos"]] = (a["pos"], ",".join(d1 + ["url+title_high", "same_host" if a["host"] == b["host"] else "same_site"]))
    return gone, veto


def sample(seed, n, copies=0.0):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta kilo lima mike oscar papa tango".split()
    base = " ".join(rnd.choices(words, k=30))
    rows = []
    for i in range(n):
        host = rnd.choice(["www.a.com", "m.a.com", "a.com", "b.com", ""])
        head = rnd.choice(["news", "news", "news", "shop", ""])
        nums = "-".join(str(rnd.randint(1, 4)) for _ in range(rnd.randint(0, 3)))
        title = rnd.choice(["big red story of the year", "big red story of the year - Site", "other thing 7", ""])
        snippet = rnd.choice([base, base, base + " " + rnd.choice(words), " ".join(rnd.choices(words, k=12)), ""])
        path = "/".join(x for x in (head, rnd.choice(["page", "pages-long-name", "x"]) + nums) if x)
        url = f"https://{host}/{path}" if host else f"A.com/{path}"
        if rnd.random() < copies:
            url, title, snippet = f"https://www.a.com/news/copy?sid={rnd.randint(1, 10 ** 6)}&k=77", "big red story of the year", base
        rows.append((url, title, snippet, ["e"], "q"))
    return rows


@pytest.mark.parametrize("seed,n,copies,sizes", [
    (1, 120, 0.0, {}), (2, 120, 0.3, dict(hot_bucket=3, leaders=2, fold_rounds=1)),
    (3, 80, 0.0, dict(hot_bucket=1, leaders=1, fold_rounds=2, fold_edges=2)), (4, 90, 0.1, dict(hot_bucket=5, fold_edges=30)),
])
def test_matches_direct_walk(spark, seed, n, copies, sizes):
    from pyspark.sql import functions as F

    from hitmerge.functions.text import norm_text

    hits = table(spark, sample(seed, n, copies)).cache()
    feats = dedup.features(hits).join(dedup.snippet_texts(hits), ["query_id", "pos"]) \
        .withColumn("utext", norm_text(F.col("url"))).orderBy("pos").collect()
    want, veto = walk([r.asDict() for r in feats])
    found = dedup.find_owners(hits, **sizes)
    assert {r["pos"]: (r["owner"], r["reason"]) for r in found.collect()} == want
    assert len(want) > 5
    assert {r["veto"]: r["n"] for r in dedup.veto_histogram(hits, found).collect()} == veto


def test_hot_group_of_copies(spark):
    """A third of all rows are copies under one title: one survivor, few comparisons."""
    rows = [(f"https://www.a.com/news/2024?session={i:05d}x", "one hot title", SAME) for i in range(700)]
    rows += [(f"https://s{i}.org/p/{i}", f"title number {i}", f"text {i}") for i in range(300)]
    got = owners(spark, rows)
    assert set(got) == set(range(1, 700)) and {o for o, _ in got.values()} == {0}


def test_counts_of_one_number_set(spark):
    """20,000 rows of one section and title that other rules keep apart: counted, not paired."""
    from pyspark.sql import functions as F

    n = 20000
    hits = spark.range(n).select(
        F.lit("q").alias("query_id"), F.col("id").alias("hit_ord"), F.array(F.lit("e")).alias("engine"),
        F.create_map(F.lit("e"), F.col("id")).alias("positions"), F.lit("one title").alias("title"), F.md5(F.col("id").cast("string")).alias("snippet"),
        F.concat(F.lit("https://www.a.com/news/2024?"), F.translate(F.md5(F.concat(F.lit("x"), "id")), "0123456789", "ghijklmnop")).alias("url"),
        F.lit(None).cast("string").alias("date"), F.lit(None).cast("struct<score:double,score_level:string,rerank_score:double,"
                                                                   "authority_score:double,source:string,card_type:string>").alias("signals"))
    feats = dedup.features(hits).withColumn("owner", F.lit(None).cast("bigint")).withColumn("limit", F.col("pos")).cache()
    assert dedup._similar_numbers(feats).first()["similar"] == n * (n - 1) // 2


def chain(n):
    """Rows of one site and title; each is nearly the one before it, and only that."""
    word = [f"{chr(97 + i % 26)}{i:03d}q" for i in range(n + 20)]
    letters = str.maketrans("0123456789", "abcdefghij")
    return [(f"https://www.a.com/news/{i * 7919:07d}".translate(letters), "one long title", "".join(word[i:i + 20]), ["e"]) for i in range(n)]


def test_long_chain_on_a_large_site(spark):
    from pyspark.sql import functions as F

    from hitmerge.functions.text import norm_text

    rows = chain(400) + [(f"https://www.a.com/news/x{i}", f"title of its own {i}", f"text {i}", ["e"]) for i in range(150)]
    hits = table(spark, rows).cache()
    feats = dedup.features(hits).join(dedup.snippet_texts(hits), ["query_id", "pos"]) \
        .withColumn("utext", norm_text(F.col("url"))).orderBy("pos").collect()
    want, _ = walk([r.asDict() for r in feats])
    assert 150 < len(want) < 399
    assert {r["pos"]: (r["owner"], r["reason"]) for r in dedup.find_owners(hits).collect()} == want


def test_audit_margins(spark):
    """One merge with a thin margin, one pair that just misses."""
    n = "https://a.com/s/{}-2024"
    rows = [(n.format("page"), "one two three four", SAME), (n.format("page") + "?x", "one two three four", "else"),
            (n.format("quite-another-name-of-it"), "one two three four", SAME[:-16])]
    hits = table(spark, rows)
    found = dedup.find_owners(hits)
    audit = dedup.merge_audit(hits, found).collect()
    assert [(r["survivor"], r["absorbed"]) for r in audit] == [(0, 1)] and 0 <= audit[0]["margin"] <= 0.1
    missed = dedup.near_misses(hits, found).collect()
    assert [(r["i"], r["j"]) for r in missed] == [(0, 2)] and 0 < missed[0]["gap"] < 0.15


def test_snippet_similarity_equals_the_jaccard_of_shingles(spark):
    texts = ["", "a", "ab", "abc", "abcd", "xabcab", "蓝釉蓝釉杯", "\U0001F3FA\U0001F3FAab", "kiln mug glaze " * 300, "kiln mug glaze " * 299 + "bowl", "\U0010FFFF" * 5]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(dedup.snippet_similarity(a, b).alias("x"), text.text_jaccard(a, b, 3).alias("y"), F.size(dedup.gram_ids(a)).alias("n"),
                    F.size(text.shingles(a, 3)).alias("m")).collect()
    assert all(r["x"] == r["y"] and r["n"] == r["m"] for r in got) and len({r["x"] for r in got}) > 3


def test_only_wanted_texts_are_fetched(spark):
    docs = spark.createDataFrame([("q", i, f"Text {i}!") for i in range(9)], "query_id string, hit_ord bigint, snippet string")
    wanted = spark.createDataFrame([("q", 4), ("p", 5)], "query_id string, pos bigint")
    assert [tuple(r) for r in dedup.snippet_texts(docs, wanted).collect()] == [("q", 4, "text4")]


@pytest.mark.parametrize("hot_bucket", [4, 64])
def test_the_pool_is_asked_for_texts_once(spark, monkeypatch, hot_bucket):
    """However many rounds there are, and only for rows of one title and host whose texts differ."""
    rows = [(f"https://www.a.com/news/{'ab'[i % 2]}{i}x?part=2", "one title of pages", f"{SAME} {SAME} {'yz'[i % 2] * (i % 5 + 1)}") for i in range(24)]
    rows += [("https://www.a.com/news/7?part=3", "title of copies", "same"), ("https://www.a.com/news/7/q?part=3", "title of copies", "same"),
             ("https://www.a.com/news/8", "alone", "text"), ("https://b.a.com/news/9", "on two hosts", "one"), ("https://c.a.com/news/9", "on two hosts", "two")]
    hits = table(spark, rows)
    asked, fetch = [], dedup.snippet_texts
    monkeypatch.setattr(dedup, "snippet_texts", lambda pool, wanted=None: (asked.append({r["pos"] for r in wanted.collect()}), fetch(pool, wanted))[1])
    found = {r["pos"]: r["owner"] for r in dedup.find_owners(hits, hot_bucket=hot_bucket, leaders=2).collect()}
    assert asked == [set(range(24))]
    assert found and found.keys() <= set(range(24)) | {25} and found[25] == 24


def test_rows_with_different_numbers_share_no_bucket(spark):
    """200 pages of one title that the number rule keeps apart; two with a common number do meet."""
    rows = [(f"https://www.a.com/news/{10 ** 6 + 7919 * i}", "one hot title", f"text {i}") for i in range(200)]
    rows += [("https://www.a.com/news/77-1", "one hot title", "x"), ("https://www.a.com/news/77-2", "one hot title", "y")]
    kept = dedup._only_shared_buckets(dedup.features(table(spark, rows)))
    assert {r["pos"] for r in kept.collect()} == {200, 201}


@pytest.mark.parametrize("block", [4, 512])
def test_similar_texts_are_those_of_all_pairs(spark, monkeypatch, block):
    """Sketches lose no pair, whether a scope is cut into blocks or shares a task with others."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    rnd = random.Random(block)
    base = ["".join(rnd.choices("abcdefgh", k=n)) for n in (40, 60, 200)]
    rows = [("q", i, i % 3, (t := rnd.choice(base))[rnd.randint(0, 12):] + "".join(rnd.choices("xyz", k=rnd.randint(0, 25)))) for i in range(90)]
    found = dedup._similar_texts(spark.createDataFrame(rows, "query_id string, pos bigint, scope bigint, snip string"), 0.7)
    pairs = found.groupBy("query_id", "bucket").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    got = {tuple(r["p"]) for r in pairs}
    want = {(a[1], b[1]) for a, b in combinations(rows, 2) if a[2] == b[2] and jac(grams(a[3], 3), grams(b[3], 3)) >= 0.7}
    assert want and want <= got and len(got) < 3 * 30 * 29 / 2 / 2


def test_rare_shingles_lose_no_pair_and_leave_common_ones_out(spark):
    """Addresses that differ in their last digits only meet where these do."""
    rnd = random.Random(5)
    rows = [("q", i, i % 2, f"httpsahostexampleorg{rnd.choice([4285, 8892, 3636, 1207, 55])}{rnd.randint(0, 999):03d}") for i in range(150)]
    buckets = dedup._rare(spark.createDataFrame(rows, "query_id string, pos bigint, scope bigint, t string"), text.shingles(F.col("t"), 4), 0.7).collect()
    by = {}
    for r in buckets:
        by.setdefault(r["bucket"], set()).add(r["pos"])
    got = {p for s in by.values() for p in combinations(sorted(s), 2)}
    both = [(a, b) for a, b in combinations(rows, 2) if a[2] == b[2]]
    want = {(a[1], b[1]) for a, b in both if jac(grams(a[3], 4), grams(b[3], 4)) >= 0.7}
    assert want and want <= got and len(got) < 0.8 * len(both)


@pytest.mark.parametrize("block", [4, 512])
def test_similar_texts_meet_survivors_only(spark, monkeypatch, block):
    """Of a group of near copies the pairs of survivors with the rows after them are listed, not all pairs."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    rnd = random.Random(block)
    texts = ["".join(rnd.choices("abcdefgh", k=60)) + "xyz"[i % 3] * (i % 4) for i in (0, 1)]
    rows = [("q", i, rnd.choice((i, i, 5, 0)) if i > 5 else i, 1, texts[i % 2] + "".join(rnd.choices("xyz", k=rnd.randint(0, 9)))) for i in range(60)]
    table_ = spark.createDataFrame(rows, "query_id string, pos bigint, limit bigint, scope bigint, snip string")
    found = dedup._similar_sketches(table_.withColumn("sk", dedup.sketch(F.col("snip"))), 0.7)
    got = [tuple(r["p"]) for r in found.groupBy("query_id", "bucket").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()]
    meets = {(a[1], b[1]) for a, b in combinations(rows, 2) if a[2] == a[1] and a[1] < b[2]}
    want = {(i, j) for i, j in meets if jac(grams(rows[i][4], 3), grams(rows[j][4], 3)) >= 0.7}
    assert len(got) == len(set(got)) and want <= set(got) <= meets and want
    assert len(want) < 0.9 * sum(jac(grams(a[4], 3), grams(b[4], 3)) >= 0.7 for a, b in combinations(rows, 2))


def test_near_misses_and_owners_share_features_and_texts(spark, monkeypatch):
    """Both steps together ask the pool for texts once; equal and missing texts and those of two hosts are not asked for."""
    n = "https://a.com/s/{}-2024"
    rows = [(n.format("page"), "one two three four", SAME), (n.format("page") + "?x", "one two three four", "else"),
            (n.format("quite-another-name-of-it"), "one two three four", SAME[:-16]), (n.format("page-without"), "one two three four", ""),
            ("https://b.a.com/s/pages-2024", "one two three four", "other host"), (n.format("qagesz"), "one two three five", SAME)]
    hits = table(spark, rows)
    want = sorted(tuple(r) for r in dedup.near_misses(hits, dedup.find_owners(hits)).collect())
    asked, fetch = [], dedup.snippet_texts
    monkeypatch.setattr(dedup, "snippet_texts", lambda *given: (asked.append(1), fetch(*given))[1])
    feats = dedup.features(hits)
    texts = dedup.texts_of(hits, feats)
    got = dedup.near_misses(hits, dedup.find_owners(hits, feats=feats, texts=texts), feats=feats, texts=texts).collect()
    assert sorted(tuple(r) for r in got) == want and want and len(asked) == 1


def test_url_similarity_equals_the_jaccard_of_shingles(spark):
    urls = ["", "a", "https://a.b/c", "https://a.b/cd?e=1", "\U0001F3FA\U0001F3FAab", "蓝釉蓝釉杯", None, "https://a.b/" + "xy" * 50]
    df = spark.createDataFrame([((a,), (b,)) for a in urls for b in urls], "a struct<url string>, b struct<url string>")
    a, b = F.col("a"), F.col("b")
    got = df.select(dedup.url_similarity(a, b).alias("x"), text.text_jaccard(text.norm_text(a["url"]), text.norm_text(b["url"]), 4).alias("y"), a["url"].alias("u"), b["url"].alias("v")).collect()
    assert all(r["x"] == r["y"] for r in got if r["u"] is not None and r["v"] is not None) and len({r["x"] for r in got}) > 3
