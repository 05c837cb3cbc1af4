from pyspark.sql import functions as F

from hitmerge import schemas
from hitmerge.operators import coherence, hits, numbering, paging, reach, status

SIG = lambda **k: tuple(k.get(n) for n in schemas.SIGNAL_FIELDS)


def raw(spark, rows):
    """(query, engine, ord, title, url, snippet, date, signals, rank?)"""
    full = [(r[0], "", r[1], r[2], r[8] if len(r) > 8 else r[2] + 1, *r[3:8]) for r in rows]
    return spark.createDataFrame(full, schemas.RAW_HITS)


def test_exact_merge(spark):
    rows = [
        ("q", "exa", 0, "title long", "u1", "s", "", SIG(score=0.2, source="a")),
        ("q", "bing", 0, "ab", "u2", "x", "", None),
        ("q", "bing", 1, "title lonG", "u1", "longer", "2024", SIG(score=0.9, source="")),
        ("q", "bing", 2, "again", "u1", "", "2025", SIG(score=0.0, source="b")),
        ("q", "exa", 1, "é", "u2", "x", "", SIG(score=0.0, source="")),
        ("q", "exa", 2, "no url", "", "x", "", None),
        ("r", "exa", 0, "other query", "u1", "x", "", None),
    ]
    got = {(r["query_id"], r["url"]): r for r in hits.pool(raw(spark, rows)).collect()}
    assert set(got) == {("q", "u1"), ("q", "u2"), ("r", "u1")}
    one = got["q", "u1"]
    assert one["engine"] == ["bing", "exa"] and one["positions"] == {"bing": 2, "exa": 1}
    assert one["title"] == "title lonG" and one["snippet"] == "longer" and one["date"] == "2024"
    assert one["signals"]["score"] == 0.9 and one["signals"]["source"] == "b" and one["signals"]["card_type"] is None
    assert got["q", "u2"]["title"] == "ab" and got["q", "u2"]["signals"] is None and got["q", "u2"]["date"] is None
    assert got["q", "u2"]["hit_ord"] == 0 and one["hit_ord"] == 1 and got["r", "u1"]["hit_ord"] == 0


def test_rank_fallback_and_cap(spark):
    rows = [("q", "exa", i, "t", f"u{i}" if i != 3 else "", "s", "", None, 0 if i % 2 else i + 50) for i in range(20)]
    ranked = {r["ord"]: r["rank"] for r in hits.with_rank(raw(spark, rows)).collect()}
    assert ranked[0] == 50 and ranked[5] == 6
    kept = [r["ord"] for r in hits.cap_per_engine(hits.drop_blank_urls(raw(spark, rows))).collect()]
    assert sorted(kept) == [i for i in range(16) if i != 3]
    plan = hits.cap_per_engine(raw(spark, rows))._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_numbering_in_small_chunks(spark):
    df = spark.createDataFrame([(g, lead, o) for g in "ab" for lead in "xy" for o in range(0, 60, 3)], "g string, l string, o bigint")
    got = numbering.number_rows(df, ["g"], "o", "n", lead=["l"], chunk=7)
    assert sorted((r["g"], r["n"]) for r in got.collect()) == [(g, i) for g in "ab" for i in range(40)]
    rows = [("k", x, m) for x, m in [(0, 1), (3, 0), (3, 1), (9, 1), (9, 0), (20, 0)]]
    ev = spark.createDataFrame(rows, "key string, x bigint, mark int")
    before = sorted((r["x"], r["before"]) for r in numbering.count_before(ev, ["key"], chunk=4).collect())
    assert before == [(3, 1), (9, 2), (20, 3)]


DECOY = [(f"Kiln, a village ({i})", "Population, history and roads of the parish.", f"https://gazetteer.test/kiln/{i}") for i in range(10)]
GOOD = [("Glaze recipes", "What goes on the pot.", "https://clay.test/recipes"), ("Silica in the pot", "Its chemistry in short.", "https://clay.test/silica"),
        ("Oxides", "Colours and their names.", "https://clay.test/glaze-oxides"), ("Kiln chemistry", "Heat and glaze.", "https://clay.test/heat")]


def test_coherence_and_decoys(spark):
    buckets = [("both", "bing", DECOY), ("both", "exa", GOOD), ("alone", "bing", DECOY), ("few", "exa", GOOD[:3])]
    rows = [(q, e, i, t, u, s, "", None) for q, e, items in buckets for i, (t, s, u) in enumerate(items)]
    rows += [("one", "exa", i, t, u, s, "", None) for i, (t, s, u) in enumerate(GOOD)]
    queries = spark.createDataFrame([(q, "kiln glaze chemistry") for q in ("both", "alone", "few")] + [("one", "kiln")],
                                    "query_id string, query string")
    got = {(r["query_id"], r["engine"]): (r["coherence"], r["decoy"])
           for r in coherence.judge_decoys(coherence.bucket_scores(raw(spark, rows), queries)).collect()}
    assert got == {("both", "bing"): (0.0, True), ("both", "exa"): (1.0, False), ("alone", "bing"): (0.0, False),
                   ("few", "exa"): (None, False), ("one", "exa"): (None, False)}


def test_reach(spark):
    h = spark.createDataFrame([("q", i, u) for i, u in enumerate(
        ["https://a.com/1", "http://a.com/2", "https://dead.com/x", "nonsense", "https://a.com/3", "https://unknown.com/"])],
        "query_id string, hit_ord bigint, url string")
    v = spark.createDataFrame([("a.com", "443", True), ("a.com", "80", False), ("dead.com", "443", False)], schemas.HOST_VERDICT)
    assert [r["hit_ord"] for r in reach.reachable(h, v).orderBy("hit_ord").collect()] == [0, 4]
    assert [r["hit_ord"] for r in reach.unreachable(h, v).orderBy("hit_ord").collect()] == [1, 2, 3, 5]
    s = reach.reach_stats(h, v).first()
    assert (s["hosts_probed"], s["hosts_ok"], s["dropped_items"], s["kept"]) == (4, 1, 4, 2)
    assert sorted(r["address"] for r in reach.unreachable_hosts(h, v).collect()) == ["a.com:80", "dead.com:443", "unknown.com:443"]


def pages(spark, items):
    return spark.createDataFrame([("q", p, i, t, u) for i, (p, t, u) in enumerate(items)],
                                 "query_id string, page bigint, pos bigint, title string, url string")


def listed(df):
    return [(r["rank"], r["url"]) for r in df.orderBy("rank").collect()]


def test_page_merge(spark):
    own = "https://baike.quark.cn/b?id={}&sid={}"
    q = pages(spark, [(1, "a", own.format(1, 1)), (1, "m", "https://m.quark.cn/vsearch/x"), (1, " ", "https://x.com/blank"),
                      (2, "a", own.format(1, 2)), (3, "c", "https://x.com/3")])
    assert listed(paging.page_merge(q, "quark", 15)) == [(1, "https://baike.quark.cn/b?id=1")]  # page 2 adds nothing
    s = pages(spark, [(1, "a", "u1"), (2, "a", "u1"), (3, "c", "u3")])
    assert listed(paging.page_merge(s, "serpapi", 15)) == [(1, "u1"), (2, "u3")]             # a repeat is no empty page
    assert listed(paging.page_merge(pages(spark, [(1, "a", "u1"), (3, "c", "u3")]), "serpapi", 15)) == [(1, "u1")]
    b = pages(spark, [(1, "a", "u1"), (2, "b", "u2"), (3, "c", "u3")])
    assert listed(paging.page_merge(b, "bing", 15)) == [(1, "u1"), (2, "u2")]                # two pages are enough for 15
    log = spark.createDataFrame([("q", 2, False, 9)], "query_id string, page bigint, ok boolean, body_bytes int")
    assert listed(paging.page_merge(s, "serpapi", 15, log)) == [(1, "u1")]
    assert listed(paging.page_merge(s, "serpapi", 1)) == [(1, "u1")]


def test_status(spark):
    log = spark.createDataFrame([("q", "exa", True, 10, ""), ("q", "bing", False, 20, "HTTP 503 x"), ("q", "quark", True, 5, "")],
                                "query_id string, engine string, ok boolean, latency_ms bigint, error string")
    rows = raw(spark, [("q", "exa", i, "t", f"u{i}", "s", "", None) for i in range(17)] + [("q", "bing", 0, "t", "u", "s", "", None)])
    st = status.engine_status(log, rows)
    assert {r["engine"]: (r["ok"], r["count"]) for r in st.collect()} == {"exa": (True, 15), "bing": (False, 0), "quark": (True, 0)}
    classes = {r["engine"]: r["class"] for r in status.failure_counts(st).collect()}
    assert classes == {"exa": "none", "bing": "http_status", "quark": "empty"}
    keys = spark.createDataFrame([("exa",)], "engine string")
    assert sorted(r["engine"] for r in status.default_engines(status.engines(spark), keys).collect()) == ["anysearch", "bing", "exa", "quark"]


def test_requested_limit(spark):
    d = spark.createDataFrame([("exa", 500), ("metaso", 500), ("bing", 0), ("tavily", 30)], "e string, n int")
    assert [r[0] for r in d.select(hits.requested_limit(F.col("n"), F.col("e"))).collect()] == [100, 500, 1, 20]


def test_page_of_rows_without_links_is_not_empty(spark):
    items = [(1, "a", "u1"), (2, "b", ""), (3, "c", "u3")]
    assert [r[1] for r in listed(paging.page_merge(pages(spark, items), "serpapi", 30))] == ["u1", "u3"]
    assert [r[1] for r in listed(paging.page_merge(pages(spark, [items[0], items[2]]), "serpapi", 30))] == ["u1"]


def test_no_task_gets_a_whole_list_of_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    from hitmerge.plans import derived

    pages = 40000
    spark.range(pages).select(F.col("id").alias("page_id"), F.concat(F.lit("https://kiln.test/en/"), "id").alias("url"),
                              F.lit("<title>Mug</title></h1><p>blue</p></article>").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    lists = derived.raw_hits(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    shares = lists.groupBy("engine", "task").agg(F.count("*").alias("n")).groupBy("engine").agg(F.max("n").alias("most"), F.sum("n").alias("rows")).collect()
    assert len(shares) == 9 and max(r["most"] / r["rows"] for r in shares) < 0.9
    ords = lists.groupBy("engine").agg(F.min("ord").alias("a"), F.max("ord").alias("b"), F.countDistinct("ord").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r["a"] == 0 and r["b"] + 1 == r["n"] == r["rows"] for r in ords)


def test_texts_are_not_dealt_by_query_for_scores(spark, monkeypatch):
    from hitmerge.operators import coherence

    raw = spark.createDataFrame([("q", "exa", f"blue mug {i}", "kiln wares", "https://kiln.test/") for i in range(8)],
                                "query_id string, engine string, title string, snippet string, url string")
    queries = spark.createDataFrame([("q", "mug kiln wares")], "query_id string, query string")
    few = coherence.bucket_scores(raw, queries)
    assert "ResolvedHint (strategy=broadcast)" in few._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(coherence, "BROADCAST_QUERIES", 0)
    assert [tuple(r) for r in few.collect()] == [tuple(r) for r in coherence.bucket_scores(raw, queries).collect()]
