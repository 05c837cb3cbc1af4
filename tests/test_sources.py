import json

import pytest

from hitmerge import fixed_values as fv
from hitmerge import schemas
from hitmerge.operators import dedup, reach
from hitmerge.plans import jobs
from hitmerge.sources import landed, logs, pages, sinks


def bodies(spark, body):
    return spark.createDataFrame([("q", "text", body if isinstance(body, str) else json.dumps(body, ensure_ascii=False))],
                                 "query_id string, query string, body string")


def rows(df):
    return [r.asDict(True) for r in df.orderBy("ord").collect()]


CASES = {
    "exa": ({"results": [{"title": " T ", "url": "u", "text": "see [x](y)", "publishedDate": "2024"}, {"title": "n", "url": ""}]},
            dict(title="T", url="u", snippet="see x", date="2024", rank=1, signals=None)),
    "tavily": ({"results": [{"title": "T", "url": "u", "content": " ", "snippet": "s", "score": 0.8}]},
               dict(snippet="s", date="", score=0.8)),
    "anysearch": ({"code": 0, "data": {"results": [{"name": "N", "link": "u", "snippet": "s"}, {"url": "no title"}]}},
                  dict(title="N", url="u", snippet="s")),
    "serpapi": ({"organic_results": [{"title": "T", "link": "u", "snippet": "s", "date": " d ", "source": " src "}]},
                dict(date="d", source="src")),
    "qianfan": ({"references": [{"title": "T", "url": "u", "snippet": "", "content": "c", "rerank_score": 1, "authority_score": 0.5, "website": "w"}]},
                dict(snippet="c", rerank_score=1.0, authority_score=0.5, source="w")),
    "metaso": ({"webpages": [{"title": "T", "link": "u", "snippet": "s", "score": "high"}]}, dict(score_level="high", score=None)),
    "tinyfish": ({"results": [{"position": 0, "title": "T", "url": "u", "snippet": "s", "site_name": "S"},
                              {"position": 7, "title": "T2", "url": "u2", "snippet": "s"}]}, dict(rank=1, source="S")),
}


@pytest.mark.parametrize("engine", sorted(CASES))
def test_landed_fields(spark, engine):
    body, want = CASES[engine]
    got = rows(landed.from_bodies(bodies(spark, body), engine))
    first = {**got[0], **(got[0]["signals"] or {})}
    assert {k: first[k] for k in want} == want and first["engine"] == engine
    assert len(got) == (2 if engine == "tinyfish" else 1)
    if engine == "tinyfish":
        assert got[1]["rank"] == 7


def test_failed_bodies_give_no_rows(spark):
    assert rows(landed.from_bodies(bodies(spark, "<html>"), "exa")) == []
    assert rows(landed.from_bodies(bodies(spark, {"code": 3, "data": {"results": [{"title": "T", "url": "u"}]}}), "anysearch")) == []


BING = """<ol><li class="b_algo x"><h2><a href="https://a.com/?x=1&amp;y=2">A &lt;b&gt;<b>old</b></a></h2>
<div class="b_caption"><p>cap <i>tion</i></p></div></li>
<li class="b_algo"><h2><a href="https://b.com">B</a></h2><p>plain<li class="b_algo"><h2><a href="javascript:;">no</a></h2></li>
<li class="b_algo"><p>no title</p></li></ol>"""
QUARK = """<div class="sc" data-sc='{"sc":"ss_text"}'><div class="qk-card">
<a class="qk-link-wrapper" data-openpageurl="https://a.com/1"><span class="qk-title-text">First <em>one</em></span><div class="qk-paragraph-text">tag</div></a>
<a class="qk-link-wrapper"><div class="qk-paragraph-text">short</div><div class="qk-paragraph-text">the longest paragraph</div></a>
<a class="qk-link-wrapper" href="https://a.com/2"><span class="qk-title-text">Second</span></a>
<a class="qk-link-wrapper" href="javascript:;"><span class="qk-title-text">Third</span></a></div></div>
<div class="sc"><section><a class="qk-link-wrapper" href="https://a.com/3"><b class="qk-title-text">Alone</b></a></section>
<div class="qk-paragraph-text">outer text</div></div>"""


def test_html(spark):
    df = spark.createDataFrame([("q", 1, BING), ("q", 2, "")], "query_id string, page bigint, html string")
    got = [(r["title"], r["url"], r["snippet"]) for r in pages.html_rows(df, "bing").orderBy("pos").collect()]
    assert got == [("A <b>old", "https://a.com/?x=1&y=2", "cap tion"), ("B", "https://b.com", "plain")]
    df = spark.createDataFrame([("q", 1, QUARK)], "query_id string, page bigint, html string")
    got = [(r["title"], r["url"], r["snippet"], r["signals"] and r["signals"]["card_type"])
           for r in pages.html_rows(df, "quark").orderBy("pos").collect()]
    assert got == [("First one", "https://a.com/1", "the longest paragraph", "ss_text"),
                   ("Second", "https://a.com/2", "", "ss_text"), ("Alone", "https://a.com/3", "outer text", None)]


HITS = ("query_id string, hit_ord bigint, engine array<string>, positions map<string,bigint>, title string, snippet string, "
        f"url string, date string, signals {schemas.SIGNALS}")


def sample(spark, more=0):
    """A round of two pages, the first with ``more`` + 1 absorbed URLs, and a round without hits."""
    page = "one text of the page " * 9
    rows = [("q", 0, ["exa"], {"exa": 2}, "Mugs", page, "https://kiln.test/mug", "2024", (0.5, None, None, None, None, None)),
            ("q", 4, ["bing"], {"bing": 1}, "Blue mugs", page, "https://kiln.test/mug/", None, None),
            ("q", 9, ["bing"], {"bing": 2}, "Bowls", "", "https://oven.test/", None, None)]
    rows += [("q", 10 + i, ["exa"], {"exa": 3 + i}, "Mugs", page, f"https://kiln.test/mug?utm_source={i}", None, None) for i in range(more)]
    hits = spark.createDataFrame(rows, HITS)
    r = dedup.dedup(hits)
    ask = spark.createDataFrame([("q", "blue mugs"), ("none", "nothing")], "query_id string, query string")
    log = spark.createDataFrame([("q", "exa", True, 12, "", 1700000000), ("q", "bing", False, 3, "HTTP 503", 1700000001), ("none", "exa", True, 5, "", 1700000000)],
                                "query_id string, engine string, ok boolean, latency_ms bigint, error string, at bigint") \
        .selectExpr("* except (at)", "timestamp_seconds(at) AS arrived_at")
    st = log.selectExpr("query_id", "engine", "ok", "if(ok and query_id = 'q', 1, 0) AS count", "latency_ms", "error",
                        "cast(null as double) AS coherence", "engine = 'exa' AND query_id = 'q' AS decoy")
    verdict = spark.createDataFrame([("kiln.test", "443", True), ("oven.test", "443", True)], schemas.HOST_VERDICT)
    report = jobs.envelope(ask, log, st, dedup.dedup_stats(hits, r.owners), dedup.veto_histogram(hits, r.owners), dedup.pass_histogram(r.owners),
                           reach.reach_stats(r.hits, verdict), reach.unreachable_hosts(r.hits, verdict))
    return report, r.hits, r.absorbed


def test_sinks(spark, tmp_path):
    parts = sample(spark)
    objects = {r["query_id"]: json.loads(r["json"]) for r in sinks.report_json(*parts).collect()}
    report, empty = objects["q"], objects["none"]
    assert list(report) == ["query", "engines", "generated_at", "elapsed_ms", "engine_status", "dedup", "reachability", "stats", "results"] == list(empty)
    assert report["engine_status"] == [{"engine": "bing", "ok": False, "count": 0, "latency_ms": 3, "error": "HTTP 503"},
                                       {"engine": "exa", "ok": True, "count": 1, "latency_ms": 12, "decoy": True}]
    assert report["dedup"] == {
        "mode": "conservative", "threshold": 0.9, "raw": 3, "final": 2, "total_merged": 1, "pass": {"same_url": 1},
        "stages": [{"stage": "d1_url_exact", "before": 3, "after": 2, "merged": 1}, {"stage": "d2_judged", "before": 2, "after": 2, "merged": 0}]}
    assert report["reachability"] == {"enabled": True, "hosts_probed": 2, "hosts_ok": 2, "dropped_items": 0, "kept": 2, "prefetched": 2}
    assert report["stats"] == {"candidates": 2, "returned": 2} and empty["results"] == [] and empty["dedup"]["stages"] == []
    assert [h["url"] for h in report["results"]] == ["https://kiln.test/mug", "https://oven.test/"]
    assert report["results"][0]["merged_from"] == {
        "https://kiln.test/mug/": {"title": "Blue mugs", "engine": ["bing"], "reason": "d1:url_exact,same_url"}}
    assert list(report["results"][0]["positions"]) == ["bing", "exa"] and "merged_from" not in report["results"][1]

    path = str(tmp_path / "report")
    sinks.report_json(*parts).selectExpr("json AS value").write.text(path)
    back = logs.read_stored_reports(spark, path).orderBy("hit_ord").collect()
    assert [(r["hit_ord"], r["url"], r["merged_from"]) for r in back] == [(0, "https://kiln.test/mug", None), (1, "https://oven.test/", None)]

    lines = [json.loads(r["json"]) for r in sinks.report_lines(*parts).filter("query_id = 'q'").orderBy("line", "sub").collect()]
    assert lines[0]["dedup"]["raw"] == 3 and "results" not in lines[0] and lines[1]["date"] == "2024"
    assert lines[2] == {"merged_from": report["results"][0]["merged_from"]} and "date" not in lines[3]
    sinks.write_lines(sinks.report_lines(*parts), str(tmp_path / "lines"), "json", "line", "sub")
    assert spark.read.text(str(tmp_path / "lines")).count() == 5


def test_hit_with_many_absorbed_urls(spark, tmp_path):
    report, hits, absorbed = sample(spark, more=2499)
    lines = sinks.report_lines(report, hits, absorbed).filter("query_id = 'q' and line >= 0").collect()
    assert sorted(r["line"] for r in lines if r["sub"] == "") == [0, 9]
    assert len({r["sub"] for r in lines} - {""}) == 2500 == len(lines) - 2
    text = sinks.report_text(report, hits, absorbed).filter("query_id = 'q' and section = 1").collect()
    assert sorted(r["line"] for r in text if r["sub"] == "") == [0, 1] and len(text) == 2502
    sinks.report_json(report, hits, absorbed).selectExpr("json AS value").write.text(str(tmp_path / "r"))
    assert sorted(r["url"] for r in logs.read_stored_reports(spark, str(tmp_path / "r")).collect()) == ["https://kiln.test/mug", "https://oven.test/"]


def test_text_report(spark):
    w = fv.REPORT_WORDS
    rows = sinks.report_text(*sample(spark)).orderBy("section", "line", "sub").collect()
    blocks = [r["text"] for r in rows if r["query_id"] == "q"]
    assert blocks[0].split("\n")[:3] == [w["query"] + "blue mugs", w["engines"] + "bing, exa", w["elapsed"] + "1012 ms"]
    assert f"d1_url_exact 3→2{w['merged']}1) | d2_judged 2→2{w['merged']}0)" in blocks[0] and blocks[0].endswith("=" * 78)
    assert blocks[1].split("\n")[0] == "[1] https://kiln.test/mug" and w["hit_by"] + "bing / exa  (bing#1, exa#2)" in blocks[1]
    assert blocks[2] == w["alternative"] + "https://kiln.test/mug/  《Blue mugs》  [bing] d1:url_exact,same_url"
    assert blocks[3] == "\n[2] https://oven.test/\n" + w["title"] + "Bowls\n" + w["hit_by"] + "bing  (bing#2)"
    assert blocks[4].split("\n")[2:] == [w["status"], "  bing       FAIL   0 条      3 ms  HTTP 503", "  exa        OK     1 条     12 ms"]
    none = [r["text"] for r in rows if r["query_id"] == "none"]
    assert none[0].endswith("\n" + w["nothing"]) and none[1].startswith("-" * 78) and len(none) == 2


def test_item_log(spark, tmp_path):
    raw = spark.createDataFrame([("q", "text", "exa", 0, 1, "t", "u", "s\nx", "", (0.5, None, None, None, "src", None))], schemas.RAW_HITS)
    logs.write_item_log(raw, str(tmp_path / "log"))
    r = logs.read_item_log(spark, str(tmp_path / "log")).first()
    assert (r["engine"], r["query"], r["rank"], r["snippet"], r["signals"]["source"]) == ("exa", "text", 1, "s\nx", "src")


def test_deeply_nested_page(spark):
    deep = "<article><h1>Mug</h1>" + "<div>" * 5000 + "<p>blue</p>" + "</div>" * 5000 + "<p>red <b>and</b> green</article>"
    bing = "<ol>" + "<span>" * 5000 + '<li class="b_algo"><h2><a href="https://kiln.test/">Kiln</a></h2><p>wares</p></li></ol>'
    df = spark.createDataFrame([("q", 1, deep), ("q", 2, bing), ("q", 3, None)], "query_id string, page bigint, html string")
    assert [(r["page"], r["title"], r["snippet"]) for r in pages.html_rows(df, "page").collect()] == [(1, "Mug", "blue red and green")]
    assert [(r["url"], r["snippet"]) for r in pages.html_rows(df, "bing").collect()] == [("https://kiln.test/", "wares")]
