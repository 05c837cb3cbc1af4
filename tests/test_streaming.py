import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from hitmerge import schemas
from hitmerge.operators import hits
from hitmerge.streaming import keyed, rounds

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SIGNALS = dict.fromkeys(schemas.SIGNAL_FIELDS)


def stamp(seconds):
    return (START + timedelta(seconds=seconds)).isoformat()


def landed(rng, n, queries=3):
    """Rows of random engines; few URLs, so that hits meet; texts of equal length, blank URLs and missing ranks too."""
    out = []
    for i in range(n):
        signals = {**SIGNALS, "score": rng.choice([None, 0.0, 0.4, 0.9]), "source": rng.choice([None, "", "s1", "s2"])}
        out.append({"query_id": f"q{rng.randrange(queries)}", "query": "x", "engine": rng.choice(["bing", "exa", "tavily", "Zed"]), "ord": i,
                    "rank": rng.choice([None, 0, rng.randrange(1, 9)]), "title": rng.choice(["", "aa", "bb", "é", "longer"]),
                    "url": rng.choice(["", *(f"https://h{k}.example/p" for k in range(6))]), "snippet": rng.choice(["", "one", "two", "three"]),
                    "date": rng.choice([None, "", "2020", "2021"]), "signals": signals, "round_start": stamp(0), "arrived_at": stamp(i % 50)})
    return out


def drop(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def shown(pool):
    return sorted(map(str, pool.select(*[c.split()[0] for c in schemas.POOL.replace(schemas.SIGNALS, "x").split(", ") if " " in c]).collect()))


@pytest.fixture()
def folders(tmp_path):
    for f in ("in", "asked", "out", "marks"):
        (tmp_path / f).mkdir()
    return tmp_path


def test_pool_of_the_stream_equals_the_batch_pool_after_every_batch(spark, folders):
    rng = random.Random(4)
    rows = landed(rng, 160)
    rng.shuffle(rows)                                   # rows of a list arrive in any order
    seen, changed = [], []
    for i in range(4):
        part = rows[i * 40:(i + 1) * 40]
        seen += part
        drop(folders / "in", f"{i}.json", part)
        # Each round starts the query anew from its checkpoint.
        rounds.merge_stream(rounds.read_rows(spark, str(folders / "in")), str(folders / "out"), str(folders / "marks")).awaitTermination()
        batch = hits.pool(spark.createDataFrame(
            [tuple({**r, "signals": tuple(r["signals"].values())}[c] for c in rounds.RAW_COLUMNS) for r in seen], schemas.RAW_HITS))
        assert shown(rounds.current_pool(spark, str(folders / "out"))) == shown(batch)
        written = spark.read.parquet(str(folders / "out/changes")).where(F.col("batch") == i)
        changed.append(written.count())
        assert written.select("query_id", "url").distinct().count() == changed[-1] <= len({(r["query_id"], r["url"]) for r in part if r["url"]})
    drop(folders / "in", "again.json", rows[:40])       # rows that change nothing write nothing
    rounds.merge_stream(rounds.read_rows(spark, str(folders / "in")), str(folders / "out"), str(folders / "marks")).awaitTermination()
    assert spark.read.parquet(str(folders / "out/changes")).where("batch = 4").count() == 0


def test_sightings_of_an_engine_in_any_order():
    rng = random.Random(8)
    rows = [type("R", (), {**r, **r["signals"], "rank": r["rank"] or r["ord"] + 1}) for r in landed(rng, 8)]
    results = []
    for _ in range(40):
        rng.shuffle(rows)
        entry = None
        for r in rows:
            entry = keyed.add_sighting(entry, r)
        results.append(entry)
    assert all(r == results[0] for r in results)


def answer(query, engine, n, at, start=0):
    return {"query_id": query, "query": "x", "engine": engine, "ord": n, "rank": n + 1, "title": "t", "url": f"https://{engine}/{n}", "snippet": "s", "date": "",
            "signals": None, "round_start": stamp(start), "arrived_at": stamp(at)}


def run_ledger(spark, folders, **more):
    asked = spark.readStream.schema("query_id string, engine string, round_start timestamp").json(str(folders / "asked"))
    rows = rounds.read_rows(spark, str(folders / "in"))
    rounds.ledger_stream(rounds.ledger(rows, asked, **more), str(folders / "out"), str(folders / "marks")).awaitTermination()
    status = {(r["query_id"], r["engine"]): (r["outcome"], r["count"], r["too_late"], r["latency_ms"], r["error"] == "")
              for r in rounds.round_status(spark, str(folders / "out")).collect()}
    assert len(status) == rounds.round_status(spark, str(folders / "out")).count()
    return status, sorted((r["query_id"], r["engine"], r["url"]) for r in rounds.late_rows(spark, str(folders / "out")).collect())


def test_ledger_closes_each_engine_once_at_the_deadline(spark, folders):
    engines = ["bing", "exa", "metaso", "tavily"]
    drop(folders / "asked", "0.json", [{"query_id": "a", "engine": e, "round_start": stamp(0)} for e in [*engines, "bing"]])
    # Out of order: the later row first. exa answers at the deadline itself, metaso a moment after it, tavily never.
    drop(folders / "in", "0.json", [answer("a", "bing", 1, 31), answer("a", "bing", 0, 30), answer("a", "exa", 0, 60), answer("a", "metaso", 0, 60.001)])
    status, late = run_ledger(spark, folders, delay="20 seconds")
    assert status == {} and late == [("a", "metaso", "https://metaso/0")]        # the watermark stands at 40 s
    drop(folders / "in", "1.json", [answer("a", "bing", 2, 41), answer("b", "bing", 0, 90, start=85)])
    status, late = run_ledger(spark, folders, delay="20 seconds")
    want = {("a", "bing"): ("ok", 3, 0, 41000, True), ("a", "exa"): ("ok", 1, 0, 60000, True), ("a", "metaso"): ("late", 0, 1, None, False),
            ("a", "tavily"): ("silent", 0, 0, None, False)}
    assert status == want
    # After closing: late rows are kept apart, no engine gets another row, an engine that nobody asked gets none.
    drop(folders / "in", "2.json", [answer("a", "tavily", 0, 95), answer("a", "bing", 3, 96), answer("a", "exa", 1, 97), answer("c", "exa", 0, 300, start=299)])
    status, late = run_ledger(spark, folders, delay="20 seconds")
    assert status == want
    assert late == [("a", "bing", "https://bing/3"), ("a", "exa", "https://exa/1"), ("a", "metaso", "https://metaso/0"), ("a", "tavily", "https://tavily/0")]


def test_ledger_forgets_closed_parts(spark, folders):
    drop(folders / "asked", "0.json", [{"query_id": "a", "engine": "bing", "round_start": stamp(0)}])
    drop(folders / "in", "0.json", [answer("a", "bing", 0, 5)])
    run_ledger(spark, folders, delay="1 second", forget=100)
    for i, at in ((1, 70), (2, 400), (3, 500)):
        drop(folders / "in", f"{i}.json", [answer("z", "exa", i, at, start=at)])
        status, _ = run_ledger(spark, folders, delay="1 second", forget=100)
    assert status == {("a", "bing"): ("ok", 1, 0, 5000, True)}


def test_rows_wait_for_the_verdict_of_their_host(spark, folders):
    (folders / "verdicts").mkdir()
    rows, verdicts = folders / "in", folders / "verdicts"

    def verdict(host, ok, at):
        return {"host": host, "port": "443", "ok": ok, "tested_at": stamp(at)}

    def run():
        v = spark.readStream.schema("host string, port string, ok boolean, tested_at timestamp").json(str(verdicts))
        out = rounds.with_verdicts(rounds.read_rows(spark, str(rows)), v, delay="10 seconds").select("query_id", "url", "reachable")
        out.writeStream.format("parquet").option("path", str(folders / "out")).option("checkpointLocation", str(folders / "marks")) \
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema("query_id string, url string, reachable boolean").parquet(str(folders / "out")).collect())

    drop(rows, "0.json", [answer("a", "bing", 0, 3), answer("a", "exa", 0, 3), answer("a", "metaso", 0, 4), answer("a", "zzz", 0, 5) | {"url": "no address"},
                          answer("a", "tavily", 0, 4)])
    drop(verdicts, "0.json", [verdict("bing", True, 8), verdict("bing", True, 9), verdict("exa", False, 9)])
    assert run() == [("a", "https://bing/0", True)]
    # A good verdict that is late by its own time does not count; one in time that comes after its row does.
    drop(verdicts, "1.json", [verdict("metaso", True, 61), verdict("tavily", True, 60)])
    assert run() == [("a", "https://bing/0", True), ("a", "https://tavily/0", True)]
    drop(rows, "1.json", [answer("b", "bing", 0, 203, start=200)])
    drop(verdicts, "2.json", [verdict("other", True, 200)])
    run()
    drop(verdicts, "3.json", [verdict("other", True, 201)])
    assert run() == [("a", "https://bing/0", True), ("a", "https://exa/0", False), ("a", "https://metaso/0", False), ("a", "https://tavily/0", True),
                     ("a", "no address", False)]
