import math
import random
import re
from collections import Counter

import numpy as np

from hitmerge.llm import ranking as R

HITS = "hit_ord long, snippet string"
QUERIES = "query_id long, query string"


def terms(text):
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    return Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold)))


def model(hits, queries, top):
    docs = [(o, c) for o, t in hits if (c := terms(t))]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for q, text in queries:
        found = []
        for o, c in docs:
            m = 75 + (25 * sum(c.values()) * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 12 * m))
                    for w, k in terms(text).items() if w in c)
            if s > 0:
                found.append((-s, o is None, o or 0, o))
        out += [(q, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    odds = [1 / (i + 1) for i in range(300)]
    hits = [(i, " ".join(rng.choices(words, odds, k=rng.choice([3, 30, 30, 200])))) for i in range(n)]
    queries = [(i, " ".join(rng.choices(words, odds, k=12) + rng.choices(words, k=4))) for i in range(25)]
    return rng, hits, queries


def test_search_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(R, "SPAN", 16)
    rng, hits, queries = made(4, 700)
    hits += [(1, hits[1][1]), (None, hits[2][1]), (None, None), (800, ""), (801, " .,! "), (802, "ÉTÉ été W1x Ünï W3 漢字-W2"), (803, "w0 " * 600 + "w7")]
    hits += [(900 + i, hits[5][1]) for i in range(40)]
    rng.shuffle(hits)
    queries += [(30, None), (31, ""), (32, "absent"), (33, "w1 W1 w1 w250 été ünï"), (33, "w9"), (None, "w9"), (34, "w0"), (35, "W2-漢字")]
    found = R.index(spark.createDataFrame(hits, HITS).selectExpr("*", "'x' as score", "1 as rank").repartition(3))
    asked = spark.createDataFrame(queries, QUERIES).selectExpr("*", "'x' as hit_ord", "1 as n")
    for top, more in ((20, {}), (3, {"at_once": 5}), (1000, {"bytes_at_once": 200})):
        got = sorted((tuple(r) for r in R.search(found, asked, top, **more).collect()), key=str)
        assert got == sorted(model(hits, queries, top), key=str)


def test_blocks_are_rejected_before_they_are_decoded(monkeypatch):
    _, hits, queries = made(9, 6000)
    counted = [terms(t) for _, t in hits]
    n, total = len(hits), sum(sum(c.values()) for c in counted)
    parts = R.Shard.build([o for o, _ in hits], counted, n, total)
    shard = R.Shard({p: np.asarray(parts[p], kind) for p, kind in R._PARTS.items()}, n, total)
    opened, decode = [], R.Shard.decode
    monkeypatch.setattr(R.Shard, "decode", lambda self, t, live: (opened.append((x := decode(self, t, live))[0].size), x)[1])
    held = 0
    for _, text in queries:
        c = terms(text)
        lists = np.array([int(np.searchsorted(shard.vocabulary, R.xxhash.xxh64_intdigest(w.encode()))) for w in c])
        df = shard.at[shard.first[lists + 1]] - shard.at[shard.first[lists]]
        weights = np.array([R.weight(n, int(k)) * m for k, m in zip(df, c.values(), strict=True)])
        held += int(df.sum())
        doc, score = shard.search(lists, weights, 1)
        reach = int(np.sort(score)[-20])
        opened_all = sum(opened)
        some, again = shard.search(lists, weights, reach)
        want = score >= reach
        assert some.tolist() == doc[want].tolist() and again.tolist() == score[want].tolist()
        del opened[:]
        assert opened_all == int(df.sum())
        shard.search(lists, weights, reach)
        held -= sum(opened)
        del opened[:]
        assert shard.search(lists, weights, int(score.max()) + 1)[0].size == 0
        del opened[:]
    assert held > 0


def test_no_hits_and_no_queries(spark):
    none, one = spark.createDataFrame([], HITS), spark.createDataFrame([(1, "a b")], HITS)
    ask = spark.createDataFrame([(1, "a")], QUERIES)
    assert R.search(R.index(none), ask).collect() == []
    assert R.search(R.index(one), spark.createDataFrame([], QUERIES)).collect() == []
    assert [tuple(r)[:3] for r in R.search(R.index(one), ask).collect()] == [(1, 1, 1)]


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = "Ab, " * 1000 + "x" * 500 + " é" * 300
    want = R.terms(text)
    monkeypatch.setattr(R, "PIECE", 7)
    assert R.terms(text) == want == {b"ab": 1000, b"x" * 500: 1, "é".encode(): 300}
