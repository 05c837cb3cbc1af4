import random

import pytest

from hitmerge import schemas
from hitmerge.operators import dedup, hits
from hitmerge.operators.kept_dedup import KeptDedup
from hitmerge.streaming import rounds

ENGINES = ["bing", "exa", "metaso", "tavily", "quark"]


def rows(seed, n):
    """Raw rows of few pages under many addresses, titles and snippets that nearly agree: chains, so that the order decides."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=14)) for _ in range(4)]
    out = []
    for i in range(n):
        site = rng.choice(["a.example.com", "b.example.com", "other.example.org"])
        text = rng.choice(texts).split()
        text[rng.randrange(14)] = rng.choice(words)
        url = f"https://{site}/{rng.choice(['news', 'shop'])}/{rng.choice(['item', 'page'])}-{rng.choice('abcdefgh')}{rng.choice(['', '?utm_source=x', '#top', '/'])}"
        title = rng.choice(["Common title of pages", "Common title of pages - Site", "Another common title here"])
        out.append((f"q{i % 2}", "x", rng.choice(ENGINES), i, rng.randrange(1, 9), title, url, rng.choice([" ".join(text), texts[0], ""]), None, None))
    return out


def decisions(owners):
    return sorted(map(str, owners.select("query_id", "pos", "owner", "reason").collect()))


@pytest.mark.parametrize("seed", [2])
def test_kept_owners_equal_the_full_walk_for_any_arrival_order(spark, tmp_path, seed):
    raw = rows(seed, 90)
    rng = random.Random(seed)
    rng.shuffle(raw)
    kept = KeptDedup(spark, str(tmp_path), parts=4)
    undone = 0
    for batch, upto in enumerate((60, 75, 90)):
        so_far = spark.createDataFrame(raw[:upto], schemas.RAW_HITS)
        changed = spark.createDataFrame(raw[(0, 60, 75)[batch]:upto], schemas.RAW_HITS).select("query_id", "url").distinct()
        before = {(r["query_id"], r["url"]): r["owner_url"] for r in kept.pool().collect()} if batch else {}
        now = hits.exact_merge(so_far).join(changed, ["query_id", "url"], "left_semi")
        written = kept.add(now, batch).count()
        pool = hits.pool(so_far)
        want = dedup.find_owners(pool)
        assert decisions(kept.owners()) == decisions(want)
        after = {(r["query_id"], r["url"]): r["owner_url"] for r in kept.pool().collect()}
        undone += sum(before[k] is not None and after[k] != before[k] for k in before)
        assert written <= pool.count()
    assert decisions(want) and undone > 0                # a late row did undo owners


def test_only_touched_components_are_written(spark, tmp_path):
    def hit(q, url, engine="bing", i=0, title="Some title of a page"):
        return (q, "x", engine, i, 1, title, url, "a snippet of the page", None, None)

    kept = KeptDedup(spark, str(tmp_path), parts=4)
    first = [hit("q", f"https://www.site{i}.com/a/b?utm_source={k}", i=i) for i in range(6) for k in (1, 2)]
    kept.add(hits.exact_merge(spark.createDataFrame(first, schemas.RAW_HITS)), 0)
    late = [hit("q", "https://www.site3.com/a/b", engine="aaa")]
    for _ in range(2):                                   # a repeated batch changes nothing
        got = {(r["url"], r["owner_url"]) for r in kept.add(hits.exact_merge(spark.createDataFrame(late, schemas.RAW_HITS)), 1).collect()}
        assert got == {("https://www.site3.com/a/b", None), *((f"https://www.site3.com/a/b?utm_source={k}", "https://www.site3.com/a/b") for k in (1, 2))}
    assert kept.owners().count() == 5 + 2


def test_stream_of_hits_into_kept_decisions(spark, tmp_path):
    raw = rows(5, 40)
    path, kept = str(tmp_path / "in"), KeptDedup(spark, str(tmp_path / "kept"), parts=4)
    spark.createDataFrame(raw, schemas.RAW_HITS).selectExpr("*", "timestamp'2024-01-01' as round_start", "timestamp'2024-01-01' as arrived_at") \
        .repartition(2).write.json(path)
    rounds.dedup_stream(rounds.read_rows(spark, path, files_per_batch=1), kept, str(tmp_path / "marks")).awaitTermination()
    assert decisions(kept.owners()) == decisions(dedup.find_owners(hits.pool(spark.createDataFrame(raw, schemas.RAW_HITS))))
