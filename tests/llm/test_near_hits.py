import random

import numpy as np
import pytest

from hitmerge.llm import passages
from hitmerge.llm.near_hits import near_hits
from hitmerge.llm.neighbours import near_vectors
from hitmerge.llm.passages import repeated_passages, without_repeats
from hitmerge.llm.texts import shingle_hashes
from hitmerge.session import cut_lineage

HITS = "hit_ord long, snippet string"


def words(rng, n):
    return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def smallest(ids, linked):
    """Least reachable id, by plain search."""
    out = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(out[a], out[b])
            if (out[a], out[b]) != (low, low):
                out[a] = out[b] = low
                moved = True
    return out


def brute(rows, percent, k):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in smallest(ids, links).items()}


@pytest.mark.parametrize("percent,k", [(80, 5), (85, 4)])
def test_near_hits_against_all_pairs(spark, percent, k):
    rng, rows = random.Random(percent), []
    for size in (1, 2, 4, 5, 6, 7, 9, 12, 17, 25, 40, 90, 200):
        base = words(rng, size)
        for edits in (0, 0, 1, 1, 1, 2, 3, 5):
            w = list(base)
            for _ in range(min(edits, size)):
                w[rng.randrange(size)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    base = words(rng, 60)                                # a group far over the size that meets as pairs
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = f"e{rng.randrange(10 ** 6)}"
        rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = {r[0]: (r[1], r[2]) for r in near_hits(spark.createDataFrame(rows, HITS).repartition(5), percent, k, tile_rows=20).collect()}
    assert got == brute(rows, percent, k)


def test_near_hits_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "one two", "x"), (5, "ONE\ttwo", None), (None, "one two", "x"), (6, "lone", "x"),
            (6, "other text here", "x"), (7, "y " * 50000, "x")]
    got = near_hits(spark.createDataFrame(rows, HITS + ", component_id string")).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in got) == [
        (0, 1, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7)]
    assert near_hits(spark.createDataFrame([], HITS)).collect() == []


def test_near_hits_of_repeated_ids_keep_their_own_texts(spark):
    """Each id also has an unrelated text; large groups go through tiles. Rows are told apart by their texts."""
    for size, count in ((60, 24), (60, 6)):
        rng, base, rows = random.Random(size + count), None, []
        base = words(rng, size)
        for i in range(count):
            w = list(base)
            w[rng.randrange(size)] = f"e{i}"
            rows += [(20 + i, " ".join(w)), (20 + i, " ".join(words(rng, size))), (20 + i, rows[0][1] if rows else " ".join(w))]
        rng.shuffle(rows)
        sets = [shingles(t, 5) for _, t in rows]
        links = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        group = smallest(range(len(rows)), links)
        least = {}
        for n, (i, _) in enumerate(rows):
            least[group[n]] = min(least.get(group[n], i), i)
        want = sorted((i, len(sets[n]), least[group[n]]) for n, (i, _) in enumerate(rows))
        got = near_hits(spark.createDataFrame(rows, HITS).repartition(3), 80, 5, tile_rows=10)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_near_hits_without_ids(spark):
    """Rows without an id link like others; only they can name no component."""
    rng, rows = random.Random(12), []
    base = words(rng, 120)
    for i in range(9):
        w = list(base)
        w[rng.randrange(120)] = f"e{i}"
        rows.append((None if i < 6 else i, " ".join(w)))
    got = near_hits(spark.createDataFrame(rows, HITS)).collect()
    assert {r["component_id"] for r in got} == {6}


def test_near_hits_of_several_pools(spark):
    rng, rows = random.Random(8), []
    base = words(rng, 40)
    for q in ("a", "b", None):
        for i in range(12):
            w = list(base)
            w[rng.randrange(40)] = f"e{rng.randrange(99)}"
            rows.append((q, i + (5 if q == "b" else 0), " ".join(w if i % 3 else words(rng, 40))))
    got = near_hits(spark.createDataFrame(rows, "query_id string, " + HITS), within=("query_id",)).collect()
    for q in ("a", "b", None):
        want = brute([r[1:] for r in rows if r[0] == q], 80, 5)
        assert {r["hit_ord"]: (r["n_shingles"], r["component_id"]) for r in got if r["query_id"] == q} == want


def test_shingles_are_whole_words():
    assert shingle_hashes("A b  c", 2).tolist() == shingle_hashes("a\tB\nC", 2).tolist()
    assert len(shingle_hashes("a b", 5)) == 1 and len(shingle_hashes(None, 5)) == 0
    assert shingle_hashes("a b", 3)[0] != shingle_hashes("a b c", 3)[0]


def test_repeated_passages_word_by_word(spark):
    rng, rows = random.Random(3), []
    shared = words(rng, 70)
    for i in range(30):
        w = words(rng, rng.randrange(20, 300))
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = shared
        if i % 5 == 0:
            w[0:0] = shared[:30]                        # too short
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, rows[0][1].upper().replace(" ", "\n")), (102, None), (103, ""), (None, rows[0][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], HITS + ", start int")
    got = repeated_passages(df).collect()
    assert {r["hit_ord"] for r in got} == {i for i in range(1, 30) if i % 3 == 0} | {100, 101}
    assert all(r["similarity"] >= 0.8 and r["n_words"] >= 50 and r["first_ord"] < r["hit_ord"] for r in got)
    text = dict(rows[:-1])
    for r in got:
        mine = text[r["hit_ord"]].lower().split()[r["start"]:r["start"] + r["n_words"]]
        first = text[r["first_ord"]].lower().split()[r["first_start"]:r["first_start"] + r["first_words"]]
        assert mine == first and (r["hit_ord"] >= 100 or set(shared) <= set(mine))
    left = {r["hit_ord"]: r["snippet"] for r in without_repeats(df, repeated_passages(df)).collect() if r["hit_ord"] is not None}
    assert left[100] == left[101] == "" and left[102] is None and left[1] == text[1] and left[0] == text[0]
    assert left[3].split() == [w for w in text[3].split() if w not in set(shared)]


def test_repeated_passages_nearly(spark):
    rng = random.Random(9)
    base = words(rng, 120)
    near = list(base)
    near[30] = near[90] = "edit"
    rows = [(1, " ".join(words(rng, 40) + base + words(rng, 40))), (2, " ".join(words(rng, 90) + near)), (3, " ".join(words(rng, 200)))]
    got = repeated_passages(spark.createDataFrame(rows, HITS), functions=8).collect()
    assert {(r["hit_ord"], r["first_ord"]) for r in got} == {(2, 1)}
    assert sum(r["n_words"] for r in got) >= 100
    assert repeated_passages(spark.createDataFrame([], HITS)).collect() == []


def test_repeated_passages_of_late_hits_within_a_common_line(spark):
    """All hits have one line; two late ones share a passage that is mostly that line, others nearly so."""
    rng = random.Random(21)
    line = words(rng, 40)
    rows = [(i, " ".join(words(rng, 60) + line + words(rng, 60))) for i in range(60)]
    want = set()
    for n in range(6):
        tail = words(rng, 14 + n)
        other = list(tail)
        if n % 2:
            other[-3] = "edit"                          # near, not word by word
        for i, t in ((100 + n, tail), (200 + n, other)):
            rows.append((i, " ".join(words(rng, 60) + line + t + words(rng, 60))))
        want.add((200 + n, 100 + n))
    got = repeated_passages(spark.createDataFrame(rows, HITS)).collect()
    assert {(r["hit_ord"], r["first_ord"]) for r in got} == want


def test_repeated_passages_by_joins_as_in_one_task(spark):
    """Signatures of many hits: passages within a common line and near copies of each other, compared by joins."""
    rng = random.Random(31)
    line, rows, i = words(rng, 40), [], 0
    for _ in range(30):
        rows.append((i := i + 1, " ".join(words(rng, 50) + line + words(rng, 50))))
    for _ in range(8):
        tail = words(rng, 25)
        for _ in range(4):
            near = list(tail)
            near[rng.randrange(25)] = f"e{rng.randrange(10 ** 6)}"
            rows.append((i := i + 1, " ".join(words(rng, 50) + line + near + words(rng, 50))))
    df = spark.createDataFrame(rows, HITS)
    def covered(got):
        return {(r["hit_ord"], i) for r in got.collect() for i in range(r["start"], r["start"] + r["n_words"])}

    one = covered(repeated_passages(df))
    joined = covered(repeated_passages(df, together=3))     # all that share enough meet there, not the earliest until all is found
    assert one and one <= joined and {i for i, _ in joined} == {i for i, _ in one}


def test_distinct_shingles_of_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, free = rng.integers(0, 12, 30), rng.random(30) < 0.6
        for counts in (free, np.ones(30, bool)):
            want = [len(set(x[i:i + 10][counts[i:i + 10]].tolist())) for i in range(21)]
            assert passages._distinct(x, counts, 10).tolist() == want


def jaccard(a, b, k=5):
    p, q = shingles(" ".join(a), k), shingles(" ".join(b), k)
    return len(p & q) / len(p | q)


def test_recall_of_near_passages_with_the_registered_parameters(spark):
    """Planted passages whose shingles have a Jaccard similarity of 0.80 to 0.95 by count, each in two hits."""
    rng, rows, planted = random.Random(17), [], []
    while len(planted) < 250:
        base = words(rng, rng.choice([50, 60, 80, 120]))
        near = list(base)
        for _ in range(rng.randrange(1, 6)):
            near[rng.randrange(len(near))] = f"e{rng.randrange(10 ** 6)}"
        if 0.8 <= jaccard(base, near) <= 0.95:
            i = 2 * len(planted)
            planted.append(i)
            rows += [(i, " ".join(words(rng, 30) + base + words(rng, 30))), (i + 1, " ".join(words(rng, 40) + near + words(rng, 20)))]
    rows += [(10_000 + i, " ".join(words(rng, 150))) for i in range(100)]
    got = {(r["first_ord"], r["hit_ord"]) for r in repeated_passages(spark.createDataFrame(rows, HITS)).collect()}
    assert got <= {(i, i + 1) for i in planted}
    assert len(got) >= 0.99 * len(planted)


def test_near_vectors_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        label = rng.choice([1, 1, 1, 2])
        if rows and rng.random() < 0.5:
            v = [x + rng.gauss(0, 0.12) for x in rng.choice(rows)[2]]
        else:
            v = [rng.gauss(0, 1) for _ in range(16)]
        rows.append((i, label, v))
    rows += [(400 + i, 1, rows[0][2]) for i in range(40)]

    def cosine(a, b):
        dot = lambda p, q: sum(x * y for x, y in zip(p, q, strict=True))
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    links = [(a[0], b[0]) for n, a in enumerate(rows) for b in rows[n + 1:] if a[1] == b[1] and cosine(a[2], b[2]) >= 0.93]
    least = smallest([r[0] for r in rows], links)
    want = {i: (sum(i in e for e in links), c, c == i) for i, c in least.items()}
    odd = [(900, None, rows[0][2]), (901, 1, None), (902, 1, []), (903, 1, [0.0] * 16), (904, 1, [float("nan")] * 16), (905, 1, [None] + [1.0] * 15),
           (906, 1, rows[0][2][:8]), (907, 1, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumnRenamed("x", "y")
    got = {r[0]: tuple(r[1:]) for r in near_vectors(df, shard_rows=64, beam=8).collect()}
    assert {i: got[i] for i in want} == want
    assert all(got[r[0]] == (0, r[0], True) for r in odd)
    assert near_vectors(df.limit(0)).collect() == []
    one = spark.createDataFrame([(None, 1, [1.0]), (5, 1, [1.0]), (5, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, near_vectors(one).collect()), key=str) == sorted([(None, 0, None, False), (5, 0, 5, True), (5, 0, 5, True)], key=str)


def test_names_of_one_large_group_make_few_edges(spark, monkeypatch):
    """Two groups of names under many keys each, and a key alone: only keys are labelled."""
    from hitmerge.llm import near_hits as module

    rows = [(-1 - 100 * (name % 2) - key, name) for name in range(400) for key in range(60) if key == 0 or (name * 7 + key * 3) % 5]
    rows += [(-999, 900), (-999, 901)]
    given = []
    monkeypatch.setattr(module, "components", lambda e, plain=module.components: (given.append(e.count()), plain(e))[1])
    found = module._clusters(spark.createDataFrame(rows, "u long, v long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["cluster"], set()).add(r["name"])
    assert sorted(map(sorted, groups.values())) == sorted([list(range(0, 400, 2)), list(range(1, 400, 2)), [900, 901]])
    assert len(found) == 402 and given[0] < len(rows) / 50


@pytest.mark.parametrize("table", [passages.TABLE, 0])
def test_sharing_as_a_walk_over_all_pairs(monkeypatch, table):
    """A common line between other words, with changes: the members found, and no test of a pair by itself."""
    monkeypatch.setattr(passages, "TABLE", table)
    monkeypatch.setattr(passages, "EXPANDED", 1000 if not table else passages.EXPANDED)
    monkeypatch.setattr(passages, "_has_run", None)
    rng, length, least = np.random.default_rng(5), 20, 0.8
    line, seqs = rng.integers(0, 1 << 32, 40), []
    for i in range(60):
        mine = line.copy()
        mine[rng.random(40) < (i % 4) * 0.06] = rng.integers(0, 1 << 32)
        seqs.append(np.concatenate((rng.integers(0, 40 + i, 12), mine[i % 7:], rng.integers(0, 1 << 32, 9))).astype(np.uint32))
    hit = np.arange(60) // 2
    full = [np.ones(x.size, bool) for x in seqs]
    need, share = (np.array(x) for x in zip(*(passages._needed(x, f, length, least) for x, f in zip(seqs, full, strict=True)), strict=True))
    want = []
    for x in range(60):
        free, first = full[x].copy(), None
        for y in range(x):
            d, spare = passages._spare(seqs[x], free, length, least)
            first = spare if first is None else first
            held = np.isin(seqs[x], seqs[y])
            run = lambda m: np.convolve(m, np.ones(length, int), "valid")
            good = [((s > 1e-9) & (run(held) >= least * d - 1e-9) & (run(held & f) >= s - 1e-9)).any()
                    for s, f in ((first, full[x]), (spare, free))]
            if hit[x] != hit[y] and all(good) and (found := passages.repeats(seqs[y], seqs[x], length, least)):
                want.append((x, y))
                for lo, hi, *_ in found:
                    free[lo:hi] = False
    got = list(passages.sharing(seqs, hit, [f.copy() for f in full], need, share, length, least))
    assert got == want and len(want) > 30


def test_checkpoints_of_few_rows_are_few_files(spark, monkeypatch):
    """A chain that is labelled in rounds, with far more shuffle partitions than rows need."""
    from hitmerge.operators import components as module
    files = []

    def counted(df, *how):
        out = cut_lineage(df, *how)
        files.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(module, "cut_lineage", counted)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "128")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        edges = spark.range(300).selectExpr("id * 7919 % 301 as u", "(id + 1) * 7919 % 301 as v").repartition(6)
        got = module.components(edges).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 301 and {r["component"] for r in got} == {0}
    assert len(files) > 1 and files[0] <= 16 and max(files[1:]) <= 8


def test_texts_of_a_batch_are_hashed_together(monkeypatch):
    import numpy as np
    import pyarrow as pa
    import xxhash

    from hitmerge.llm import texts

    some = ["A b  c", None, "", " \t", "x" * 31 + " " + "y" * 32 + "\x0bÄ É\x1cZ\x85", "a b c d e", *(" ".join(f"w{i % 7}{j}" for j in range(60)) for i in range(500))]
    h, begin = texts.word_hashes(some)
    words = [(t or "").encode().lower().split() for t in some]
    assert h.tolist() == [xxhash.xxh64_intdigest(w) for t in words for w in t] and np.diff(begin).tolist() == [len(w) for w in words]
    assert all(np.array_equal(a, shingle_hashes(t, 3)) for a, t in zip(texts.shingle_lists(some, 3), some, strict=True))
    # Each text has the windows that it has alone.
    s, text, a, b = passages.windows(*texts.runs_of(h, begin, 3), 20, 4)
    for i, t in enumerate(some[:20]):
        alone = passages.windows(*texts.runs_of(*texts.word_hashes([t]), 3), 20, 4)
        assert sorted(zip(s[text == i], a[text == i], b[text == i])) == sorted(zip(alone[0], alone[2], alone[3]))
    # Calls grow with the bytes of a batch, not with its texts.
    calls = []
    for module in (texts, passages):
        monkeypatch.setattr(module, "mix", lambda x, plain=module.mix: (calls.append(x.size), plain(x))[1])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(some))), pa.array(some)], ["hit_ord", "snippet"])
    assert list(passages._deal(5, 46, 50, 4, 8)([batch])) and len(calls) < 40


def test_texts_are_hashed_a_bounded_number_of_bytes_at_a_time(monkeypatch):
    from hitmerge.llm import texts

    some = ["a b c " * (i % 9) for i in range(200)] + ["w x y z " * 200, None, "", "last one"]
    want = [t.tolist() for t in texts.shingle_lists(some, 3)]
    sizes, hashed = [], texts.word_hashes
    monkeypatch.setattr(texts, "AT_ONCE", 500)
    monkeypatch.setattr(texts, "word_hashes", lambda few: (sizes.append((len(few), sum(len(t or "") for t in few))), hashed(few))[1])
    assert [t.tolist() for t in texts.shingle_lists(some, 3)] == want and texts.shingle_lists([], 3) == []
    assert all(n <= 500 or k == 1 for k, n in sizes) and len(sizes) < 30 and sum(k for k, _ in sizes) == len(some)
