import base64
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hitmerge.llm import article, fingerprints, language, mixing, packing, tokens, toxicity

HITS = "hit_ord long, snippet string"
given = pytest.importorskip("public_tokenizers")
VOCABULARY = {"vocabulary": given.path("byte_bpe_50k.tiktoken"), "pattern": given.PATTERN, "special": (("<|endoftext|>", 50256),)}
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Ünïcode … 漢字 👩‍👩‍👧 don't I'LL 12345  6\n\n\n x"), (5, "a<|endoftext|>b <|endoftext|>"), (5, "a<|endoftext|>b <|endoftext|>"),
       (None, "no name"), (6, "ab cd " * 40000), (7, "x" * 70000)]


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(given.path("byte_bpe_50k.json"))


def clashing(spark, rows, kind=HITS):
    """The rows with more columns, whose names are those that results have."""
    extra = ("n_tokens", "score", "start", "length", "copies", "chunk", "guest", "print")
    return spark.createDataFrame(rows, kind).select("*", *[F.lit("x").alias(c) for c in extra])


def test_token_counts(spark):
    t = reference()
    got = sorted(map(tuple, tokens.count_tokens(clashing(spark, ODD), **VOCABULARY, piece_chars=1000, batch_bytes=100).collect()), key=str)
    want = sorted(((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ODD), key=str)
    assert got == want
    assert tokens.count_tokens(spark.createDataFrame([], HITS), **VOCABULARY).collect() == []


def test_pieces_do_not_change_tokens():
    t, rng = reference(), random.Random(4)
    enc = tokens.encoder(*VOCABULARY.values())
    parts = ["word", " ", "  ", "\n", "it's", "é", "12", "<|endoftext|>", "…", "'ll", "Ab", " "]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(60))
        assert tokens.encode(text, enc, 7) == t.encode(text, add_special_tokens=False).ids
        assert "".join(tokens.pieces(text, 7)) == text


def test_packing_round_trip(spark):
    t, rng = reference(), random.Random(8)
    rows = [(i, " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(rng.randrange(900)))) for i in range(120)] + ODD
    df = clashing(spark, rows).repartition(3)
    got = packing.pack_hits(df, **VOCABULARY, capacity=256, island_rows=20).toPandas()
    want = {}
    for i, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        first = ids.size % 256 or 256
        cut = [0, *range(first, ids.size + 1, 256)]
        for n, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
            key = (i if i is not None else -1, n, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()))
            want[key] = want.get(key, 0) + 1
    have = {}
    for r in got.itertuples():
        key = (int(r.hit_ord) if r.hit_ord == r.hit_ord else -1, r.piece, r.start, r.length, r.ids_crc32)
        have[key] = have.get(key, 0) + 1
    assert have == want
    for _, held in got.sort_values("offset").groupby("sequence_id"):
        assert held["offset"].tolist() == (held["length"].cumsum() - held["length"]).tolist() and held["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) + 3
    assert packing.pack_hits(spark.createDataFrame([], HITS), **VOCABULARY).collect() == []


def test_evolution_keeps_all_pieces():
    rng = np.random.default_rng(2)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, rng.integers(20, 60, 400), 1)
    least = -(-int((counts * np.arange(101)).sum()) // 100)
    first = packing._best_fit(counts)
    best = packing._evolve(counts, first, [((50, 50), 3)], 1, 4, 10)
    for genes in (first, best):
        held = np.zeros(101, np.int64)
        for seq, n in genes.items():
            assert sum(seq) <= 100
            np.add.at(held, list(seq), n)
        assert (held == counts).all()
    assert least <= sum(best.values()) <= sum(first.values())


def test_language_of_held_out_texts(spark):
    rng = random.Random(5)
    syllables = {"aa": "ba be bi bo bu".split(), "bb": "tra tre tri tro tru".split(), "cc": "élo éla éli élu él".split()}
    say = lambda k: " ".join("".join(rng.choice(syllables[k]) for _ in range(3)) for _ in range(20))
    learn = [(say(k), k) for k in syllables for _ in range(30)] + [(None, "aa"), ("text", None)]
    model = language.fit(spark.createDataFrame(learn, "snippet string, locale string"), sample=60, space=1 << 12)
    assert model.languages == ["aa", "bb", "cc"]
    test = [(i, say(k), k) for i, k in enumerate(list(syllables) * 10)]
    got = {r["hit_ord"]: r for r in language.identify(spark.createDataFrame(test, HITS + ", locale string"), model).collect()}
    assert all(got[i]["locale"] == k and 0.5 <= got[i]["score"] <= 1 for i, _, k in test)
    odd = language.identify(clashing(spark, [(1, None), (2, ""), (3, "12 34 !?"), (None, say("aa")), (4, say("bb")), (4, say("bb") * 500)]), model).collect()
    assert [(r["hit_ord"], r["locale"]) for r in odd] == [(1, "und"), (2, "und"), (3, "und"), (None, "aa"), (4, "bb"), (4, "bb")]
    assert all(r["score"] == 0 and r["ambiguous"] for r in odd[:3])
    mixed = language.identify(spark.createDataFrame([(1, say("aa") + " " + say("bb"))], HITS), model, doubt=0.999).first()
    assert mixed["ambiguous"]
    none = language.fit(spark.createDataFrame([], "snippet string, locale string"))
    assert language.identify(spark.createDataFrame([(1, "text")], HITS), none).first()["locale"] == "und"


def test_language_examples_count_texts_not_copies(spark, monkeypatch):
    rows = [("copied aa", "aa")] * 3000 + [(f"text aa {i}", "aa") for i in range(200)] + [(f"text bb {i}", "bb") for i in range(200)]
    rows += [("foreign " * 500 + "own words " * 1500, "cc")]
    taken, grams = [], language.grams
    monkeypatch.setattr(language, "grams", lambda texts, *a: (taken.extend(texts), grams(texts, *a))[1])
    language.fit(spark.createDataFrame(rows, "snippet string, locale string"), sample=90, space=1 << 12)
    assert [sum(k in x for x in taken) for k in (" aa", " bb")] == [30, 30]
    long = [x for x in taken if "foreign" in x]
    assert len(long) == 1 and len(long[0]) <= 4007 and long[0].count("own words") > 2 * long[0].count("foreign")


def test_codewords_differ():
    for n in range(1, 12):
        code = language.codewords(n, 8)
        assert len({tuple(r) for r in code}) == n
        assert all((a != b).sum() >= 2 for i, a in enumerate(code) for b in code[i + 1:])


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav><header>Site &amp; name</header><div class="cookie-notice">We use cookies</div>
%s
<aside>Other things</aside><div id="comments"><p>A reader says that this is a very long and wordy comment on the article above it, really.</p></div>
<form><label>Mail</label><button>Send</button></form><footer>&copy; 2024 all rights</footer></body></html>"""
LONG = "This paragraph is long enough to be taken for running text of an article by every window that sees it."


def test_article():
    marked = "<article><h1>Head &lt;1&gt;</h1><p>One\n  two<br>three<p>Four <b>five</b><div class=ad>Buy</div><ul><li>x<li>y</ul></article>"
    assert article.article(PAGE % marked) == ["Head <1>", "One two three", "Four five", "x", "y"]
    plain = f"<div class=content><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
    assert article.article(PAGE % plain) == ["Head", LONG, "Short.", LONG]
    assert article.article(None) == article.article("") == article.article("<p> </p>") == []
    assert article.article("<article>" + "<div>" * 6000 + "deep" + "</div>" * 6000) == ["deep"]
    assert article.article("<article>a &#x41;&eacute; &nbsp;b<!-- no --> <![CDATA[c & d]]></article>") == ["a Aé b c & d"]


def test_article_marks_are_only_a_prior():
    text = f"<div class=content><p>{LONG}</p><p>{LONG}</p></div>"
    cards = "<article><h3>Card</h3><p>Short teaser.</p></article>" * 3
    comment = f"<article class=comment><p>{LONG * 3}</p></article>"
    assert article.article(PAGE % (text + comment)) == [LONG, LONG]
    assert article.article(PAGE % (cards + text)) == [LONG, LONG]
    menu = "<ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul>"
    assert article.article(f"<main><h1>Head</h1>{menu}<p>{LONG}</p><p><a href=/c>Source</a></p><p>End.</p>{menu}</main>") == ["Head", LONG, "Source", "End."]


def test_names_do_not_hide_the_text():
    for wrap in ("layout has-sidebar", "no-sidebar", "page with-nav", "content legal", "post share-enabled"):
        for inner in (f"<article><p>{LONG}</p></article>", f"<p>{LONG}</p><p>{LONG}</p>"):
            assert set(article.article(PAGE % f'<div class="{wrap}">{inner}</div>')) == {LONG}, wrap
        if wrap != "content legal":
            assert article.article(PAGE % f'<div class="{wrap}"><p>{LONG}</p></div><div><p>{LONG}</p></div>') == [LONG, LONG], wrap
    lines = f"<p>{LONG}</p><p><a href=/x>Linked line</a></p><p>{LONG}</p><p>The end.</p>"
    assert article.article(PAGE % f"<div>{lines}</div>") == [LONG, "Linked line", LONG, "The end."]
    assert article.article(PAGE % f'<div><p>{LONG}</p></div><div class="share-buttons"><p>Tell all of your friends about it now</p></div>') == [LONG]


def test_main_text(spark):
    rows = [(1, "u", PAGE % "<article><p>One<p>Two</article>", "x"), (2, None, None, "x"), (None, "u", "", None), (1, "u", "<article>again</article>", "x")]
    got = article.main_text(spark.createDataFrame(rows, "page_id long, url string, body string, snippet string")).collect()
    assert [(r["page_id"], r["url"], r["snippet"]) for r in got] == [(1, "u", "One\n\nTwo"), (2, None, ""), (None, "u", ""), (1, "u", "again")]
    assert article.main_text(spark.createDataFrame([], "page_id long, url string, body string")).collect() == []


def water(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, open_ = {}, set(names)
    while True:
        left = sum(sizes.values()) - sum(full.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s] + 1e-9}
        if not above:
            return {**full, **share}
        full.update({s: most * sizes[s] for s in above})
        open_ -= above


def test_targets(spark):
    rng = random.Random(7)
    for _ in range(6):
        sizes = {chr(97 + i): rng.choice([0, 1, 5, 40, 1000, 30000]) for i in range(9)} | {None: 50}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "engine string, engine_size long")).collect()
        want = water(sizes)
        assert all(abs(r["target"] - want[r["engine"]]) < 1e-6 * (1 + want[r["engine"]]) for r in got)


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", "b", "b", "c", None]), "w " * rng.randrange(60)) for i in range(1500)]
    rows += [(5, "a", None), (None, "b", "x y"), (7, "c", "x y"), (7, "c", "x y")]
    df = clashing(spark, rows, "hit_ord long, engine string, snippet string")
    first, again = mixing.mix_engines(df), mixing.mix_engines(df.repartition(7))
    got = first.toPandas()
    assert sorted(map(str, first.collect())) == sorted(map(str, again.collect()))
    assert len(got) == len(rows) and ((got["taken"] == got["copies"] * got["size"]) & (got["copies"] <= 3) & (got["copies"] >= 0)).all()
    for _, part in got.groupby("engine", dropna=False):
        assert part["size"].sum() == part["engine_size"].iloc[0]
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 60
    empty = mixing.mix_engines(spark.createDataFrame([(1, "a", None), (2, "b", "")], "hit_ord long, engine string, snippet string")).collect()
    assert [r["taken"] for r in empty] == [0, 0]
    assert mixing.mix_engines(spark.createDataFrame([], "hit_ord long, engine string, snippet string")).collect() == []


def sketch(text, words=5):
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.split(r"[\x20\x09-\x0d]+", text.lower()) if w]
    out = set()
    for i in range(max(len(h) - words + 1, 1) if h else 0):
        v = 42
        for y in h[i:i + words]:
            v = xxhash.xxh64_intdigest(struct.pack("<Q", y), seed=v)
        out.add(v - (1 << 64) if v >> 63 else v)
    return {x for x in out if x < -(1 << 62)}, min(out, default=None)


def test_fingerprints(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randrange(80)))) for i in rng.sample(range(10 ** 6), 90)]
    rows += [(3, "one é two 漢"), (4, None), (5, ""), (6, "same words here"), (7, "same words here"), (8, "n " * 30000), (None, "last of all")]
    got = {r["hit_ord"]: r for r in fingerprints.fingerprints(clashing(spark, rows).repartition(4), chunk_rows=8).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    alike = lambda a, b: len(a[0] & b[0]) / len(a[0] | b[0]) if a[0] or b[0] else float(a[1] == b[1])
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r, a, b, c = got[i], sketch(text), sketch(edited), sketch(after)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["print"] == sorted(a[0]) and set(r["edited_print"]) == b[0]
        assert abs(r["near_edited"] - alike(a, b)) < 1e-12 and abs(r["near_next"] - alike(a, c)) < 1e-12
    assert fingerprints.fingerprints(spark.createDataFrame([], HITS)).collect() == []
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a b c d e f")], HITS)).first()
    assert one["near_next"] == 1.0


def test_chunks_hold_equal_numbers_of_rows(spark):
    """One id far away, ids in knots, one id of a third of all rows, many without one."""
    ids = [9 * 10 ** 18, -9 * 10 ** 18] + [10 ** k + i for k in (3, 9, 15) for i in range(60)] + [77] * 120 + [None] * 50
    rows = [(i, f"text {n} of all") for n, i in enumerate(ids)]
    kept = fingerprints.with_next(spark.createDataFrame(rows, HITS), chunk_rows=4).collect()
    sizes = Counter(tuple(r["chunk"]) for r in kept if not r["guest"])
    assert max(sizes.values()) <= 16 and len(sizes) > len(rows) / 16 and sum(sizes.values()) == len(rows)
    # The guests and the last of each chunk make one ring through all rows in order.
    chunks = sorted(sizes, reverse=True)
    of = lambda c: sorted((r for r in kept if tuple(r["chunk"]) == c and not r["guest"]), key=lambda r: (r["hit_ord"] is None, -(r["hit_ord"] or 0), r["snippet"]))
    walk = [r["hit_ord"] for c in chunks for r in of(c)]
    assert walk == sorted(ids, key=lambda i: (i is None, -(i or 0)))
    guests = {tuple(r["chunk"]): (r["hit_ord"], r["snippet"]) for r in kept if r["guest"]}
    for n, c in enumerate(chunks):
        head = of(chunks[(n + 1) % len(chunks)])[0]
        assert guests[c] == (head["hit_ord"], head["snippet"])


def test_fingerprint_of_a_union_is_the_union(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, both = (" ".join(words[x:y]) for x, y in ((0, 34), (30, 60), (0, 60)))
    r = spark.range(1).select(*[fingerprints.fingerprint(F.lit(t)) for t in (a, b, both)]).first()
    assert sorted({*r[0], *r[1]}) == r[2]


def test_containment(spark):
    part, whole = fingerprints.fingerprint(F.lit("a b c d e f g h")), fingerprints.fingerprint(F.lit("a b c d e f g h " + " ".join(map(str, range(200)))))
    r = spark.range(1).select(fingerprints.containment(part, whole), fingerprints.containment(whole, part), fingerprints.printable(part)).first()
    assert r[0] == 1.0 and r[1] < 0.3 and re.fullmatch(r"[0-9a-f]{1,16}( [0-9a-f]{1,16})*", r[2])


def judged(n, seed):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        w = ["".join(rng.choice(["ba", "lo", "mi", "re", "tu"]) for _ in range(3)) for _ in range(rng.randrange(20, 80))]
        bad = i % 5 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["zork", "vexxi", "qualp"])
        rows.append((i, " ".join(w)))
        labels.append((i, bad))
    return rows, labels


def test_toxicity_of_held_out_texts(spark):
    rows, labels = judged(400, 1)
    df = spark.createDataFrame(rows, HITS)
    learned = spark.createDataFrame(labels[:300] + [(None, True), (2, None), (10 ** 6, True)], "hit_ord long, bad boolean")
    examples = toxicity.fit(learned, df, each=150)
    got = {r["hit_ord"]: r for r in toxicity.judge(clashing(spark, rows), examples).collect()}
    assert all((got[i]["score"] >= 0.3) == bad for i, bad in labels[300:])
    assert all(0 <= r["score"] <= 1 and len(r["evidence"]) == 9 for r in got.values())
    odd = toxicity.judge(spark.createDataFrame([(1, None), (2, ""), (None, "zork vexxi qualp zork"), (3, "ba " * 50000)], HITS), examples).collect()
    assert [r["score"] >= 0.3 for r in odd] == [False, False, True, False]
    none = toxicity.fit(learned.limit(0), df)
    assert toxicity.judge(df.limit(1), none).first()["score"] == 0
    assert toxicity.judge(df.limit(0), examples).collect() == []


def test_nearest_is_exact(spark):
    rows, labels = judged(500, 3)
    m = toxicity.fit(spark.createDataFrame(labels, "hit_ord long, bad boolean"), spark.createDataFrame(rows, HITS), each=300)
    full = np.zeros((m.bad.size, m.idf.size + 1))
    for p in range(m.bad.size):
        b, e = divmod(p, toxicity.BLOCK)
        full[p, :-1], full[p, -1] = m.weight[b, :, e], m.base[b, e]
    for _, text in judged(60, 4)[0]:
        index, _ = language.grams([text], m.sizes, toxicity.SPACE)
        term, w, common = m.vector(index)
        q = np.zeros(m.idf.size + 1)
        q[term], q[-1] = w, common
        _, cosine = m.nearest(term, w, common)
        assert np.allclose(np.sort(cosine)[::-1], np.sort(full @ q)[::-1][:m.near], atol=1e-6)


def test_rank_file_is_the_vocabulary():
    t = reference()
    with open(VOCABULARY["vocabulary"], "rb") as lines:
        assert sum(1 for line in lines if base64.b64decode(line.split()[0])) == t.get_vocab_size() - 1


def test_markup_inside_markup_is_none():
    text = f"<p>{LONG}</p><p>Second.</p>"
    for inside in ("<!-- <script> off -->", "<!-- <article> -->", '<div data-x="<style>"></div>', "<a title='a > b' data-y=\"it's\"></a>", "<script>if (a<b) '<!--'</script>",
                   "<!-->", "<![CDATA[]]>", "<?x y?>", '<i data-class="ad" title="class=ad"></i>', "<textarea></p></textarea>"):
        assert article.article(f"<article>{inside}{text}</article>") == [LONG, "Second."], inside
    assert article.article(f"<html><head><title>T</title><meta charset=x><body><div>{text}</div>") == [LONG, "Second."]     # head not closed
    assert article.article(f'<article><p>{LONG}<a href="x>y</a></p><p>Second.</p></article>') == [LONG + "y", "Second."]    # quote not closed


def test_wrapped_pages_and_short_ends():
    ends = f"<p>Hi.</p><p>By X</p><p>{LONG}</p><p>{LONG}</p><p>ok.</p><p>fine.</p><p>end.</p>"
    want = ["Hi.", "By X", LONG, LONG, "ok.", "fine.", "end."]
    for page in (f"<div>{ends}</div>", f"<form id=aspnet>{PAGE % f'<div>{ends}</div>'}</form>", PAGE % f"<article>{ends}</article>"):
        assert article.article(page) == want
    assert article.article(PAGE % f"<article><header><h1>Head</h1><p>Lead</p></header><p>{LONG}</p><form><p>Your mail</p></form></article>") == ["Head", "Lead", LONG]


@pytest.mark.parametrize("broken", ["<a ", "<a href=\"", "<a b=\">\" ", "<!--", "<b>", "</i><b>", "<b><p></p>", "<p>x<div>", "<script>", "<div class=ad>x", "<![CDATA[", "< <", "&amp <a>",
                                    "<a b='", "<p a = = \"", "<option>x", "<li><b>x", "<a          "])
def test_broken_pages_take_time_by_length(broken):
    page = f"<article><p>{LONG}</p>" + broken * (1_000_000 // len(broken))
    began = time.process_time()
    assert article.article(page)[:1] in ([LONG], [LONG + " " + broken.strip()]) or broken in ("< <", "&amp <a>")
    assert time.process_time() - began < 10
