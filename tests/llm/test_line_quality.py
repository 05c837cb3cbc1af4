import itertools
import math
import random

import numpy as np
import pytest

from hitmerge.llm import line_quality as Q

HITS = "hit_ord long, snippet string"
JUDGED = "hit_ord long, bad boolean"


def a_field(seed):
    rng = np.random.default_rng(seed)
    cuts = [np.arange(Q.BINS - 1, dtype=np.float32) / 2 for _ in Q.VALUES]
    return Q.Field(cuts, rng.normal(0, 0.5, (3, len(Q.VALUES), Q.BINS + 1)), rng.normal(0, 1, (2, 2)))


def test_marginals_against_all_labelings():
    field, rng = a_field(1), np.random.default_rng(2)
    sizes = [1, 4, 2, 7, 1, 3]
    start = np.cumsum(sizes) - sizes
    e = rng.normal(0, 2, sum(sizes))
    logit, _, _ = field.marginals(e, start)
    for s, n in zip(start, sizes, strict=True):
        mass, bad = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e[s + i] * y[i] for i in range(n)) + sum(field.link[a][b] for a, b in zip(y, y[1:], strict=False)))
            mass += w
            bad += w * np.array(y)
        assert np.allclose(1 / (1 + np.exp(-logit[s:s + n])), bad / mass)


def test_training_climbs_the_likelihood_of_all_labelings():
    rng = np.random.default_rng(3)
    sizes = [1, 3, 5, 2, 4]
    start = np.cumsum(sizes) - sizes
    bins = rng.integers(0, Q.BINS, (sum(sizes), len(Q.VALUES))).astype(np.uint8)
    y = rng.integers(0, 2, sum(sizes)).astype(float)

    def likelihood(field):
        e, total = field.emission(field.around(bins, start)), 0.0
        for s, n in zip(start, sizes, strict=True):
            def score(z, s=s, n=n):
                return sum(e[s + i] * z[i] for i in range(n)) + sum(field.link[int(a)][int(b)] for a, b in zip(z, z[1:], strict=False))
            total += score(y[s:s + n]) - math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=n)))
        return total

    field = a_field(4)
    field.weight[:], field.link[:] = 0, 0
    steps = [likelihood(field)]
    for _ in range(4):
        Q._train(field, field.around(bins, start), start, y, np.ones(y.size), 5, 0.0)
        steps.append(likelihood(field))
    assert steps == sorted(steps) and steps[-1] > 0.5 * steps[0]


def test_values_of_lines_against_plain_python(monkeypatch):
    texts = ["The the cat!! sat| on 12 mats.\n\n  THE END\t#1\nThe the cat!! sat| on 12 mats.", "", None, "\n", "é é É x\n" * 3, "a" * 50 + " b"]
    want, counts = [], []
    for t in texts:
        lines = (t or "").encode().split(b"\n")
        if len(lines) > 1 and not lines[-1]:
            lines = lines[:-1]
        counts.append(len(lines))
        for i, line in enumerate(lines):
            words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in line.split()]
            n = max(sum(map(len, words)), 1)
            same = sum(x.split() == line.split() and x.strip() == line.strip() for x in lines)
            low = sum(97 <= c <= 122 for c in line)
            up = sum(65 <= c <= 90 for c in line)
            want.append((len(words), n / max(len(words), 1), up / max(up + low, 1), line.count(b"|") / n, line.count(b"!") / n, sum(c > 127 for c in line) / n,
                         sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(len(words), 1), len(set(words)) / max(len(words), 1), same,
                         i > 0 and lines[i - 1].strip() == line.strip()))
    for segment in (1 << 20, 20, 1):
        monkeypatch.setattr(Q, "SEGMENT", segment)
        v, size, start = Q.describe(texts)
        assert np.diff(np.append(start, size.size)).tolist() == counts
        got = np.stack((np.expm1(v[:, 1]), v[:, 2], v[:, 3], v[:, 5], v[:, 6], v[:, 9], v[:, 10], v[:, 11], np.expm1(v[:, 15]), v[:, 16]), 1)
        assert np.allclose(got, np.array(want, float), atol=1e-5)


def made(rng, bad):
    words = "lorem ipsum dolor sit amet elit sed do eiusmod tempor".split()
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(4, 15))).capitalize() + "."
    lines = [line() for _ in range(rng.randrange(1, 9))]
    if bad:
        wreck = rng.choice([str.upper, lambda x: x.replace(" ", "$$$ "), lambda x: (x.split()[0] + " ") * 9, lambda x: x.replace(" ", " | ")])
        lines = [x if i == 0 and len(lines) > 2 else wreck(x) for i, x in enumerate(lines)]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(6)
    rows = [(i, made(rng, i % 3 == 0), i % 3 == 0) for i in range(400)] + [(900, None, True), (901, "", None), (None, "x", True)]
    df = spark.createDataFrame(rows, HITS + ", bad boolean")
    return Q.fit(df.select("hit_ord", "bad"), df.drop("bad"), each=100, chars=2000), rng


def test_held_out_texts(spark, fitted):
    field, rng = fitted
    rows = [(i, made(rng, i % 3 == 0)) for i in range(300)]
    got = {r["hit_ord"]: r for r in Q.judge(spark.createDataFrame(rows, HITS), field).collect()}
    right = sum((got[i]["score"] >= 0.5) == (i % 3 != 0) for i, _ in rows)
    assert right >= 0.97 * len(rows)
    # The clean first line of a bad text is told from the others.
    mixed = [r for i, r in got.items() if i % 3 == 0 and r["n_lines"] > 4]
    assert sum(0 < r["bad_lines"] < r["n_lines"] for r in mixed) > 0.5 * len(mixed)


def test_odd_rows(spark, fitted):
    field, rng = fitted
    odd = [(1, None), (2, ""), (3, " \n\t\n"), (None, "no name."), (4, "one."), (4, "one."), (5, "x " * 400_000), (6, "Short line here.\n" * 60_000)]
    df = spark.createDataFrame(odd, HITS).selectExpr("*", "'x' as score", "'y' as n_lines")
    got = Q.judge(df, field).collect()
    assert sorted(str(r["hit_ord"]) for r in got) == sorted(str(i) for i, _ in odd)
    assert all(0 <= r["score"] <= 1 and r["n_lines"] >= 1 for r in got)
    assert len({r["score"] for r in got if r["hit_ord"] == 4}) == len({r["score"] for r in got if r["hit_ord"] in (1, 2)}) == 1
    assert {r["hit_ord"]: r["n_lines"] for r in got}[6] == 60_000
    none = Q.fit(spark.createDataFrame([], JUDGED), df)
    assert {r["score"] for r in Q.judge(df, none).collect()} == {0.5}
    one = Q.fit(spark.createDataFrame([(4, True)], JUDGED), df)
    assert Q.judge(df, one).count() == len(odd) and Q.judge(df.limit(0), field).collect() == []
