"""Quality of hits from their lines: a linear-chain conditional random field labels every line good or bad.

A line is described by the shares of its characters and words, by what it repeats, and by the same of the lines before
and after it; each value falls into a few bins, and every bin has a weight. Neighbouring labels have weights too. Judged
hits are known as wholes only, so at first every line has the label of its hit, and weights of its own values are fitted;
lines of bad hits that look good by these are then called good, as long as half of the hit's length stays bad, and the
whole field is fitted to these labels. The
score of a hit is the mean of its lines' forward-backward marginals, weighted by length and calibrated on the examples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.llm.texts import small

SEGMENT = 1 << 20       # bytes whose lines are described at a time
LINE = 1 << 16          # a longer line counts as several
BINS = 8                # of a value; one more for a neighbour that is not there
PIECES = 8              # of a long text that is fitted on

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _BANG, _PIPE, _SYMBOL, _OTHER = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _OTHER
for _chars, _k in ((".,;:?'\"-()", _STOP), ("!", _BANG), ("|", _PIPE)):
    _CLASS[[ord(c) for c in _chars]] = _k
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []
VALUES = ("length", "words", "word length", "capitals", "symbols", "pipes", "bangs", "digits", "stops", "beyond ASCII", "word repeated",
          "words that differ", "glued symbols", "end", "begin", "in the hit", "as the line before")

SHARES, MARKS = range(3, 13), (13, 14, 16)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or _POWERS[0].size < n:
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, 2 * SEGMENT), b)))) for b in (_BASE, _INVERSE)]
    return _POWERS


def _lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text, and where its lines begin; a text without characters is one empty line."""
    b = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    start = np.concatenate(([0], np.flatnonzero(b == 10) + 1))
    size = np.diff(np.append(start, b.size))
    if size.size and size.max() > LINE:
        start = np.concatenate([np.arange(s, s + max(n, 1), LINE) for s, n in zip(start, size, strict=True)])
    if start.size > 1 and start[-1] == b.size:
        start = start[:-1]
    return b, start


def _shares(b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of consecutive lines but those that need other lines, and a hash of each line without the space around it."""
    n = start.size
    stop = np.append(start[1:], b.size)
    out = np.zeros((n, len(VALUES)), np.float32)
    if not b.size:
        return out, np.zeros(n, np.uint64)
    kind = _CLASS[b]
    line = np.repeat(np.arange(n), stop - start)
    held = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9)
    solid = kind != _SPACE
    first = np.zeros(b.size, bool)
    first[start[start < b.size]] = True
    begin = np.flatnonzero(solid & (first | np.concatenate(([True], ~solid[:-1]))))
    ends = np.ones(b.size, bool)
    ends[:-1] = ~solid[1:] | first[1:]
    end = np.flatnonzero(solid & ends) + 1
    power, inverse = _powers(b.size + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(np.where(kind == _UPPER, b + 32, b).astype(np.uint64) * power[:b.size])))
    word, of = (total[end] - total[begin]) * inverse[begin], line[begin]
    words = np.bincount(of, minlength=n)
    again = np.bincount(of[1:][(word[1:] == word[:-1]) & (of[1:] == of[:-1])], minlength=n)
    order = np.lexsort((word, of))
    w, o = word[order], of[order]
    differ = np.bincount(o[np.concatenate(([True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])))[:o.size]], minlength=n)
    glued = np.bincount(of[np.isin(kind[end - 1], (_SYMBOL, _BANG)) & (end - begin > 1)], minlength=n)
    full = np.maximum(b.size and held[:, 1:].sum(1), 1)
    lo, hi = np.full(n, -1), np.full(n, -1)
    lo[of[::-1]] = begin[::-1]
    hi[of] = end
    there = lo >= 0
    out[:, 0] = np.log1p(stop - start)
    out[:, 1] = np.log1p(words)
    out[:, 2] = full / np.maximum(words, 1)
    out[:, 3] = held[:, _UPPER] / np.maximum(held[:, _UPPER] + held[:, _LOWER], 1)
    for i, k in ((4, _SYMBOL), (5, _PIPE), (6, _BANG), (7, _DIGIT), (8, _STOP), (9, _OTHER)):
        out[:, i] = held[:, k] / full
    some = np.maximum(words, 1)
    out[:, 10], out[:, 11], out[:, 12] = again / some, differ / some, glued / some
    last = np.where(there, b[np.maximum(hi - 1, 0)], 0)
    out[:, 13] = np.where(there, 1 + np.isin(last, (46, 63)) + 2 * (last == 33) + 3 * (last == 124), 0)
    out[:, 14] = np.where(there, 1 + kind[np.maximum(lo, 0)].clip(_LOWER, _STOP), 0)
    hashed = np.zeros(n, np.uint64)
    hashed[there] = (total[hi[there]] - total[lo[there]]) * inverse[lo[there]]
    return out, hashed


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of all lines of the texts, their lengths in bytes, and where each text's lines begin.

    Each text's lines are described a segment at a time, so a text of any size takes little more than its own bytes."""
    values, hashes, sizes, count = [], [], [], []
    held, starts, at = [], [], 0

    def flush():
        nonlocal at
        if starts:
            v, h = _shares(np.concatenate(held), np.concatenate(starts))
            values.append(v)
            hashes.append(h)
            held.clear()
            starts.clear()
        at = 0

    for t in texts:
        b, start = _lines(t)
        stop = np.append(start[1:], b.size)
        sizes.append(stop - start)
        count.append(start.size)
        lo = 0
        while lo < start.size:
            hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + SEGMENT - at, "right")))
            part = b[start[lo]:stop[hi - 1]]
            held.append(part)
            starts.append(start[lo:hi] - start[lo] + at)
            at += part.size
            lo = hi
            if at >= SEGMENT or lo < start.size:
                flush()
    flush()
    if not texts:
        return np.zeros((0, len(VALUES)), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    v, h, n = np.concatenate(values), np.concatenate(hashes), np.array(count)
    of = np.repeat(np.arange(n.size), n)
    order = np.lexsort((h, of))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])))
    group = np.cumsum(new) - 1
    v[order, 15] = np.log1p(np.bincount(group)[group])
    v[1:, 16] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    return v, np.concatenate(sizes), np.cumsum(n) - n


def _steps(start: np.ndarray, n: int):
    """Texts by falling number of lines, and how many of them have a line t."""
    size = np.diff(np.append(start, n))
    order = np.argsort(-size, kind="stable")
    size = size[order]
    return order, np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if size.size else 1), "right")


@dataclass
class Field:
    """Weights of a fitted field; of fixed size."""

    cuts: list              # of each value
    weight: np.ndarray      # own, before, after x value x bin: for bad
    link: np.ndarray        # label of a line x label of the next; good, bad
    curve: tuple = (1.0, 0.0)

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, values[:, i]) for i, c in enumerate(self.cuts)], 1).astype(np.uint8)

    @staticmethod
    def around(bins: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Bins of each line, of the line before and of the line after it; the last bin where there is none."""
        before, after = np.full_like(bins, BINS), np.full_like(bins, BINS)
        before[1:], after[:-1] = bins[:-1], bins[1:]
        before[start] = BINS
        after[start[1:] - 1] = BINS
        return np.stack((bins, before, after), 1)

    def emission(self, around: np.ndarray) -> np.ndarray:
        n = len(self.cuts)
        out = np.zeros(around.shape[0])
        for k in range(3):
            for i in range(n):
                out += self.weight[k, i][around[:, k, i]]
        return out

    def marginals(self, e: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logit that a line is bad, from all lines of its text; and its parts, from the lines up to it and from those after it."""
        (gg, gb), (bg, bb) = self.link
        ahead, behind = e.copy(), np.zeros(e.size)
        order, have = _steps(start, e.size)
        at = start[order]
        for t in range(1, have.size):
            i = at[:have[t]] + t
            x = ahead[i - 1]
            ahead[i] = e[i] + np.logaddexp(gb, x + bb) - np.logaddexp(gg, x + bg)
        for t in range(have.size - 1, 0, -1):
            i = at[:have[t]] + t
            x = e[i] + behind[i]
            behind[i - 1] = np.logaddexp(bg, bb + x) - np.logaddexp(gg, gb + x)
        return ahead + behind, ahead, behind

    def bad_lines(self, values: np.ndarray, start: np.ndarray) -> np.ndarray:
        e = self.emission(self.around(self.bins(values), start))
        return 1 / (1 + np.exp(-self.marginals(e, start)[0].clip(-30, 30)))

    def good_share(self, texts: list[str | None]) -> np.ndarray:
        """Mean of the lines' chances to be good, weighted by length."""
        values, size, start = describe(texts)
        if not start.size:
            return np.zeros(0)
        size = size + 1.0
        return np.add.reduceat((1 - self.bad_lines(values, start)) * size, start) / np.add.reduceat(size, start)

    def score(self, texts: list[str | None]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * _logit(self.good_share(texts)) + b).clip(-30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _cuts(i: int, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Upper ends of the bins of a value: steps of a share, kinds of a mark, else equal parts of the examples."""
    if i in SHARES:
        return np.array([0, 0.03, 0.08, 0.15, 0.3, 0.5, 0.8], np.float32)
    if i in MARKS:
        return np.arange(BINS - 1, dtype=np.float32)
    order = np.argsort(value)
    part = np.cumsum(weight[order]) / weight.sum()
    return np.unique(value[order][np.searchsorted(part, np.arange(1, BINS) / BINS)])


def _train(field: Field, around: np.ndarray, start: np.ndarray, bad: np.ndarray, weight: np.ndarray, rounds: int, ridge: float,
           alone: bool = False) -> None:
    """Likelihood of the lines' labels climbed by Adam steps over all examples; ``alone``: from each line's own values only."""
    n = around.shape[0]
    first = np.zeros(n, bool)
    first[start] = True
    later = np.flatnonzero(~first)
    flat = [around[:, k, i].astype(np.int64) for k in range(3) for i in range(len(field.cuts))]
    moment = [np.zeros_like(field.weight), np.zeros_like(field.weight), np.zeros((2, 2)), np.zeros((2, 2))]
    told = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            told[i, j] = (weight[later] * ((bad[later - 1] == i) & (bad[later] == j))).sum()
    for step in range(1, rounds + 1):
        e = field.emission(around)
        logit, ahead, behind = field.marginals(e, start)
        miss = weight * (bad - 1 / (1 + np.exp(-logit.clip(-30, 30))))
        slope = np.stack([np.bincount(f, miss, BINS + 1) for f in flat]).reshape(field.weight.shape) / weight.sum() - ridge * field.weight
        two = np.stack([i * ahead[later - 1] + field.link[i, j] + j * (e[later] + behind[later]) for i in (0, 1) for j in (0, 1)])
        two = np.exp(two - two.max(0))
        two = (two / two.sum(0) * weight[later]).sum(1).reshape(2, 2)
        tie = (told - two) / weight.sum() - ridge * field.link
        if alone:
            slope[1:], tie[:] = 0, 0
        for x, g, m, v in ((field.weight, slope, 0, 1), (field.link, tie, 2, 3)):
            moment[m] = 0.9 * moment[m] + 0.1 * g
            moment[v] = 0.99 * moment[v] + 0.01 * g * g
            x += 0.15 * (moment[m] / (1 - 0.9 ** step)) / (np.sqrt(moment[v] / (1 - 0.99 ** step)) + 1e-6)


def _calibrated(share: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the logit of the share of good lines."""
    x, a, b = _logit(share), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b).clip(-30, 30)))
        g = np.array([(weight * (good - p) * x).sum() - 0.5 * (a - 1), (weight * (good - p)).sum() - 0.05 * b])
        s = weight * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 0.5, (s * x).sum()], [(s * x).sum(), s.sum() + 0.05]])
        a, b = np.array([a, b]) + np.linalg.solve(h, g)
        a = max(a, 0.05)
    return float(a), float(b)


def fit(judged: DataFrame, hits: DataFrame, each: int = 1000, chars: int = 16000, rounds: int = 80, ridge: float = 1e-4) -> Field:
    """Field of a bounded sample of judged hits.

    :param judged: ``hit_ord``, ``bad`` (boolean); rows without either are left out, a hit that is judged both ways is bad
    :param hits: ``hit_ord``, ``snippet``
    :param each: examples of each label, at most, picked by a hash of ``hit_ord``
    :param chars: characters of an example that are fitted on, at most (but for line breaks between pieces); of a longer
        text, pieces from evenly spread places
    :param rounds: steps of the climb; half as many before the lines have labels of their own
    :param ridge: pull of every weight to 0
    """
    j = judged.where("hit_ord is not null and bad is not null").groupBy(F.col("hit_ord").cast("long").alias("hit_ord")).agg(F.max("bad").alias("bad"))
    share = {r["bad"]: r["n"] for r in j.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = None
    for label in (True, False):
        some = j.where(F.col("bad") == label).orderBy(F.xxhash64("hit_ord"), "hit_ord").limit(each)
        pick = some if pick is None else pick.unionByName(some)
    piece, last = chars // PIECES, F.char_length("snippet") - chars // PIECES
    spread = [F.substring("snippet", F.floor(last * i / (PIECES - 1)).cast("int") + 1, F.lit(piece)) for i in range(PIECES)]
    text = F.when(F.char_length("snippet") > chars, F.concat_ws("\n", *spread)).otherwise(F.coalesce("snippet", F.lit("")))
    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), text.alias("snippet")).join(F.broadcast(pick), "hit_ord").toPandas()
    rows = rows.sort_values(["hit_ord", "snippet"]).drop_duplicates("hit_ord").reset_index(drop=True)
    field = Field([np.zeros(0)] * len(VALUES), np.zeros((3, len(VALUES), BINS + 1)), np.zeros((2, 2)))
    if rows.empty:
        return field
    bad = rows["bad"].to_numpy(bool)
    values, size, start = describe(rows["snippet"].tolist())
    of = np.repeat(np.arange(len(rows)), np.diff(np.append(start, size.size)))
    # Each example counts alike, whatever the number of its lines, which count by length.
    length = size + 1.0
    weight = length / np.bincount(of, length)[of] / np.bincount(bad)[bad.astype(int)][of]
    weight *= len(rows) / weight.sum()
    field.cuts = [_cuts(i, values[:, i], weight) for i in range(len(VALUES))]
    around = field.around(field.bins(values), start)
    line = bad[of].astype(float)
    _train(field, around, start, line, weight, rounds // 2, ridge, alone=True)
    good = (line == 1) & (field.emission(around) < 0)
    lost = np.bincount(of, length * good) / np.bincount(of, length) > 0.5
    line[good & ~lost[of]] = 0
    _train(field, around, start, line, weight, rounds, ridge)
    shares = field.good_share(rows["snippet"].tolist())
    # The sample has other shares of the labels than all judged hits have.
    true = np.where(bad, share.get(True, 0) / max(bad.sum(), 1), share.get(False, 0) / max((~bad).sum(), 1))
    field.curve = _calibrated(shares, (~bad).astype(float), true * len(rows) / true.sum())
    return field


def judge(hits: DataFrame, field: Field) -> DataFrame:
    """Quality of every whole snippet.

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names
    :param field: from ``fit``
    :return: one row per row of ``hits`` with ``hit_ord``, ``score`` (0 to 1, higher: good likelier), ``n_lines`` and ``bad_lines`` (those
        that are rather bad). Lines end at line breaks; one of more than ``LINE`` bytes counts as several. A null or empty snippet
        is one empty line. A field without examples scores every text 0.5.
    """
    shared = hits.sparkSession.sparkContext.broadcast(field)        # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        a, c = f.curve
        for b in small(batches):
            values, size, start = describe(b.column("snippet").to_pylist())
            bad = f.bad_lines(values, start) if start.size else np.zeros(0)
            count = np.diff(np.append(start, size.size))
            w = size + 1.0
            share = np.add.reduceat((1 - bad) * w, start) / np.add.reduceat(w, start) if start.size else np.zeros(0)
            score = 1 / (1 + np.exp(-(a * _logit(share) + c).clip(-30, 30)))
            rather = np.add.reduceat((bad > 0.5).astype(np.int64), start) if start.size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("hit_ord"), pa.array(score), pa.array(count.astype(np.int64)), pa.array(rather)],
                                             ["hit_ord", "score", "n_lines", "bad_lines"])

    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), "snippet")
    return rows.mapInArrow(run, "hit_ord long, score double, n_lines long, bad_lines long")
