"""Bad hits by their nearest judged examples, with exact TF-IDF cosines and a block-max index.

Terms are hashed byte n-grams that judged bad texts have more often than others; every text also has one
common term, so a text without telling terms lies close to the plain examples. Examples stand in blocks by
label and length of vector. The index keeps, for each term and block, the largest weight; their sum
bounds every cosine in a block, so blocks are scored from the highest bound down until no further
block can hold a nearer example. The votes of the nearest, weighted by distance, are calibrated on the
examples themselves, each left out of its own vote."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.llm.language import grams

BLOCK = 64
SPACE = 1 << 20


def _counts(texts: list[str], sizes: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    index, start = grams(texts, sizes, SPACE)
    return [np.unique(x, return_counts=True) for x in np.split(index, start[1:])] if texts else []


@dataclass
class Examples:
    """Judged examples and their index; bounded by their number times the number of terms."""

    sizes: tuple
    term: np.ndarray            # hash -> term or -1
    idf: np.ndarray
    common: float               # weight of the common term
    weight: np.ndarray          # block x term x example of the block, of unit vectors
    top: np.ndarray             # term x block: largest weight
    base: np.ndarray            # block x example: share of the common term
    bad: np.ndarray
    key: np.ndarray
    near: int
    curve: tuple = ((0.0, 1.0), (0.0, 1.0))

    def vector(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Terms of a text, their weights, and the weight of its common term; of length 1."""
        t = self.term[index]
        term, n = np.unique(t[t >= 0], return_counts=True)
        w = (1 + np.log(n)) * self.idf[term]
        length = np.sqrt((w * w).sum() + self.common ** 2)
        return term, w / length, self.common / length

    def nearest(self, term, w, common, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``near`` examples of largest cosine, exactly; ties by place."""
        bound = w @ self.top[term] + common * self.base.max(1)
        order = np.argsort(-bound, kind="stable")
        score, place, done, step = np.empty(0), np.empty(0, np.int64), 0, 3
        while done < order.size:
            if place.size >= self.near and np.partition(score, -self.near)[-self.near] > bound[order[done]] + 1e-9:
                break
            b = order[done:done + step]
            s = np.einsum("t,bte->be", w, self.weight[b[:, None], term]) + common * self.base[b]
            p = b[:, None] * BLOCK + np.arange(BLOCK)
            ok = (p < self.bad.size) & (p != leave)
            score, place, done = np.concatenate((score, s[ok])), np.concatenate((place, p[ok])), done + step
        best = np.lexsort((place, -np.round(score, 9)))[:self.near]
        return place[best], score[best]

    def vote(self, place: np.ndarray, score: np.ndarray) -> float:
        if place.size == 0:
            return 0.0
        w = 1 / (1.05 - np.minimum(score, 1.0))
        return float((w * self.bad[place]).sum() / w.sum())

    def calibrated(self, vote):
        return np.interp(vote, *self.curve)


def _curve(vote: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> tuple:
    """Share of bad texts by vote, made to rise with it, and drawn a little to 1/2 where few were seen."""
    cut = np.linspace(0, 1, 11)
    at = np.clip(np.digitize(vote, cut[1:-1]), 0, 9)
    seen, hit = np.bincount(at, weight, 10), np.bincount(at, weight * bad, 10)
    mid = (cut[1:] + cut[:-1]) / 2
    pools = [[m, s + 0.5, h + 0.5 * m] for m, s, h in zip(mid, seen, hit, strict=True)]
    out: list = []
    for m, s, h in pools:
        out.append([[m], s, h])
        while len(out) > 1 and out[-2][2] / out[-2][1] > out[-1][2] / out[-1][1]:
            ms, s2, h2 = out.pop()
            out[-1] = [out[-1][0] + ms, out[-1][1] + s2, out[-1][2] + h2]
    x = [m for ms, _, _ in out for m in ms]
    y = [h / s for ms, s, h in out for _ in ms]
    return np.array([0.0, *x, 1.0]), np.array([y[0], *y, y[-1]])


def fit(judged: DataFrame, hits: DataFrame, each: int = 1024, terms: int = 1000, sizes: tuple = (3, 4, 5), near: int = 9,
        common: float = 3.0, least: float = 8.0) -> Examples:
    """Examples of a bounded sample of judged hits.

    :param judged: ``hit_ord``, ``bad`` (boolean); rows without either are left out, a hit that is judged both ways is bad
    :param hits: ``hit_ord``, ``snippet``
    :param each: examples of each label, at most, picked by a hash of ``hit_ord``
    :param terms: telling terms, at most
    :param sizes: bytes of the n-grams
    :param near: voting examples
    :param common: weight of the term that every text has
    :param least: a term must tell bad texts from others by this much (log-likelihood)
    """
    j = judged.where("hit_ord is not null and bad is not null").groupBy("hit_ord").agg(F.max("bad").alias("bad"))
    share = {r["bad"]: r["n"] for r in j.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = None
    for label in (True, False):
        some = j.where(F.col("bad") == label).orderBy(F.xxhash64("hit_ord"), "hit_ord").limit(each)
        pick = some if pick is None else pick.unionByName(some)
    rows = hits.select("hit_ord", F.coalesce("snippet", F.lit("")).alias("snippet")).join(F.broadcast(pick), "hit_ord").toPandas()
    rows = rows.sort_values(["hit_ord", "snippet"]).drop_duplicates("hit_ord").reset_index(drop=True)
    bad = rows["bad"].to_numpy(bool)
    counts: list = []
    for i in range(0, len(rows), 200):
        counts += _counts(rows["snippet"].iloc[i:i + 200].tolist(), sizes)
    held = np.zeros((2, SPACE), np.int32)
    for b, (index, _) in zip(bad, counts, strict=True):
        held[int(b), index] += 1
    of = np.maximum(np.array([(~bad).sum(), bad.sum()]), 1)[:, None]
    # Log-likelihood of the excess among bad texts; a shared term of two texts is not enough.
    odds = np.maximum(held[1], 0.5) / of[1] / ((held[0] + 0.5) / of[0])
    tells = np.where((held[1] > 2) & (odds > 1), held[1] * np.log(odds), 0.0)
    chosen = np.argsort(-tells, kind="stable")[:terms]
    chosen = np.sort(chosen[tells[chosen] >= least])
    term = np.full(SPACE, -1, np.int32)
    term[chosen] = np.arange(chosen.size)
    idf = np.log(1 + len(rows) / np.maximum(held[:, chosen].sum(0), 1))
    n_blocks = -(-len(rows) // BLOCK)
    model = Examples(sizes, term, idf, common, np.zeros((n_blocks, chosen.size, BLOCK), np.float32), np.zeros((chosen.size, n_blocks), np.float32),
                     np.zeros((n_blocks, BLOCK)), bad, rows["hit_ord"].to_numpy(), near)
    vectors = [model.vector(np.repeat(i, n)) for i, n in counts]
    order = sorted(range(len(rows)), key=lambda i: (bad[i], vectors[i][2]))
    for place, i in enumerate(order):
        b, e = divmod(place, BLOCK)
        model.weight[b, vectors[i][0], e] = vectors[i][1]
        model.base[b, e] = vectors[i][2]
    model.top[:] = model.weight.max(2).T if len(rows) else 0
    model.bad, model.key = bad[order], model.key[order]
    votes = np.array([model.vote(*model.nearest(*vectors[i], leave=place)) for place, i in enumerate(order)])
    # The sample has other shares of the labels than all judged hits have.
    weight = np.where(model.bad, share.get(True, 0) / of[1], share.get(False, 0) / of[0])
    if len(rows):
        model.curve = _curve(votes, model.bad, weight / weight.mean())
    return model


def judge(hits: DataFrame, examples: Examples, batch_chars: int = 1 << 19) -> DataFrame:
    """Score of every whole snippet.

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names
    :param examples: from ``fit``
    :return: one row per row of ``hits`` with ``hit_ord``, ``score`` (0 to 1, higher: bad likelier) and ``evidence``
        (``hit_ord`` of the nearest examples, nearest first). A null or empty snippet is a text without
        telling terms. Without examples every score is 0.
    """
    shared = hits.sparkSession.sparkContext.broadcast(examples)     # bounded: 2 x each examples, terms

    def run(batches):
        m = shared.value
        for b in batches:
            texts = ["" if not isinstance(t, str) else t for t in b["snippet"]]
            score, evidence, lo = [], [], 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and (hi == lo or held + len(texts[hi]) <= batch_chars):
                    held += len(texts[hi])
                    hi += 1
                index, start = grams(texts[lo:hi], m.sizes, SPACE)
                for x in np.split(index, start[1:]):
                    place, cosine = m.nearest(*m.vector(x))
                    score.append(m.vote(place, cosine))
                    evidence.append(m.key[place].tolist())
                lo = hi
            score = m.calibrated(np.array(score)) if m.bad.size else np.zeros(len(texts))
            yield pd.DataFrame({"hit_ord": b["hit_ord"], "score": np.clip(score, 0, 1), "evidence": evidence})

    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), "snippet")
    return rows.mapInPandas(run, "hit_ord long, score double, evidence array<long>")
