"""Language of a hit's snippet by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over hashed byte n-grams says
on which side a text lies; the language whose codeword loses least against all bits is taken, and a
text whose two best codewords lose almost the same is flagged as ambiguous."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.llm.texts import by_bytes

UNKNOWN = "und"
_EVEN = np.uint64(0x9E3779B97F4A7C15)
PIECES = 8          # of a long text that is fitted on


def codewords(languages: int, bits: int, seed: int = 7) -> np.ndarray:
    """+1/-1 codeword of each language: one bit of its own, and bits that split the languages in halves."""
    own = 2.0 * np.eye(languages) - 1
    if languages < 3:
        return own
    rng, splits = np.random.default_rng(seed), set()
    for _ in range(50 * bits):
        if len(splits) == bits:
            break
        half = rng.permutation(languages)[:languages // 2]
        side = np.isin(np.arange(languages), half)
        splits.add(tuple(side if side[0] else ~side))
    code = [2.0 * np.array(s) - 1 for s in sorted(splits)]
    return np.concatenate((own, np.stack(code, 1)), 1)


def grams(texts: list[str], sizes: tuple, space: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of all texts end to end, and where each text begins; digits count as space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:65] = 32
    fold[65:91] += 32
    fold[91:97] = fold[123:128] = 32
    parts, start, at = [], [], 0
    for t in texts:
        b = fold[np.frombuffer(b" " + t.encode("utf-8") + b" ", np.uint8)]
        b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))].astype(np.uint64)
        start.append(at)
        for n in sizes:
            if b.size >= n:
                h = np.full(b.size - n + 1, n, np.uint64)
                with np.errstate(over="ignore"):
                    for i in range(n):
                        h = h * np.uint64(257) + b[i:b.size - n + 1 + i]
                    h = (h * _EVEN) >> np.uint64(40)
                parts.append((h % np.uint64(space)).astype(np.int32))
                at += parts[-1].size
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(start, np.int64)


@dataclass
class Model:
    """Weights of the bits; a few megabytes whatever the number of hits."""

    languages: list
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    loss_weight: np.ndarray
    sizes: tuple

    def margins(self, texts: list[str]) -> np.ndarray:
        index, start = grams(texts, self.sizes, self.weights.shape[0] - 1)
        total = np.add.reduceat(self.weights[index], start, axis=0)
        norm = np.diff(np.concatenate((start, [index.size])))[:, None]
        return total / np.sqrt(np.maximum(norm, 1)) + self.bias

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language, and its share against the next best."""
        margin = self.margins(texts)
        # Loss of a codeword: each bit's loss, weighted by how well that bit does on the sample.
        lost = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -30, 30))) @ self.loss_weight
        order = np.sort(lost, axis=1)
        gap = order[:, 1] - order[:, 0] if lost.shape[1] > 1 else np.full(len(texts), 30.0)
        return lost.argmin(1), 1 / (1 + np.exp(-np.clip(gap, 0, 30)))


def fit(labelled: DataFrame, sample: int = 1200, sizes: tuple = (1, 2, 3, 4), space: int = 1 << 17, bits: int = 8,
        rounds: int = 30, chars: int = 4000) -> Model:
    """Classifiers of a bounded sample.

    :param labelled: ``snippet``, ``locale``; rows without either are left out
    :param sample: rows fitted on, at most; about as many of each language, picked by a hash of the text
    :param chars: characters of a sampled text that are fitted on, at most (but for spaces between pieces); of a longer text, pieces
        from evenly spread places
    """
    piece, last = chars // PIECES, F.char_length("snippet") - chars // PIECES
    spread = [F.substring("snippet", F.floor(last * i / (PIECES - 1)).cast("int") + 1, F.lit(piece)) for i in range(PIECES)]
    some = F.when(F.char_length("snippet") <= chars, F.col("snippet")).otherwise(F.concat_ws(" ", *spread))
    rows = labelled.where("locale is not null and snippet rlike '\\\\S'") \
        .select("locale", some.alias("snippet"), F.xxhash64("snippet").alias("pick"))
    # Copies of a text are one example, so they count once.
    held = {r["locale"]: r["n"] for r in rows.select("locale", "pick").distinct().groupBy("locale").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not held:
        return Model([], np.zeros((0, 0)), np.zeros((space + 1, 0), np.float32), np.zeros(0), np.zeros(0), sizes)
    each = sample // len(held)
    share = F.lit(0.0)
    for name, n in held.items():
        share = F.when(F.col("locale") == name, F.lit(min(1.0, 1.3 * each / n))).otherwise(share)
    picked = rows.where(F.pmod("pick", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["pick", "locale"]) \
        .orderBy("pick", "locale").limit(2 * sample).toPandas()
    picked = picked.groupby("locale").head(each)
    if picked.empty:
        picked = rows.orderBy("pick", "locale").limit(sample).toPandas()
    names = sorted(picked["locale"].unique())
    code = codewords(len(names), bits)
    # Distinct n-grams of each text, counted a few texts at a time: the driver holds these alone.
    row, index, value = [], [], []
    for lo in range(0, len(picked), 50):
        found, start = grams(picked["snippet"].iloc[lo:lo + 50].tolist(), sizes, space)
        for i, x in enumerate(np.split(found, start[1:])):
            gram, times = np.unique(x, return_counts=True)
            row.append(np.full(gram.size, lo + i, np.int32))
            index.append(gram)
            value.append((times / np.sqrt(max(x.size, 1))).astype(np.float32))
    row, index, value = np.concatenate(row), np.concatenate(index), np.concatenate(value)
    first = np.searchsorted(row, np.arange(len(picked)))
    truth = code[np.searchsorted(names, picked["locale"])]
    w, bias, past = np.zeros((space, code.shape[1])), np.zeros(code.shape[1]), np.full((space, code.shape[1]), 1e-6)
    by_gram = np.argsort(index, kind="stable")
    there, gram_start = np.unique(index[by_gram], return_index=True)
    sums = lambda: np.stack([np.add.reduceat(w[index, k] * value, first) for k in range(w.shape[1])], 1)
    for _ in range(rounds):
        margin = sums() + bias
        slope = -truth / (1 + np.exp(np.clip(truth * margin, -30, 30))) / len(picked)
        step = np.stack([np.add.reduceat((slope[row, k] * value)[by_gram], gram_start) for k in range(slope.shape[1])], 1)
        past[there] += step * step
        w[there] -= 0.3 * step / np.sqrt(past[there])
        bias -= slope.sum(0)
    margin = sums() + bias
    right = (margin * truth > 0).mean(0)
    return Model(names, code, np.concatenate((w, np.zeros((1, w.shape[1])))).astype(np.float32), bias,
                 np.maximum(right - 0.5, 0.01) / np.maximum(right - 0.5, 0.01).sum() * len(right), sizes)


def identify(hits: DataFrame, model: Model, doubt: float = 0.6, batch_bytes: int = 1 << 17, carry: tuple = ()) -> DataFrame:
    """Language of every whole snippet.

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names
    :param model: from ``fit``
    :param doubt: a text with a lower score is flagged
    :param batch_bytes: texts decoded at a time; each byte takes some 300 bytes of a task's memory
    :param carry: columns of ``hits`` to return as well
    :return: one row per row of ``hits`` with ``hit_ord``, ``locale``, ``score`` (0 to 1; share of the best
        codeword against the next) and ``ambiguous``. A snippet that is null or has no letter, and every
        snippet if the model learned no language, is ``und`` with score 0 and flagged.
    """
    spark = hits.sparkSession
    shared = spark.sparkContext.broadcast(model)                    # bounded by space x bits

    def run(batches):
        m = shared.value
        for b in batches:
            best, score, at = np.full(b.num_rows, -1), np.zeros(b.num_rows), 0
            for texts in by_bytes(b.column("snippet"), batch_bytes):
                clear = [i for i, t in enumerate(texts) if m.languages and t is not None and any(map(str.isalpha, t))]
                if clear:
                    rows = at + np.array(clear)
                    best[rows], score[rows] = m.decode([texts[i] for i in clear])
                at += len(texts)
            names = pa.array([m.languages[i] if i >= 0 else UNKNOWN for i in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("hit_ord"), names, pa.array(score), pa.array(score < doubt), *(b.column(c) for c in carry)],
                ["hit_ord", "locale", "score", "ambiguous", *carry])

    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), "snippet", *[c for c in carry if c != "snippet"])
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "hit_ord long, locale string, score double, ambiguous boolean" + kinds)
