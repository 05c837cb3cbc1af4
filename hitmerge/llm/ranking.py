"""Ranked lexical search over hits: Block-Max MaxScore on the shards of an inverted index.

Each task turns its hits into shards: a list of postings for every term, cut into blocks by ranges of ``SPAN`` hits, so a
posting is a place of one byte within its block and a count. Beside each block stands the largest impact in it. A query
ranks its lists in a shard by their largest possible score. Lists that together cannot reach the score of the worst hit
kept so far are non-essential: they bring in no candidates. Blocks whose maxima cannot reach that score are never opened;
the hits of the essential lists in the others are candidates, the block maxima of the non-essential lists reject most of
them, and only then are blocks of these lists decoded, list by list. Tasks keep one heap for each query over their shards;
the heaps are merged by Spark."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitmerge.llm.texts import small
from hitmerge.session import cut_lineage

SPAN = 256                  # hits of a block
SHARD_HITS = 1 << 14
SHARD_BYTES = 12 << 20
PIECE = 1 << 22             # bytes of a text that are cut into words at a time

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """Terms of a text in order, those of a long one a piece at a time."""
    folded = text.encode("utf-8").translate(_FOLD) if text else b""
    lo = 0
    while lo < len(folded):
        hi = folded.find(b" ", lo + PIECE)
        hi = len(folded) if hi < 0 else hi
        yield folded[lo:hi].split()
        lo = hi


def terms(text: str | None) -> Counter:
    """Terms of a text with their counts: runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    found: Counter = Counter()
    for piece in _pieces(text):
        found.update(piece)
    return found


def impact(times, size, hits: int, total: int):
    """Integer weight of a term in a hit of ``size`` terms that holds it ``times`` times."""
    return (1_000_000_000 * times) // (1000 * times + 12 * (75 + (25 * size * hits) // total))


def weight(hits: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * hits + 2) / (2 * holding + 1)))


_PARTS = {"ords": np.int64, "named": np.bool_, "vocabulary": np.uint64, "first": np.int32, "span": np.uint16, "at": np.int32, "top": np.int32,
          "where": np.uint8, "times": np.uint8, "size": np.int32, "many_at": np.int32, "many": np.int32}
_SHARD = ", ".join(f"{p} binary" for p in _PARTS)


class Shard:
    """Postings of some hits. List t has blocks first[t] to first[t + 1]; block b has postings at[b] to at[b + 1]."""

    def __init__(self, parts: dict, hits: int, total: int):
        self.__dict__.update(parts)
        self.hits, self.total = hits, total
        self.spans = -(-self.ords.size // SPAN)
        self.rows: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, ords: list, counted: list[Counter], hits: int, total: int) -> dict:
        known: dict[bytes, int] = {}
        name, times, n = [], [], []
        for c in counted:
            name += [known.setdefault(w, len(known)) for w in c]
            times += c.values()
            n.append(len(c))
        size = np.array([sum(c.values()) for c in counted], np.int64)
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        by_hash = np.argsort(hashed)
        rank = np.empty(by_hash.size, np.int64)
        rank[by_hash] = np.arange(by_hash.size)
        doc = np.repeat(np.arange(len(counted)), n)
        key = rank[np.array(name, np.int64)] * len(counted) + doc if name else np.empty(0, np.int64)
        order = np.argsort(key)
        key, times = key[order], np.array(times, np.int64)[order]
        term, doc = np.divmod(key, max(len(counted), 1))
        span = doc // SPAN
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (span[1:] != span[:-1])))) if key.size else np.empty(0, np.int64)
        score = impact(times, size[doc], hits, total) if key.size else np.empty(0, np.int64)
        many = np.flatnonzero(times > 255)
        return {"ords": np.array([o or 0 for o in ords], np.int64), "named": np.array([o is not None for o in ords]), "vocabulary": hashed[by_hash],
                "first": np.append(np.searchsorted(term[new], np.arange(by_hash.size)), new.size), "span": span[new], "at": np.append(new, key.size),
                "top": np.maximum.reduceat(score, new) if key.size else score, "where": doc % SPAN, "times": np.minimum(times, 255), "size": size,
                "many_at": many, "many": times[many]}

    def tops(self, t: int) -> np.ndarray:
        """Largest impact of a list in each range of hits."""
        row = self.rows.get(t)
        if row is None:
            row = self.rows[t] = np.zeros(self.spans, np.int64)
            row[self.span[self.first[t]:self.first[t + 1]]] = self.top[self.first[t]:self.first[t + 1]]
        return row

    def decode(self, t: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hits and impacts of a list in the ranges that are ``live``; other blocks stay closed."""
        b = np.arange(self.first[t], self.first[t + 1])
        b = b[live[self.span[b]]]
        size = self.at[b + 1] - self.at[b]
        p = np.repeat(self.at[b] - np.cumsum(size) + size, size) + np.arange(size.sum())
        times = self.times[p].astype(np.int64)
        full = np.flatnonzero(times == 255)
        if full.size and self.many.size:
            i = np.minimum(np.searchsorted(self.many_at, p[full]), self.many.size - 1)
            times[full] = np.where(self.many_at[i] == p[full], self.many[i], 255)
        doc = np.repeat(self.span[b].astype(np.int64) * SPAN, size) + self.where[p]
        return doc, impact(times, self.size[doc].astype(np.int64), self.hits, self.total)

    def search(self, lists: np.ndarray, weights: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Hits that score at least ``reach``, and their scores.

        :param lists: lists of the terms
        :param weights: their weights, above 0
        """
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        tops = np.stack([self.tops(t) for t in lists]) * weights[:, None]
        order = np.argsort(tops.max(1), kind="stable")
        lists, weights, tops = lists[order], weights[order], tops[order]
        together = np.cumsum(tops.max(1))
        spare = int(np.searchsorted(together, reach))                       # lists that cannot reach it together
        bound = tops.sum(0)
        live = bound >= reach
        if spare == lists.size or not live.any():
            return none
        score = np.zeros(self.ords.size, np.int64)
        seen = np.zeros(self.ords.size, bool)
        for i in range(spare, lists.size):
            doc, got = self.decode(lists[i], live)
            score[doc] += got * weights[i]
            seen[doc] = True
        some = np.flatnonzero(seen)
        rest = tops[:spare].sum(0)
        some = some[score[some] + rest[some // SPAN] >= reach]
        for i in range(spare - 1, -1, -1):
            if not some.size:
                return none
            wanted = np.zeros(self.spans, bool)
            wanted[some // SPAN] = True
            doc, got = self.decode(lists[i], wanted)
            score[doc] += got * weights[i]
            rest = rest - tops[i]
            some = some[score[some] + rest[some // SPAN] >= reach]
        return some, score[some]


@dataclass
class Index:
    """Shards of all hits, and what every score depends on."""

    shards: DataFrame
    hits: int
    total: int


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of hits with terms, and of all their terms."""
    for b in small(batches):
        n = [sum(len(p) for p in _pieces(t)) for t in b.column("snippet").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["hits", "total"])


def _build(hits: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ords, counted, held = [], [], 0

        def packed():
            parts = Shard.build(ords, counted, hits, total)
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(parts[p], kind).tobytes()], pa.binary()) for p, kind in _PARTS.items()],
                                              list(_PARTS))

        for b in small(batches):
            for ord_, text in zip(b.column("hit_ord").to_pylist(), b.column("snippet").to_pylist(), strict=True):
                c = terms(text)
                if c:
                    ords.append(ord_)
                    counted.append(c)
                    held += len(text)
                    if len(ords) == SHARD_HITS or held >= SHARD_BYTES:
                        yield packed()
                        ords, counted, held = [], [], 0
        if ords:
            yield packed()
    return run


def index(hits: DataFrame) -> Index:
    """Inverted index of all terms of all hits.

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names. A null snippet and one without terms is in no
        list. Rows that repeat a ``hit_ord``, or have none, are hits of their own.
    """
    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), "snippet")
    held = rows.select("snippet").mapInArrow(_counted, "hits long, total long").agg(F.sum("hits"), F.sum("total")).first()
    n, total = held[0] or 0, held[1] or 1
    return Index(cut_lineage(rows.mapInArrow(_build(n, total), _SHARD)), n, total)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Parts of each shard, as views of the batch."""
    for b in batches:
        for i in range(b.num_rows):
            yield {p: np.frombuffer(b.column(p)[i].as_buffer(), _PARTS[p]) for p in b.schema.names}


def _held(vocabulary: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """List of each wanted term, -1 where the shard has none."""
    at = np.minimum(np.searchsorted(vocabulary, wanted), max(vocabulary.size - 1, 0))
    return np.where(vocabulary[at] == wanted, at, -1)


def _holding(shared):
    """Number of hits of each wanted term, by shard."""
    def run(batches):
        for s in _opened(batches):
            t = _held(s["vocabulary"], shared.value)
            name, t = shared.value[t >= 0], t[t >= 0]
            n = s["at"][s["first"][t + 1]] - s["at"][s["first"][t]]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])
    return run


def _search(shared, hits: int, total: int, top: int):
    """The best hits of each query in the shards of a task."""
    def run(batches):
        wanted, queries = shared.value
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)) for _ in queries]
        for parts in _opened(batches):
            shard = Shard(parts, hits, total)
            at = _held(shard.vocabulary, wanted)
            for q, (_, place, weights) in enumerate(queries):
                lists = at[place]
                ok = (lists >= 0) & (weights > 0)
                if not ok.any():
                    continue
                score, ord_, named = kept[q]
                reach = int(score[-1]) if score.size == top else 1
                doc, got = shard.search(lists[ok], weights[ok], reach)
                if doc.size:
                    score, ord_, named = (np.concatenate(x) for x in ((score, got), (ord_, shard.ords[doc]), (named, shard.named[doc])))
                    best = np.lexsort((ord_, ~named, -score))[:top]
                    kept[q] = score[best], ord_[best], named[best]
        for (key, _, _), (score, ord_, named) in zip(queries, kept, strict=True):
            if score.size:
                yield pa.RecordBatch.from_arrays([pa.array([key] * score.size, pa.string()), pa.array(ord_, pa.int64(), mask=~named), pa.array(score)],
                                                 ["_key", "hit_ord", "score"])
    return run


def search(of: Index, queries: DataFrame, top: int = 20, at_once: int = 2000, bytes_at_once: int = 8 << 20) -> DataFrame:
    """The best hits of each query.

    A term's weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), N hits with terms, df of them with the term. A hit's score sums, over
    the terms of the query with repeats, weight * ``impact``; 64-bit integers throughout. Hits of equal score stand by ``hit_ord``,
    those without one last.

    :param of: from ``index``
    :param queries: ``query_id``, ``query``; a query without terms finds nothing. Rows that repeat a text have the same list
    :param top: hits of a query, fewer if fewer score above 0
    :param at_once: texts of queries that are sent to the tasks at a time; of more, the index is read several times
    :param bytes_at_once: their bytes
    :return: ``query_id``, ``rank`` (from 1), ``hit_ord``, ``score``
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.md5("query").alias("_key"), "query").where("query is not null")
    texts = asked.groupBy("_key").agg(F.first("query").alias("query"))
    held = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("query"))).first()
    blocks = max(1, -(-held[0] // at_once), -(-(held[1] or 0) // bytes_at_once))
    found = None
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("_key"), F.lit(blocks)) == block).collect()
        counted = [(r["_key"], terms(r["query"])) for r in rows]
        name = {w: xxhash.xxh64_intdigest(w) for _, c in counted for w in c}
        wanted = np.unique(np.array(list(name.values()), np.uint64))
        n = of.shards.select("vocabulary", "first", "at").mapInArrow(_holding(spark.sparkContext.broadcast(wanted)), "term long, n long") \
            .groupBy("term").agg(F.sum("n").alias("n")).collect()       # at most one row a term of these queries
        holding = {r["term"] % (1 << 64): r["n"] for r in n}
        sent = []
        for key, c in counted:
            h = np.array([name[w] for w in c], np.uint64)
            sent.append((key, np.searchsorted(wanted, h), np.array([weight(of.hits, holding.get(int(x), 0)) * m for x, m in zip(h, c.values(), strict=True)],
                                                                   np.int64)))
        part = of.shards.mapInArrow(_search(spark.sparkContext.broadcast((wanted, sent)), of.hits, of.total, top), "_key string, hit_ord long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("_key").orderBy(F.desc("score"), F.asc_nulls_last("hit_ord"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return asked.select("query_id", "_key").join(best, "_key").select("query_id", "rank", "hit_ord", "score")
