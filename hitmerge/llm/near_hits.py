"""Hits whose snippets are near copies: parity sketches joined word by word, then verified.

The shingles of a snippet are dealt to ``m`` sketch words of 64 bits; each shingle toggles one bit of
its word. Every bit in which two sketches differ needs a shingle that only one snippet has, so the
Hamming distance is at most the symmetric difference of the sets. Snippets similar enough to link
differ in at most ``d`` shingles, and with more than ``d`` words some words must be equal: hits meet
on equal words of their size band, and what meets is verified on the sets themselves.

A word of few shingles is equal by chance too often. A hit therefore shows only its words of at
least ``f`` shingles, with the largest ``f`` that leaves it more words than it can differ in from any
partner. The pair's larger ``f`` is then met by a word that is equal in both and that both show."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.operators.components import components
from hitmerge.llm.texts import mix, shingle_lists, small
from hitmerge.session import cut_lineage, fewer_tasks

SMALL = 8         # hits of a word that meet as pairs of names; larger groups are compared in tiles


class Sketch:
    """Words of the sketches of one similarity. Bands of sizes double; a linked pair lies in one or two of them."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, a: int, b: int) -> int:
        """Most shingles in which linked sets of these sizes can differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def partner(self, size: int) -> int:
        """Largest set that can link with one of this size."""
        return size * 100 // self.percent

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Keys at which a set meets others: in its own band, and in the one below if a smaller set of it can link."""
        n = shingles.size
        band = n.bit_length()                               # sizes 2^(band-1) to 2^band - 1
        out = [self._keys(shingles, band, self.differ(n, self.partner(n)))]
        if band > 1 and n <= self.partner((top := (1 << (band - 1)) - 1)):
            out.append(self._keys(shingles, band - 1, self.differ(n, top)))
        return np.concatenate(out)

    def _keys(self, shingles, band, d):
        top = (1 << band) - 1
        words = 1 + self.differ(top, self.partner(top)) * 6 // 5
        at = ((shingles >> np.uint64(32)) % np.uint64(words)).astype(np.int64)
        held = np.bincount(at, minlength=words)
        least = next((f for f in range(int(held.max()), 0, -1) if np.count_nonzero(held >= f) > d), 0)
        order = np.argsort(at, kind="stable")
        there = np.flatnonzero(held)
        start = np.cumsum(held[there]) - held[there]
        inside, total = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        inside[there] = np.bitwise_xor.reduceat(np.uint64(1) << (shingles[order] & np.uint64(63)), start)
        total[there] = np.bitwise_xor.reduceat(mix(shingles[order]), start)
        show = np.flatnonzero(held >= least)
        with np.errstate(over="ignore"):
            # Which shingles a word holds tells words apart that have the same parities by chance.
            return mix(inside[show] ^ mix(total[show] + mix(show.astype(np.uint64) + np.uint64(band << 40))))


def _digest(shingles: np.ndarray) -> int:
    """Name of a set of shingles; below 2^63."""
    with np.errstate(over="ignore"):
        return int(mix(np.bitwise_xor.reduce(mix(shingles)) + mix(shingles).sum(dtype=np.uint64))) >> 1


def _longs(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64)


def _similar(percent: int, both, a, b):
    return 100 * both >= percent * (a + b - both)


def _rows(batch, words):
    """Set of the shingles of each row of a batch; those of different pools have nothing in common."""
    for h, pool in zip(shingle_lists(batch.column("snippet").to_pylist(), words), batch.column("pool").to_pylist(), strict=True):
        yield np.unique(mix(h ^ np.uint64(pool % (1 << 64))) if pool else h)


def _name(words):
    def run(batches):
        for batch in small(batches):
            size, name = [], []
            for s in _rows(batch, words):
                size.append(s.size)
                name.append(_digest(s) if s.size else None)
            kept = [c for c in batch.schema.names if c != "snippet"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(size, pa.int64()), pa.array(name, pa.int64())],
                                             [*kept, "n_shingles", "name"])
    return run


def _deal(words, percent, parts):
    """Keys of a batch, packed for each part that will sort them."""
    def run(batches):
        sketch = Sketch(percent)
        for batch in small(batches):
            keys, names, seen = [], [], set()
            for s in _rows(batch, words):
                if s.size and (name := _digest(s)) not in seen:
                    seen.add(name)
                    keys.append(sketch.keys(s).view(np.int64))
                    names.append(np.full(keys[-1].size, name, np.int64))
            if not keys:
                continue
            k, n = np.concatenate(keys), np.concatenate(names)
            part = (k.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            k, n, part = k[order], n[order], part[order]
            cut = np.flatnonzero(np.diff(part)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[np.concatenate(([0], cut))], pa.int64()), pa.array([x.tobytes() for x in np.split(k, cut)], pa.binary()),
                 pa.array([x.tobytes() for x in np.split(n, cut)], pa.binary())], ["part", "keys", "names"])
    return run


def _meet(batches):
    """Hits that show the same key: pairs of a small group, memberships of a larger one."""
    keys, names = [], []
    for b in batches:
        keys += b.column("keys").to_pylist()
        names += b.column("names").to_pylist()
    k, n = _longs(keys), _longs(names)
    del keys, names
    if k.size == 0:
        return
    order = np.lexsort((n, k))
    k, n = k[order], n[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])))
    k, n = k[new], n[new]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    size = np.diff(np.concatenate((start, [k.size])))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(SMALL):
        for j in range(i + 1, SMALL):
            at = start[(size > j) & (size <= SMALL)]
            left.append(n[at + i])
            right.append(n[at + j])
    pairs = np.unique(np.stack((np.concatenate(left), np.concatenate(right)), 1), axis=0)
    big = np.repeat(size > SMALL, size)
    for kind, a, b in (("pair", pairs[:, 0], pairs[:, 1]), ("group", -1 - (k[big] & np.int64((1 << 62) - 1)), n[big])):
        for i in range(0, a.size, 1 << 16):
            x, y = a[i:i + (1 << 16)], b[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * x.size), pa.array(x), pa.array(y)], ["kind", "u", "v"])


def _sets(words):
    """Name and shingles of each row; its own name, whatever other texts its hit has."""
    def run(batches):
        for batch in small(batches):
            sets = [s for s in _rows(batch, words) if s.size]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             ["name", "shingles"])
    return run


def _wanted_sets(hits: DataFrame, named: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``name``, ``shingles`` of each wanted name, once. One hit of each name is read again; of hits that have several rows, or no
    ``hit_ord``, all rows are, each once, and those of other names are left out."""
    chosen = named.join(wanted, "name").groupBy("name").agg(F.min(F.struct(F.col("hit_ord").isNull().alias("k"), "hit_ord", "pool")).alias("at")) \
        .select("name", "at.hit_ord", "at.pool")
    tasks = fewer_tasks(hits.sparkSession)
    chosen = cut_lineage(chosen, tasks)
    several = named.groupBy("hit_ord", "pool").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or hit_ord is null").select("hit_ord", "pool")
    several = cut_lineage(several, tasks)
    alone = chosen.where("hit_ord is not null").join(several, ["hit_ord", "pool"], "left_anti").select("hit_ord", "pool").distinct()
    kind = "name long, shingles binary"
    sets = hits.join(alone, ["hit_ord", "pool"], "left_semi").mapInArrow(_sets(words), kind)
    if several.isEmpty():
        return sets
    ids = several.withColumnsRenamed({"hit_ord": "o", "pool": "p"})
    again = hits.join(ids, hits["hit_ord"].eqNullSafe(ids["o"]) & (hits["pool"] == ids["p"]), "left_semi").mapInArrow(_sets(words), kind)
    rest = chosen.join(alone, ["hit_ord", "pool"], "left_anti").select("name")
    return sets.unionByName(again.join(rest, "name", "left_semi").groupBy("name").agg(F.first("shingles").alias("shingles")))


def _verify(percent):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("su").to_pylist(), b.column("sv").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = p.size + q.size - np.unique(np.concatenate((p, q))).size
                keep.append(_similar(percent, both, p.size, q.size))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def _forest(percent, columns=4096):
    """Links inside a tile, by exact intersections; only as many as hold its components together."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("name")
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        size = np.array([s.size for s in sets])
        row = np.repeat(np.arange(size.size), size)
        _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, at = row[times[at] > 1], at[times[at] > 1]
        _, at = np.unique(at, return_inverse=True)
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        both = np.zeros((size.size, size.size), np.float32)
        for c in range(0, int(at[-1]) + 1 if at.size else 0, columns):
            lo, hi = np.searchsorted(at, (c, c + columns))
            held = np.zeros((size.size, columns), np.float32)
            held[row[lo:hi], at[lo:hi] - c] = 1
            both += held @ held.T
        linked = _similar(percent, both.astype(np.int64), size[:, None], size[None, :])
        np.fill_diagonal(linked, False)
        open_, out, names = np.ones(size.size, bool), [], group["name"].to_numpy()
        for seed in range(size.size):
            todo = [seed] if open_[seed] else []
            open_[seed] = False
            while todo:
                x = todo.pop()
                found = np.flatnonzero(linked[x] & open_)
                open_[found] = False
                todo += found.tolist()
                out += [(names[x], names[y]) for y in found]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")
    return run


def _clusters(groups: DataFrame) -> DataFrame:
    """``cluster``, ``name``: names that are connected by keys. Only keys are labelled: each stands beside the least key of each of its
    names, and near copies mostly have the same least key, so there are few such edges however large a group is."""
    held = cut_lineage(groups.groupBy(F.col("v").alias("name")).agg(F.min("u").alias("least"), F.collect_set("u").alias("keys")),
                       fewer_tasks(groups.sparkSession))
    edges = held.select("least", F.explode("keys").alias("key")).distinct()
    label = components(edges.select(F.col("key").alias("u"), F.col("least").alias("v")))
    return held.join(label, held["least"] == label["node"], "left").select(F.coalesce("component", "least").alias("cluster"), "name")


def _tiles(groups: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links inside large groups: tiles of similar size meet tile by tile."""
    member = _clusters(groups)
    step = F.floor(F.log(F.octet_length("shingles") / 8) / F.log(F.lit(100 / percent)))
    sized = cut_lineage(member.join(sets, "name").withColumn("step", step), fewer_tasks(groups.sparkSession))
    count = sized.groupBy("cluster", "step").agg(F.ceil(F.count(F.lit(1)) / rows).alias("cuts"))
    sized = sized.join(count, ["cluster", "step"]).withColumn("cut", F.pmod(F.xxhash64("name"), "cuts"))
    tile = count.select("cluster", "step", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    other = tile.select("cluster", F.col("step").alias("step2"), F.col("cut").alias("cut2"))
    met = tile.withColumn("step2", F.explode(F.array(F.col("step"), F.col("step") + 1))).join(other, ["cluster", "step2"]) \
        .where("step < step2 or cut <= cut2").withColumn("tile", F.xxhash64("cluster", "step", "cut", "step2", "cut2"))
    sides = met.select("tile", "cluster", "step", "cut").unionByName(
        met.select("tile", "cluster", F.col("step2").alias("step"), F.col("cut2").alias("cut"))).distinct()
    return sized.join(sides, ["cluster", "step", "cut"]).select("tile", "name", "shingles") \
        .groupBy("tile").applyInPandas(_forest(percent), "u long, v long")


def near_hits(hits: DataFrame, percent: int = 80, words: int = 5, tile_rows: int = 400, within: tuple = ()) -> DataFrame:
    """Groups of hits whose snippets are near copies of each other.

    A snippet is the set of its distinct runs of ``words`` words (white space apart, A-Z in lower case).
    Two hits link when 100 * intersection >= percent * union; every such link between different
    texts is found.

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names
    :param percent: least Jaccard similarity in percent, 50 to 100
    :param words: words of a shingle; a snippet with fewer words is one shingle
    :param tile_rows: hits of a large group that are compared in one task at a time
    :param within: columns that name a pool, such as ``("query_id",)``: hits of different pools never link, and ``hit_ord`` need be
        unique in its pool only
    :return: ``within``, ``hit_ord``, ``n_shingles``, ``component_id`` (least ``hit_ord`` reachable by links), one row
        per row of ``hits``. A null, empty or blank snippet has no shingles and no links. Rows that repeat a
        ``hit_ord`` keep their own texts. A row without ``hit_ord`` stays and never names a component.
    """
    spark = hits.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pool = F.xxhash64(*within) if within else F.lit(0).cast("long")
    hits = hits.select(*within, F.col("hit_ord").cast("long").alias("hit_ord"), pool.alias("pool"), "snippet")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema if f.name != "snippet")
    named = cut_lineage(hits.mapInArrow(_name(words), kept + ", n_shingles long, name long"))
    first = named.where("name is not null").groupBy("name").agg(F.min("hit_ord").alias("hit_ord"))
    met = hits.mapInArrow(_deal(words, percent, parts), "part long, keys binary, names binary") \
        .repartition(parts // 4, "part").mapInArrow(_meet, "kind string, u long, v long")
    tasks = fewer_tasks(spark)
    met = cut_lineage(met, tasks)
    pairs = met.where("kind = 'pair'").select("u", "v").distinct()
    groups = met.where("kind = 'group'").select("u", "v")
    wanted = pairs.select(F.col("u").alias("name")).unionByName(pairs.select(F.col("v").alias("name"))) \
        .unionByName(groups.select(F.col("v").alias("name"))).distinct()
    sets = cut_lineage(_wanted_sets(hits.select("hit_ord", "pool", "snippet"), named, wanted, words), tasks)
    side = lambda c: sets.select(F.col("name").alias(c), F.col("shingles").alias(f"s{c}"))
    links = pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_verify(percent), "u long, v long")
    links = links.unionByName(_tiles(groups, sets, percent, tile_rows))
    found = components(links)
    group = first.join(found, first["name"] == found["node"], "left").select(
        "name", "hit_ord", F.coalesce("component", "name").alias("component"))
    least = group.groupBy("component").agg(F.min("hit_ord").alias("component_id"))
    label = group.join(least, "component").select("name", "component_id")
    return named.join(label, "name", "left").select(
        *within, "hit_ord", "n_shingles", F.coalesce("component_id", "hit_ord").alias("component_id"))
