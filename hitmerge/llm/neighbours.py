"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

The project's records have no vectors, so this operator is general: rows of (id, label, vector).
Equal vectors of a label are taken together first. The distinct ones of a label are dealt to shards of a
bounded size, each shard gets a graph, and every vector queries every shard of its label. A shard's graph
meets one block of queries per task; the task gives the number of links of each vector and only as
many links as hold components together."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.operators.components import components
from hitmerge.session import cut_lineage

WIDTH = 16          # diverse neighbours of a node; as many more may point back at it


def _unit(rows) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in rows])
    scale = np.abs(v).max(1, keepdims=True)         # large or tiny components square safely
    v = v / scale
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _layer(v: np.ndarray, nodes: np.ndarray, width: int) -> np.ndarray:
    """Neighbours of each node: the nearest that are nearer to it than to a neighbour it already has, and
    the nearest of those that chose it."""
    n = nodes.size
    out = np.full((n, 2 * width), -1, np.int32)
    if n < 2:
        return out
    sim = v[nodes] @ v[nodes].T
    np.fill_diagonal(sim, -2)
    k = min(3 * width, n - 1)
    near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable"), 1)
    own = np.take_along_axis(sim, near, 1)
    keep = np.zeros((n, k), bool)
    for r in range(k):
        blocked = np.zeros(n, bool)
        for s in range(r):
            blocked |= keep[:, s] & (sim[near[:, r], near[:, s]] > own[:, r])
        keep[:, r] = ~blocked & (keep.sum(1) < width)
    keep[:, :2] = True                              # copies of a copy stay within reach
    at, r = np.nonzero(keep)
    back = np.lexsort((-own[at, r], near[at, r]))
    fill = np.zeros(n, np.int64)
    for a, b in zip(at.tolist(), near[at, r].tolist(), strict=True):
        if fill[a] < width:
            out[a, fill[a]] = nodes[b]
            fill[a] += 1
    for i in back.tolist():
        a, b = near[at[i], r[i]], at[i]
        if fill[a] < 2 * width and nodes[b] not in out[a, :fill[a]]:
            out[a, fill[a]] = nodes[b]
            fill[a] += 1
    return out


class Graph:
    """Layers of a shard. A node is in layer ``l`` with chance ``WIDTH ** -l``."""

    def __init__(self, v: np.ndarray, width: int = WIDTH, seed: int = 3):
        self.v = v.astype(np.float32)
        level = np.floor(-np.log(np.random.default_rng(seed).random(len(v))) / np.log(width)).astype(int)
        self.layers = []
        for at in range(level.max() + 1):
            nodes = np.flatnonzero(level >= at)
            full = np.full((len(v), 2 * width), -1, np.int32)
            full[nodes] = _layer(self.v, nodes, width)
            self.layers.append(full)
        self.entry = int(level.argmax())

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, v=self.v, entry=self.entry, layers=np.stack(self.layers))
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Graph:
        g, held = cls.__new__(cls), np.load(io.BytesIO(blob))
        g.v, g.entry, g.layers = held["v"], int(held["entry"]), list(held["layers"])
        return g

    def search(self, q: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found for each query (-1 pads) and their cosines."""
        q = q.astype(np.float32)
        rows, n = np.arange(len(q)), len(self.v)
        beam = min(beam, n)
        at = np.full(len(q), self.entry)
        best = q @ self.v[self.entry]
        for layer in self.layers[:0:-1]:
            moved = np.ones(len(q), bool)
            while moved.any():
                near = layer[at]
                sim = np.where(near >= 0, np.einsum("qd,qwd->qw", q, self.v[near]), -2)
                top = sim.argmax(1)
                moved = sim[rows, top] > best
                at = np.where(moved, near[rows, top], at)
                best = np.where(moved, sim[rows, top], best)
        node = np.full((len(q), beam), -1, np.int64)
        sim = np.full((len(q), beam), -2, np.float32)
        node[:, 0], sim[:, 0] = at, best
        spread = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), n + 1), bool)      # the last column takes the padding
        seen[rows, at] = True
        seen[:, n] = True
        live = rows
        while live.size:
            rank = np.where(spread[live] | (node[live] < 0), -3, sim[live])
            pick = np.argpartition(-rank, min(step, beam) - 1, axis=1)[:, :min(step, beam)]
            ok = np.take_along_axis(rank, pick, 1) > -3
            live, pick, ok = live[ok.any(1)], pick[ok.any(1)], ok[ok.any(1)]
            if not live.size:
                break
            spread[live[:, None], pick] |= ok
            from_ = np.where(ok, node[live[:, None], pick], -1)
            near = np.where(from_[:, :, None] >= 0, self.layers[0][from_], -1).reshape(live.size, -1)
            near = np.sort(np.where(near < 0, n, near), axis=1)
            new = ~seen[live[:, None], near]
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[live[:, None], near] = True
            near = np.where(new, near, -1)
            got = np.where(new, np.einsum("qd,qwd->qw", q[live], self.v[near]), -2)
            both = np.concatenate((sim[live], got), 1)
            top = np.argpartition(-both, beam - 1, axis=1)[:, :beam]
            sim[live] = np.take_along_axis(both, top, 1)
            node[live] = np.take_along_axis(np.concatenate((node[live], near), 1), top, 1)
            spread[live] = np.take_along_axis(np.concatenate((spread[live], np.zeros(near.shape, bool)), 1), top, 1)
        return node, sim


def linked(graph: Graph, q: np.ndarray, least: float, beam: int = 32, audit: int = 32, recall: float = 0.97) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of at least about ``least``.

    A beam is as wide as it must be: it doubles while an audit of some queries by all cosines finds fewer than
    ``recall`` of their ten nearest, and for any query whose whole beam links. A beam as wide as the shard
    holds all of it."""
    n = len(graph.v)
    some = np.linspace(0, len(q) - 1, min(audit, len(q))).astype(int)
    k = min(10, n)
    truth = np.argpartition(-(q[some].astype(np.float32) @ graph.v.T), k - 1, axis=1)[:, :k]
    while beam < n:
        node, _ = graph.search(q[some], beam)
        if np.mean([np.isin(t, f).mean() for t, f in zip(truth, node, strict=True)]) >= recall:
            break
        beam *= 2
    left, right, todo = [], [], np.arange(len(q))
    while todo.size:
        again = []
        for lo in range(0, todo.size, 1024):
            part = todo[lo:lo + 1024]
            if beam >= n:
                i, x = np.nonzero(q[part].astype(np.float32) @ graph.v.T >= least - 1e-4)
                left.append(part[i])
                right.append(x)
                continue
            node, sim = graph.search(q[part], beam)
            hit = (sim >= least - 1e-4) & (node >= 0)
            more = hit.all(1)
            again.append(part[more])
            i, x = np.nonzero(hit & ~more[:, None])
            left.append(part[i])
            right.append(node[i, x])
        todo = np.concatenate(again) if again else np.empty(0, int)
        beam *= 2
    return np.concatenate(left), np.concatenate(right)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("name", kind="stable")
    return pd.DataFrame({"label": group["label"].iloc[:1], "dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1],
                         "names": [group["name"].tolist()], "graph": [Graph(_unit(group["vector"])).pack()]})


def _cell(least: float, beam: int):
    """Links of one shard's graph with one block of queries."""
    def run(index: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
        if index.empty or block.empty:
            return empty
        graph, at = Graph.unpack(index["graph"].iloc[0]), np.asarray(index["names"].iloc[0])
        block = block.sort_values(["mine", "name"], kind="stable")
        own, query = block[block["mine"]], block[~block["mine"]]
        times = own["n"].to_numpy()                 # in the order of the graph's nodes
        exact = _unit(own["vector"])
        if query.empty:
            query = own
        q = _unit(query["vector"])
        a, b = linked(graph, q, least, beam)
        name, weight = query["name"].to_numpy(), query["n"].to_numpy()
        ok = np.einsum("ij,ij->i", q[a], exact[b]) >= least
        a, b = a[ok], b[ok]
        x, y, wx, wy = name[a], at[b], weight[a], times[b]
        if query is own:
            keep = x != y
            pair = np.unique(np.stack((np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])), 1), axis=0)
            x, y, wx, wy = name[pair[:, 0]], name[pair[:, 1]], weight[pair[:, 0]], weight[pair[:, 1]]
        if not x.size:
            return empty
        count = pd.Series(np.concatenate((wy, wx))).groupby(np.concatenate((x, y))).sum()
        parent: dict = {}

        def root(z):
            while parent.setdefault(z, z) != z:
                parent[z] = z = parent[parent[z]]
            return z

        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
        return pd.DataFrame({"u": count.index, "v": [root(z) for z in count.index], "n": count.to_numpy()}).astype("int64")
    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, shard_rows: int = 1024, beam: int = 32) -> DataFrame:
    """Links and components of vectors whose labels are equal and whose cosine is ``least`` or more.

    :param vectors: ``vec_id``, ``label``, ``embedding`` (array of numbers); other columns are not read, whatever their names
    :param shard_rows: distinct vectors of a graph, on average
    :param beam: width of the first search
    :return: one row per row of ``vectors`` with ``vec_id``, ``n_links`` (other vectors linked directly),
        ``component_id`` (least ``vec_id`` reachable) and ``kept`` (``vec_id`` is the ``component_id``). A vector
        that is null, empty, zero or has a null or non-finite component, a null label and a null ``vec_id`` link with
        nothing, and so do vectors of other lengths. Repeated rows are one vector. Every link is verified in
        double precision; those found depend on the graphs, whose recall is audited while they run.
    """
    e = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) \
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))) \
        .withColumn("h1", F.when(F.col("sound"), F.xxhash64("label", e))).withColumn("h2", F.when(F.col("sound"), F.hash(e, F.lit(1))))
    keys = rows.select("vec_id", "h1", "h2")
    copies = keys.where("h1 is not null").distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("n"))
    copies = cut_lineage(copies)
    full = rows.where("sound").alias("r").join(copies.alias("c"), F.expr("r.vec_id = c.name and r.h1 = c.h1 and r.h2 = c.h2")) \
        .select("name", "n", "label", "vector", F.size("vector").alias("dim")).dropDuplicates(["name", "label"])
    shards = full.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    full = cut_lineage(full.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("name"), "shards")))
    graphs = full.groupBy("label", "dim", "shard").applyInPandas(
        _build, full.select("label", "dim", "shard").schema.simpleString()[7:-1].replace(":", " ") + ", names array<long>, graph binary")
    # Each pair of shards meets once: the graph of the lower one, the vectors of both.
    low = graphs.join(shards, ["label", "dim"]).withColumn("other", F.explode(F.expr("sequence(shard, shards - 1)"))) \
        .select("label", "dim", "shard", "other", "names", "graph")
    mine = full.withColumn("other", F.explode(F.expr("sequence(shard, shards - 1)"))).withColumn("mine", F.lit(True))
    theirs = full.withColumn("other", F.col("shard")).where("shard > 0") \
        .withColumn("shard", F.explode(F.expr("sequence(cast(0 as bigint), shard - 1)"))).withColumn("mine", F.lit(False))
    both = mine.unionByName(theirs).select("label", "dim", "shard", "other", "name", "n", "vector", "mine")
    cell = ["label", "dim", "shard", "other"]
    found = cut_lineage(low.groupBy(*cell).cogroup(both.groupBy(*cell)).applyInPandas(_cell(least, beam), "u long, v long, n long"))
    links = found.groupBy(F.col("u").alias("name")).agg(F.sum("n").alias("found"))
    group = components(found.select("u", "v"))
    named = copies.join(links, "name", "left").join(group, copies["name"] == group["node"], "left") \
        .select("h1", "h2", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "name").alias("component_id"))
    return keys.join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
