"""Connected components of a narrow edge table, in a number of rounds that grows with the log of its diameter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmerge.session import cut_lineage, fewer_tasks

ROWS = 1 << 16  # edges that a task writes in a round, and may hold


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition as stars on the least node of each of its components."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            a, c = root(u), root(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    leaves = [(x, root(x)) for x in list(parent) if root(x) != x]
    if leaves:
        u, v = zip(*leaves, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _print(edges: DataFrame) -> tuple:
    """Number of edges and a digest of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Least reachable node of every node that has an edge.

    Each partition first contracts its own edges, then large-star and small-star rounds run until the
    edges stay the same. A node of many edges meets only its own edges, never all their pairs.

    :param edges: ``u``, ``v`` (long); direction, loops and repeated edges do not matter
    :return: ``node``, ``component``; nodes without an edge to another node are absent
    """
    e = edges.where("u <> v").select("u", "v").mapInArrow(_contract, "u long, v long")
    most = fewer_tasks(edges.sparkSession)
    e = cut_lineage(e.distinct(), most)
    seen, now = None, _print(e)
    while now[0] and now != seen:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v")))
        # Rounds never add edges, so few need few files.
        e = cut_lineage(small.distinct(), min(most, 8 + now[0] // ROWS))
        seen, now = now, _print(e)
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
