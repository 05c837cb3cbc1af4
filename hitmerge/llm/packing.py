"""Pack hits into training sequences by a grouping genetic algorithm on islands.

What decides a packing is how long the pieces are, not which they are. An island therefore holds the
counts of the lengths of its pieces, and a gene is a whole sequence: the lengths it holds and how
often it is repeated. Crossover injects well-filled sequences of one parent into the other, takes out
what is then there twice, and places the displaced lengths by best fit. After each epoch every island
hands its best sequences to the next island. Pieces then take the places of their length."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitmerge.llm.texts import by_bytes, small
from hitmerge.llm.tokens import encode, encoder
from hitmerge.session import cut_lineage, fewer_tasks

ISLAND_ROWS = 4096     # pieces on an island; an island has fewer than 2^14 sequences, and so sequence ids are unique
LOOSE = 16             # badly filled sequences of an island that meet those of other islands


def _best_fit(counts: np.ndarray, room: Counter | None = None) -> Counter:
    """Sequences (sorted tuples of lengths -> times) that hold all of ``counts``; longest first, each
    into the fullest sequence that has room. Equal sequences are filled together."""
    capacity = counts.size - 1
    open_: list[dict] = [{} for _ in range(capacity + 1)]       # by free room: sequence -> times
    for seq, n in (room or {}).items():
        open_[capacity - sum(seq)][seq] = open_[capacity - sum(seq)].get(seq, 0) + n
    free = np.array([bool(x) for x in open_])
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fits = np.flatnonzero(free[length:])
            if fits.size:
                r = length + int(fits[0])
                seq, n = next(iter(open_[r].items()))
                each, take = 1, min(left, n)
                del open_[r][seq]
                if n > take:
                    open_[r][seq] = n - take
                free[r] = bool(open_[r])
            else:
                each = min(capacity // length, left)
                seq, take, r = (), left // each, capacity
            new = seq + (length,) * each
            at = r - length * each
            open_[at][new] = open_[at].get(new, 0) + take
            free[at] = True
            left -= take * each
    out: Counter = Counter()
    for held in open_:
        for seq, n in held.items():
            out[tuple(sorted(seq, reverse=True))] += n
    return out


def _fitness(genes: Counter, capacity: int) -> tuple:
    """Fewer sequences first, then unevenly filled ones: a full and an empty one beat two half full."""
    return sum(genes.values()), -sum(n * (sum(s) / capacity) ** 2 for s, n in genes.items())


def _cross(mother: Counter, injected: list[tuple], counts: np.ndarray) -> Counter:
    """Inject sequences as often as the lengths last, keep what the rest still affords, best-fit the remainder."""
    left, kept = counts.copy(), Counter()
    for source in (injected, sorted(mother.items(), key=lambda x: -sum(x[0]))):
        for seq, n in source:
            need = Counter(seq)
            times = min([n, *(int(left[x]) // k for x, k in need.items())])
            if times > 0:
                kept[seq] += times
                for x, k in need.items():
                    left[x] -= k * times
    return _best_fit(left, kept)


def _evolve(counts: np.ndarray, prior: Counter, guests: list[tuple], seed: int, population: int, generations: int) -> Counter:
    capacity = counts.size - 1
    least = -(-int((counts * np.arange(counts.size)).sum()) // capacity)
    rng = np.random.default_rng(seed)
    rank = lambda g: _fitness(g, capacity)
    herd = [prior or _best_fit(counts)]
    if guests and rank(herd[0])[0] > least:
        herd.append(_cross(herd[0], guests, counts))
    while len(herd) < population and rank(min(herd, key=rank))[0] > least:
        seqs = list(herd[0].items())
        herd.append(_cross(Counter(), [seqs[i] for i in rng.permutation(len(seqs))[:len(seqs) // 2]], counts))
    for _ in range(generations):
        herd.sort(key=rank)
        if rank(herd[0])[0] <= least or len(herd) < 2:
            break
        a, b = rng.choice(len(herd), 2, replace=False)
        well = [x for x in herd[b].items() if sum(x[0]) >= capacity - 2]
        child = _cross(herd[a], [well[i] for i in rng.permutation(len(well))[:-(-len(well) // 2)]], counts)
        if rank(child) < rank(herd[-1]):
            herd[-1] = child
    return min(herd, key=rank)


def _cut(vocabulary, pattern, special, end, capacity, batch_bytes, piece_chars):
    """Pieces of each snippet: where its ids are cut, and the CRC of the ids of each piece."""
    def run(batches):
        enc = encoder(vocabulary, pattern, special)
        for b in small(batches):
            keys, at = b.column("hit_ord").to_pylist(), 0
            out: list = [[], [], [], [], []]
            for part in by_bytes(b.column("snippet"), batch_bytes):
                for text in part:
                    ids = np.array([*encode(text, enc, piece_chars), end], "<u4")
                    first = ids.size % capacity or capacity
                    begin = 0
                    for i, stop in enumerate(range(first, ids.size + 1, capacity)):
                        for column, v in zip(out, (keys[at], i, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())), strict=True):
                            column.append(v)
                        begin = stop
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])],
                ["hit_ord", "piece", "start", "length", "ids_crc32"])
    return run


def _island(capacity, seed, population, generations):
    """Sequences of an island after an epoch. Its worst filled ones, ``LOOSE`` at most, are marked."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        island = int(group["island"].iloc[0])
        own = group[group["kind"] == "own"]
        counts = np.zeros(capacity + 1, np.int64)
        counts[own["length"].to_numpy().astype(np.int64)] = own["n"].to_numpy()
        held = {}
        for kind in ("prior", "guest"):
            rows = group[group["kind"] == kind]
            held[kind] = [(tuple(np.frombuffer(s, np.int32).tolist()), int(n)) for s, n in zip(rows["genes"], rows["n"], strict=True)]
        prior: Counter = Counter()
        for seq, n in held["prior"]:
            prior[seq] += n
        best = _evolve(counts, prior, sorted(held["guest"]), seed + island, population, generations) if len(own) else Counter()
        rows, loose = [], LOOSE
        for seq, n in sorted(best.items(), key=lambda x: (sum(x[0]), x[0])):
            free = min(n, loose) if sum(seq) < capacity - 1 else 0
            loose -= free
            rows += [(np.array(seq, np.int32).tobytes(), k, sum(seq), k == free and mark) for k, mark in ((free, True), (n - free, False)) if k]
        out = pd.DataFrame(rows, columns=["genes", "n", "filled", "loose"])
        out.insert(0, "gene", np.arange(len(rows)))
        out.insert(0, "island", island)
        return out.astype({"loose": bool})
    return run


_GENES = "island long, gene long, genes binary, n long, filled long, loose boolean"


def _genes(lengths: DataFrame, prior: DataFrame | None = None, guests: DataFrame | None = None, **how) -> DataFrame:
    rows = lengths.select("island", F.lit("own").alias("kind"), "length", "n", F.lit(None).cast("binary").alias("genes"))
    for kind, more in (("prior", prior), ("guest", guests)):
        if more is not None:
            rows = rows.unionByName(more.select("island", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("length"), "n", "genes"))
    return cut_lineage(rows.groupBy("island").applyInPandas(_island(**how), _GENES), fewer_tasks(rows.sparkSession))


def _places(capacity):
    """Every place of every sequence of an island: (sequence, length, offset), numbered within its length."""
    def run(batches):
        for b in batches:
            rows: list = []
            for island, gene, genes, n in zip(b["island"], b["gene"], b["genes"], b["n"], strict=True):
                lengths = np.frombuffer(genes, np.int32).astype(np.int64)
                offset = np.cumsum(lengths) - lengths
                copy = np.repeat(np.arange(n), lengths.size)
                rows.append(pd.DataFrame({"island": island, "gene": gene, "copy": copy, "length": np.tile(lengths, n), "offset": np.tile(offset, n)}))
            if rows:
                yield pd.concat(rows)
    return run


_PLACES = "island long, gene long, copy long, length long, offset long"


def pack_hits(hits: DataFrame, vocabulary: str, pattern: str, special: tuple = (), end: int = 2, capacity: int = 1024,
              island_rows: int = ISLAND_ROWS, epochs: int = 2, population: int = 4, generations: int = 6, seed: int = 5,
              batch_bytes: int = 1 << 20, piece_chars: int = 1 << 16) -> DataFrame:
    """Pack all snippets into few sequences of at most ``capacity`` tokens.

    A snippet is its ids and then ``end``. Only one longer than ``capacity`` is cut: into full pieces,
    and what is left over is its first piece. Full pieces are sequences of their own. The others are
    dealt to islands; what an island fills badly meets again on fewer, joint islands until one
    holds all that is left (it then holds a sequence per island at most).

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names
    :param vocabulary, pattern, special, batch_bytes, piece_chars: see ``count_tokens``
    :param island_rows: pieces on an island, on average
    :param epochs: of evolution; between them each island sends its best sequences to the next one
    :return: one row per piece with ``hit_ord``, ``piece``, ``start``, ``length``, ``ids_crc32``,
        ``sequence_id`` and ``offset``. A null or empty snippet is one piece of the end token. Repeated
        rows are packed each for itself; a row without ``hit_ord`` is packed as well.
    """
    spark = hits.sparkSession
    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), "snippet")
    cut = rows.mapInArrow(_cut(vocabulary, pattern, tuple(special), end, capacity, batch_bytes, piece_chars),
                          "hit_ord long, piece int, start long, length long, ids_crc32 long")
    # A number for each piece that does not depend on hit_ord being there or unique.
    cut = cut_lineage(cut.withColumn("id", F.monotonically_increasing_id()))
    whole = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.col("id") * 2).withColumn("offset", F.lit(0).cast("long"))
    part = cut.where(F.col("length") < capacity)
    islands = max(1, -(-part.count() // island_rows))
    part = part.withColumn("island", F.pmod(F.xxhash64("id"), F.lit(islands)))
    how = {"capacity": capacity, "seed": seed, "population": population, "generations": generations}
    lengths = cut_lineage(part.groupBy("island", "length").agg(F.count(F.lit(1)).alias("n")), fewer_tasks(part.sparkSession))
    genes = _genes(lengths, **how)
    for _ in range(epochs - 1):
        elite = genes.where(F.col("filled") >= capacity - 1).withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
        genes = _genes(lengths, genes, elite, **how)
    # The worst filled sequences are undone and packed again with those of other islands.
    settled, width, level = genes, islands, 0
    while width > 1:
        width, level = -(-width // 16), level + 1
        loose = genes.where("loose").mapInPandas(_places(capacity), _PLACES) \
            .groupBy(F.pmod("island", F.lit(width)).alias("island"), "length").agg(F.count(F.lit(1)).alias("n"))
        genes = _genes(cut_lineage(loose, fewer_tasks(loose.sparkSession)), **how).withColumn("gene", F.col("gene") + (level << 16))
        settled = settled.where("not loose").unionByName(genes)
    seat = settled.mapInPandas(_places(capacity), _PLACES).withColumn(
        "sequence_id", F.shiftleft(F.shiftleft(F.shiftleft("island", 19) + F.col("gene"), 14) + F.col("copy"), 1) + 1)
    # Pieces and places of one length are numbered in parts, so that no task holds all of a length.
    return _seated(part.drop("island"), seat.select("length", "offset", "sequence_id")).unionByName(
        whole.select("hit_ord", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))


def _numbered(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``rank`` of each row among those of its length; counted by parts of the length."""
    df = cut_lineage(df.withColumn("bin", F.pmod(F.xxhash64(key), F.lit(parts))), fewer_tasks(df.sparkSession))
    count = df.groupBy("length", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = count.select("length", "bin", F.coalesce(F.sum("n").over(
        W.partitionBy("length").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = df.withColumn("rank", F.row_number().over(W.partitionBy("length", "bin").orderBy(key, *[c for c in df.columns if c == "offset"])))
    return inside.join(before, ["length", "bin"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bin", "before")


def _seated(pieces: DataFrame, seats: DataFrame, parts: int = 64) -> DataFrame:
    a, b = _numbered(pieces, "id", parts), _numbered(seats, "sequence_id", parts)
    return a.join(b, ["length", "rank"]).select("hit_ord", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
