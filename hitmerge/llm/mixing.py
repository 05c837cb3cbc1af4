"""Mix the hits of all engines to target weights by systematic sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitmerge.llm.texts import WORD

TRIES = 32        # random offsets of an engine, of which the one whose words come nearest to the target is taken
TURN = 0.6180339887498949
SALTS = 1024      # parts of a range of sizes; bounds what one task ranks when many hits are equally long


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """Target of each engine: its weight's share of all sizes, at most ``most`` times what it has.

    :param sizes: ``engine``, ``engine_size``; one row per engine
    :param weights: weights of the engines by code point, null last, repeated in turn
    :return: ``engine``, ``engine_size``, ``target``. What an engine cannot take goes to the others by
        weight: engines fill up in the order of ``most * size / weight``. If those before an engine are full
        and the others share what is left, running sums give the level they share it at; it rises as
        long as the next engine fills up too and falls afterwards, so the highest is the true one. An
        engine of size 0 has target 0.
    """
    order = W.orderBy(F.col("engine").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    full = (F.lit(most) * F.col("engine_size")).cast("double")
    fill = W.orderBy(full / F.col("weight"), F.col("engine").asc_nulls_last())
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).partitionBy()
    level = (F.sum(F.col("engine_size")).over(everything).cast("double")
             - F.coalesce(F.sum(F.lit(most) * F.col("engine_size")).over(before), F.lit(0)).cast("double")) / F.sum("weight").over(after)
    return sizes.withColumn("weight", weight).withColumn("level", level).withColumn("level", F.max("level").over(everything)) \
        .withColumn("target", F.least(full, F.col("level") * F.col("weight"))).select("engine", "engine_size", "target")


def mix_engines(hits: DataFrame, weights: tuple = (1, 2, 3), most: int = 3, seed: int = 11, carry: tuple = ()) -> DataFrame:
    """How many copies of each hit the mix takes.

    Hits of an engine stand by steps of size, largest first, so that each step is mixed evenly; each is expected
    ``target / size of the engine`` times. The running sum of that starts at one random offset and a hit is taken once for each
    whole number it passes. Of
    ``TRIES`` offsets the one that comes nearest to the target is used. Positions come from ranges of
    size and their counts: no task holds an engine.

    :param hits: ``hit_ord``, ``engine``, ``snippet``; other columns are not read, whatever their names
    :param weights: see ``targets``
    :param most: copies of a hit, at most
    :param seed: of the offsets; reruns with it agree
    :param carry: columns of ``hits`` to return as well
    :return: one row per row of ``hits`` with ``hit_ord``, ``engine``, ``size`` (words of the snippet; null
        has 0), ``engine_size``, ``target``, ``copies`` and ``taken`` (copies * size). A null engine is an
        engine of its own. Repeated rows are hits of their own. If all texts are empty nothing is taken.
    """
    size = F.coalesce(F.regexp_count("snippet", F.lit(WORD)), F.lit(0)).cast("long")
    rows = hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), "engine", size.alias("size"), *carry) \
        .withColumn("step", F.floor(F.log2(F.col("size") + 1) * 2)) \
        .withColumn("salt", F.pmod(F.coalesce("hit_ord", F.lit(0)), F.lit(SALTS)))
    count = rows.groupBy("engine", "step", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    aim = targets(count.groupBy("engine").agg(F.sum("words").alias("engine_size")), weights, most)
    earlier = W.partitionBy("engine").orderBy(F.desc("step"), "salt").rowsBetween(W.unboundedPreceding, -1)
    offset = count.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    start = F.conv(F.substring(F.md5(F.concat(F.coalesce("engine", F.lit("")), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") / 2.0 ** 32
    aim = aim.withColumn("ratio", F.when(F.col("engine_size") > 0, F.col("target") / F.col("engine_size")).otherwise(0.0)) \
        .withColumn("start", start)
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    part = offset.join(aim, same(offset, aim, ["engine"])) \
        .select(offset["engine"], "step", "salt", "before", "engine_size", "target", "ratio", "start")
    inside = F.row_number().over(W.partitionBy("engine", "step", "salt").orderBy("hit_ord", "size"))
    ranked = rows.withColumn("inside", inside)
    found = ranked.join(part, same(ranked, part, ["engine", "step", "salt"])).select(
        "hit_ord", ranked["engine"], "size", "engine_size", "target", "ratio", "start", *carry, (F.col("before") + F.col("inside")).alias("rank"))
    def copies(k):
        offset = F.col("start") + k * TURN - F.floor(F.col("start") + k * TURN)
        passed = lambda at: F.floor(offset + at * F.col("ratio"))
        return F.least(F.lit(most), passed(F.col("rank")) - passed(F.col("rank") - 1)).cast("long")

    trial = found.groupBy("engine").agg(F.first("target").alias("aim"), *[F.sum(copies(F.lit(k)) * F.col("size")).alias(f"t{k}") for k in range(TRIES)])
    trial = trial.select("engine", F.array_min(F.array(*[
        F.struct(F.abs(F.col(f"t{k}") - F.col("aim")).alias("off"), F.lit(k).alias("k")) for k in range(TRIES)]))["k"].alias("k"))
    chosen = found.join(trial, found["engine"].eqNullSafe(trial["engine"])).drop(trial["engine"]).withColumn("copies", copies(F.col("k")))
    return chosen.withColumn("taken", F.col("copies") * F.col("size")).drop("ratio", "start", "rank", "k")
