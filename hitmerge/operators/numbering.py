"""Row positions inside a group without sending the group through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 1 << 18


def number_rows(df: DataFrame, group: list[str], ord_col: str, out: str,
                lead: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Add the 0-based position by (lead..., ord) within ``group``.

    The group is split into ranges of the order column. Positions inside a range come from a
    window over that range, the offset of a range from the (small) table of range sizes, so the
    largest task holds one range whatever the size of the group."""
    lead = lead or []
    keys = group + lead + ["__chunk"]
    cut = df.withColumn("__chunk", F.floor(F.col(ord_col) / F.lit(chunk)))
    before = W.partitionBy(*group).orderBy(*lead, "__chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")) \
        .withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(ord_col)) - 1
    return cut.withColumn("__inside", inside).join(sizes, keys) \
        .withColumn(out, F.col("__offset") + F.col("__inside")) \
        .drop("__chunk", "__offset", "__inside")


def count_before(events: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """For every probe row (mark = 0) the number of counted rows (mark = 1) of its key that lie
    strictly before it on ``x``; returned as the probe rows with a column ``before``."""
    cut = events.withColumn("__chunk", F.floor(F.col("x") / F.lit(chunk)))
    part = keys + ["__chunk"]
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = cut.groupBy(*part).agg(F.sum("mark").alias("__size")) \
        .withColumn("__offset", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    running = F.sum("mark").over(
        W.partitionBy(*part).orderBy("x", "mark").rowsBetween(W.unboundedPreceding, 0))
    return cut.withColumn("__running", running).filter("mark = 0").join(sizes, part) \
        .withColumn("before", F.col("__offset") + F.col("__running")) \
        .drop("__chunk", "__offset", "__running")
