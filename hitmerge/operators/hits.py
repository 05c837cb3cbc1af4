"""Pool building: filters, ranks, per-engine cap, exact-URL merge, first-seen order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge import schemas
from hitmerge.functions.urls import url_class
from hitmerge.operators.numbering import number_rows


def union_engines(*lists: DataFrame) -> DataFrame:
    """All engines' rows as one table."""
    return reduce(lambda a, b: a.unionByName(b), lists)


def drop_blank_urls(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("url") != "")


def drop_media_and_transit(raw: DataFrame) -> DataFrame:
    """The only rule that removes rows by the shape of their URL."""
    return raw.filter(~url_class(F.col("url")).isin("media", "transit"))


def only_web_links(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("url").rlike("^https?://"))


def with_rank(raw: DataFrame) -> DataFrame:
    """Rank of the engine, or the index in its whole list plus one when it gives none."""
    return raw.withColumn("rank", F.when(
        F.coalesce(F.col("rank"), F.lit(0)) <= 0, F.col("ord") + 1).otherwise(F.col("rank")))


def cap_per_engine(raw: DataFrame, cap: int = fv.PER_ENGINE_CAP) -> DataFrame:
    """First rows of each engine's list; the filter becomes a group limit before the shuffle."""
    nth = F.row_number().over(W.partitionBy("query_id", "engine").orderBy("ord"))
    return raw.withColumn("__nth", nth).filter(F.col("__nth") <= cap).drop("__nth")


def requested_limit(limit: Column, engine: Column) -> Column:
    """A wished number of rows as the engine will accept it."""
    wish = F.greatest(limit, F.lit(1))
    caps = [(e, n) for e, n in fv.ENGINE_LIMITS.items() if n is not None]
    out = F.when(engine == caps[0][0], F.least(wish, F.lit(caps[0][1])))
    for name, most in caps[1:]:
        out = out.when(engine == name, F.least(wish, F.lit(most)))
    return out.otherwise(wish)


# ---- merging -------------------------------------------------------------------------------
def longest(value: str, order: list[str]) -> Column:
    """Longest text in bytes; the first one wins ties."""
    c = F.col(value)
    return F.min_by(c, F.struct((-F.octet_length(c)).alias("bytes"), *order))


def first_non_empty(value: Column, order: list[str]) -> Column:
    """First non-empty text in order, NULL when there is none."""
    return F.min_by(F.when(value != "", value),
                    F.when(value != "", F.struct(*order)))


def merged_signal_columns(signals: str, order: list[str]) -> list[Column]:
    """Numbers take the largest (at least 0), texts the first non-empty one."""
    s = F.col(signals)
    return [F.max(F.greatest(s[n], F.lit(0.0))).alias("__s_" + n) for n in schemas.SIGNAL_NUMBERS] + \
           [first_non_empty(s[n], order).alias("__s_" + n) for n in schemas.SIGNAL_STRINGS]


def pack_signals(df: DataFrame, out: str = "signals") -> DataFrame:
    """Signal columns as one struct, NULL when every field is empty."""
    parts = {n: F.col("__s_" + n) for n in schemas.SIGNAL_FIELDS}
    number = {n: F.when(parts[n] > 0, parts[n]) for n in schemas.SIGNAL_NUMBERS}
    fields = {**parts, **number}
    packed = F.struct(*[fields[n].alias(n) for n in schemas.SIGNAL_FIELDS])
    some = reduce(lambda a, b: a | b, [fields[n].isNotNull() for n in schemas.SIGNAL_FIELDS])
    return df.withColumn(out, F.when(some, packed)).drop(*["__s_" + n for n in schemas.SIGNAL_FIELDS])


def exact_merge(raw: DataFrame) -> DataFrame:
    """One row per (query, URL): sorted engines, best rank per engine, longest texts, first date,
    merged signals, and the place (engine, ord) where the URL was first seen.

    Two levels: first per engine, which also combines on the map side, so the collections of the
    second level hold at most one entry per engine however often a URL repeats."""
    raw = with_rank(drop_blank_urls(raw))
    per_engine = raw.groupBy("query_id", "url", "engine").agg(
        F.min("rank").alias("rank"), F.min("ord").alias("ord"),
        longest("title", ["ord"]).alias("title"), longest("snippet", ["ord"]).alias("snippet"),
        first_non_empty(F.col("date"), ["ord"]).alias("date"),
        *merged_signal_columns("signals", ["ord"]))
    per_engine = pack_signals(per_engine)
    seen = ["engine", "ord"]
    merged = per_engine.groupBy("query_id", "url").agg(
        F.array_sort(F.collect_set("engine")).alias("engines"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "rank")))).alias("positions"),
        longest("title", ["engine"]).alias("title"),
        longest("snippet", ["engine"]).alias("snippet"),
        first_non_empty(F.col("date"), seen).alias("date"),
        F.min(F.struct(*seen)).alias("first_seen"),
        *merged_signal_columns("signals", seen))
    return pack_signals(merged).withColumnRenamed("engines", "engine")


def pool_order(hits: DataFrame) -> DataFrame:
    """Add hit_ord: engine name ascending, then list order of the first sighting."""
    flat = hits.withColumns({"__lead": F.col("first_seen.engine"), "__ord": F.col("first_seen.ord")})
    return number_rows(flat, ["query_id"], "__ord", "hit_ord", lead=["__lead"]) \
        .drop("__lead", "__ord", "first_seen")


def pool(raw: DataFrame) -> DataFrame:
    return pool_order(exact_merge(raw))
