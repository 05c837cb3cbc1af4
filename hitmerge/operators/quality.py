"""Engine quality over judged lists: judged(engine, keyword_id, rank, ad, off, bad).

Everything starts from one row per (engine, keyword, label) with the list length, the number of bad
rows, the bad rows in the first K and the sum of bad ranks; every metric is a formula over that
small table. Standard errors use the sample deviation over keywords divided by sqrt(keywords)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LABELS = ["ad", "off", "bad"]
DIGITS = 6
KEY = ["engine", "label"]


def _six(c: Column) -> Column:
    return F.round(c, DIGITS)


def with_precedence(judged: DataFrame) -> DataFrame:
    """Off-topic hides advertising; invalid is independent of both."""
    return judged.withColumn("ad", F.col("ad") & ~F.col("off"))


def list_lengths(judged: DataFrame) -> DataFrame:
    return judged.groupBy("engine", "keyword_id").agg(F.count(F.lit(1)).alias("n"))


def cells(judged: DataFrame, k: int = 15) -> DataFrame:
    """engine, keyword_id, label, n, bad (rows), top (bad rows of rank <= k), ranks (sum of ranks)."""
    def measure(label: str) -> list[Column]:
        c = F.col(label)
        return [F.count_if(c).alias(label + "_bad"), F.count_if(c & (F.col("rank") <= k)).alias(label + "_top"),
                F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0)).alias(label + "_ranks")]

    wide = with_precedence(judged).groupBy("engine", "keyword_id").agg(
        F.count(F.lit(1)).alias("n"), *[m for label in LABELS for m in measure(label)])
    parts = F.array(*[F.struct(
        F.lit(label).alias("label"), F.col(label + "_bad").alias("bad"), F.col(label + "_top").alias("top"),
        F.col(label + "_ranks").alias("ranks")) for label in LABELS])
    return wide.select("engine", "keyword_id", "n", F.explode(parts).alias("p")) \
        .select("engine", "keyword_id", "n", "p.*")


# ---- rates of one cell ---------------------------------------------------------------------
def _rate() -> Column:
    return F.col("bad") / F.col("n")


def _top_rate(k: int) -> Column:
    return F.col("top") / F.least(F.col("n"), F.lit(k))


def _weight_sum(scale: Column) -> Column:
    return (scale + 1) * F.col("bad") - F.col("ranks")


def _weighted(scale: Column) -> Column:
    return _weight_sum(scale) / (scale * (scale + 1) / 2)


def _mean(judged: DataFrame, value: Column, name: str, k: int = 15) -> DataFrame:
    """Keywords count alike, whatever the length of their lists."""
    return cells(judged, k).groupBy(*KEY).agg(_six(F.avg(value)).alias(name))


def overall_rate(judged: DataFrame) -> DataFrame:
    return _mean(judged, _rate(), "overall")


def topk_rate(judged: DataFrame, k: int = 15) -> DataFrame:
    return _mean(judged, _top_rate(k), f"top{k}", k)


def rank_weighted_rate(judged: DataFrame) -> DataFrame:
    """Weights N..1 on the list's own scale."""
    return _mean(judged, _weighted(F.col("n")), "weighted")


def fixed_scale_rate(judged: DataFrame, rows: int = 20) -> DataFrame:
    """The same weights on one scale of ``rows`` ranks for every list."""
    return _mean(judged, _weighted(F.lit(rows)), "fixed")


def cap_scale_rate(judged: DataFrame, caps: DataFrame) -> DataFrame:
    """Weights on the scale of the engine's own limit: caps(engine, cap)."""
    return cells(judged).join(caps, "engine").groupBy(*KEY).agg(
        _six(F.avg(_weighted(F.col("cap")))).alias("capped"))


def pooled_rate(judged: DataFrame) -> DataFrame:
    """All keywords as one list; long lists dominate."""
    return cells(judged).groupBy(*KEY).agg(_six(
        F.sum(_weight_sum(F.col("n"))) / F.sum(F.col("n") * (F.col("n") + 1) / 2)).alias("pooled"))


def metric_table(judged: DataFrame, caps: DataFrame, k: int = 15, rows: int = 20) -> DataFrame:
    """Every variant side by side, from one pass over the judged rows."""
    n = F.col("n")
    return cells(judged, k).join(caps, "engine").groupBy(*KEY).agg(
        _six(F.avg(_rate())).alias("overall"), _six(F.avg(_top_rate(k))).alias(f"top{k}"),
        _six(F.avg(_weighted(n))).alias("weighted"), _six(F.avg(_weighted(F.lit(rows)))).alias("fixed"),
        _six(F.avg(_weighted(F.col("cap")))).alias("capped"),
        _six(F.sum(_weight_sum(n)) / F.sum(n * (n + 1) / 2)).alias("pooled"))


# ---- can the metric tell engines apart? ----------------------------------------------------
def _spread(judged: DataFrame) -> DataFrame:
    return cells(judged).groupBy(*KEY).agg(
        F.avg(_rate()).alias("rate"), (F.stddev_samp(_rate()) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def noise_floor(judged: DataFrame) -> DataFrame:
    """Per label: median standard error, twice that, the range between engines and the verdict."""
    return _spread(judged).groupBy("label").agg(
        F.median("se").alias("se"), (F.max("rate") - F.min("rate")).alias("range")).select(
        "label", _six(F.col("se")).alias("median_se"), _six(2 * F.col("se")).alias("two_se"),
        _six(F.col("range")).alias("engine_range"),
        (F.col("range") > 2 * F.col("se")).alias("separable"))


def _two_metrics(judged: DataFrame, second: Column, k: int = 15) -> DataFrame:
    return cells(judged, k).groupBy(*KEY).agg(
        _six(F.avg(_rate())).alias("x"), _six(F.avg(second)).alias("y"))


def flip_audit(judged: DataFrame, k: int = 15) -> DataFrame:
    """Engine pairs that the overall rate and the Top-K rate put in opposite order; such a flip
    means something only when the gap exceeds twice the standard error."""
    m = _two_metrics(judged, _top_rate(k), k)
    a = m.select("label", F.col("engine").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = m.select("label", F.col("engine").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    gap = _six(F.abs(F.col("xa") - F.col("xb")))
    return a.join(b, "label").filter("a < b") \
        .filter(F.signum(F.col("xa") - F.col("xb")) * F.signum(F.col("ya") - F.col("yb")) < 0) \
        .join(noise_floor(judged).select("label", "two_se"), "label") \
        .select("label", "a", "b", gap.alias("gap"), (gap > F.col("two_se")).alias("significant"))


def _average_rank(value: str) -> Column:
    same = F.count(F.lit(1)).over(W.partitionBy("label", value))
    return F.rank().over(W.partitionBy("label").orderBy(value)) + (same - 1) / 2


def spearman(judged: DataFrame, k: int = 15) -> DataFrame:
    """Rank correlation of the overall rate with the Top-K rate and with the weighted rate."""
    m = cells(judged, k).groupBy(*KEY).agg(
        _six(F.avg(_rate())).alias("x"), _six(F.avg(_top_rate(k))).alias("y"),
        _six(F.avg(_weighted(F.col("n")))).alias("z"))
    ranked = m.select("label", _average_rank("x").alias("rx"), _average_rank("y").alias("ry"),
                      _average_rank("z").alias("rz"))
    return ranked.groupBy("label").agg(
        _six(F.corr("rx", "ry")).alias(f"top{k}_rho"), _six(F.corr("rx", "rz")).alias("weighted_rho"))


def variance_split(judged: DataFrame) -> DataFrame:
    """Two-way split of the squared deviations of the cell rates: share explained by the keyword,
    by the engine, and the residual; main effects from marginal means of the cells present.
    Where cells are missing the two overlap: see ``fitted_variance_split``."""
    c = cells(judged).select(*KEY, "keyword_id", _rate().alias("v"))
    grand = c.groupBy("label").agg(F.avg("v").alias("m"))

    def between(by: str, name: str) -> DataFrame:
        means = c.groupBy("label", by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
        return means.join(grand, "label").groupBy("label").agg(
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("m"), F.lit(2.0))).alias(name))

    total = c.join(grand, "label").groupBy("label").agg(
        F.sum(F.pow(F.col("v") - F.col("m"), F.lit(2.0))).alias("total"))
    s = total.join(between("keyword_id", "k"), "label").join(between("engine", "e"), "label")
    share = lambda x: _six(F.when(F.col("total") > 0, x / F.col("total")))
    return s.select("label", share(F.col("k")).alias("keyword_share"), share(F.col("e")).alias("engine_share"),
                    share(F.col("total") - F.col("k") - F.col("e")).alias("residual_share"))


def _engines_after_keywords(sums: pd.DataFrame) -> pd.DataFrame:
    """Squares that engine effects explain beyond keyword means, from the reduced normal equations of one label."""
    engines = sorted(set(sums["a"]))
    at = {e: i for i, e in enumerate(engines)}
    left, right = np.zeros((len(engines), len(engines))), np.zeros(len(engines))
    np.add.at(left, (sums["a"].map(at), sums["b"].map(at)), sums["x"])
    np.add.at(right, sums["a"].map(at), sums["y"])
    # Engines without a keyword in common leave the equations singular; any solution explains the same.
    more = float(right @ np.linalg.lstsq(left, right, rcond=1e-10)[0])
    return pd.DataFrame({"label": sums["label"].iloc[:1], "more": [max(more, 0.0)]})


def fitted_variance_split(judged: DataFrame) -> DataFrame:
    """Two-way split of the squared deviations of the cell rates: share explained by the keyword, by the engine, and
    the residual of the additive least-squares fit.

    Cells may be missing (an engine without an answer in a round). Keyword and engine then overlap, and each gets the mean of
    what it explains alone and what it explains beyond the other, so shares are never negative and sum to 1; on a full
    grid both are the same. Keywords are eliminated by grouping; what is solved per label has one equation per engine."""
    c = cells(judged).select(*KEY, "keyword_id", _rate().alias("v"))
    by_keyword = c.groupBy("label", "keyword_id").agg(F.count(F.lit(1)).alias("size"), F.avg("v").alias("mean"))
    grand = c.groupBy("label").agg(F.avg("v").alias("m"))

    def between(by: str, name: str) -> DataFrame:
        means = c.groupBy("label", by).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
        return means.join(grand, "label").groupBy("label").agg(
            F.sum(F.col("n") * F.pow(F.col("mean") - F.col("m"), F.lit(2.0))).alias(name))

    lined = c.join(by_keyword, ["label", "keyword_id"])
    own = lined.select("label", F.col("engine").alias("a"), F.col("engine").alias("b"), F.lit(1.0).alias("x"), (F.col("v") - F.col("mean")).alias("y"))
    # A keyword has a cell per engine at most, so its pairs are as few as pairs of engines.
    pairs = lined.select("label", "keyword_id", F.col("engine").alias("a"), "size").join(
        c.select("label", "keyword_id", F.col("engine").alias("b")), ["label", "keyword_id"]) \
        .select("label", "a", "b", (-1 / F.col("size")).alias("x"), F.lit(0.0).alias("y"))
    sums = own.unionByName(pairs).groupBy("label", "a", "b").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    more = sums.groupBy("label").applyInPandas(_engines_after_keywords, "label string, more double")
    total = c.join(grand, "label").groupBy("label").agg(
        F.sum(F.pow(F.col("v") - F.col("m"), F.lit(2.0))).alias("total"))
    s = total.join(between("keyword_id", "k"), "label").join(between("engine", "e"), "label").join(more, "label")
    share = lambda x: _six(F.when(F.col("total") > 0, F.greatest(x / F.col("total"), F.lit(0.0))))
    return s.select("label", share(F.col("k") + (F.col("more") - F.col("e")) / 2).alias("keyword_share"),
                    share((F.col("e") + F.col("more")) / 2).alias("engine_share"),
                    share(F.col("total") - F.col("k") - F.col("more")).alias("residual_share"))


def range_ratio(judged: DataFrame) -> DataFrame:
    """Range of the keyword means against the range of the engine means."""
    c = cells(judged).select(*KEY, "keyword_id", _rate().alias("v"))
    spread = lambda by, name: c.groupBy("label", by).agg(F.avg("v").alias("v")).groupBy("label") \
        .agg((F.max("v") - F.min("v")).alias(name))
    return spread("keyword_id", "k").join(spread("engine", "e"), "label").select(
        "label", _six(F.col("k")).alias("keyword_range"), _six(F.col("e")).alias("engine_range"),
        _six(F.when(F.col("e") > 0, F.col("k") / F.col("e"))).alias("ratio"))


def keyword_means(judged: DataFrame) -> DataFrame:
    return cells(judged).groupBy("keyword_id", "label").agg(_six(F.avg(_rate())).alias("mean_rate"))


def cell_table(judged: DataFrame) -> DataFrame:
    """Rate of every (engine, keyword) cell; collapsed marks an engine failing a whole round."""
    return cells(judged).select("engine", "keyword_id", "label", "n", _six(_rate()).alias("rate"),
                                (F.col("bad") == F.col("n")).alias("collapsed"))


# ---- rows worth a look ---------------------------------------------------------------------
def invalid_flags(rows: DataFrame, min_chars: int = 20) -> DataFrame:
    """Flags on (title, snippet), for people to review and never to delete by: empty snippet, no
    text besides the title, the same longer segment verbatim more than once."""
    bare = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")
    segments = F.filter(F.transform(F.split("snippet", r"[\n。！？.!?]+"), lambda s: F.trim(s)),
                        lambda s: F.length(s) >= min_chars)
    return rows.withColumn("__s", segments).withColumns({
        "empty_snippet": F.trim("snippet") == "",
        "title_only": bare(F.col("snippet")) == bare(F.col("title")),
        "repeated_segment": F.size("__s") > F.size(F.array_distinct("__s"))}).drop("__s")
