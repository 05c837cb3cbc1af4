"""Conservative near-duplicate merge of result pools.

Two rows are one page when their canonical URLs are equal, or when they share the comparison
title or the comparison snippet, live on the same site under the same first path segment, and pass
the similarity tests. Walking the rows in pool order, a row is absorbed by the first *surviving*
row before it that it matches; this is not the connected component of the match graph.

How it scales. Matches only exist inside buckets: (query, canonical URL), and (query, site, first
segment, title) or (..., snippet); all of them stay inside one (query, site).

* Buckets of few rows list their pairs of row ids; features are attached to each pair once.
* A site with a larger bucket first takes the first few undecided rows of every bucket as leaders and
  compares only those with the rest, so copies collapse onto their first row at linear cost. What
  is left then meets in buckets of rare shingles, which is exact: two sets with Jaccard >= t share
  at least o = ceil(t / (1 + t) * (|x| + |y|)) elements and one of the |x| - o + 1 rarest of x.
* Texts meet as parity sketches: two sketches differ in no more bits than the texts in 3-grams. Sketches of one
  title are compared block by block; texts are read only for pairs whose sketches are close enough.
* The pool is asked for texts once: those of rows that share host, section, title and a number with a row of another
  text, as only such pairs depend on them. All rounds read these and their sketches.
* Rows with different numbers are vetoed, so title and snippet buckets are cut by number.
* Accepted matches are a narrow table of (query, i, j, reason). A site's matches are folded in order in one
  task, or those of each connected component of them where a site has very many; a component
  beyond that is settled in rounds over its matches, as many as it takes.

Sizes choose how the rows are compared; the result is that of the plain walk.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.text import (
    norm_text, norm_title, number_overlap, number_set, shingles, text_jaccard,
)
from hitmerge.functions.urls import registrable_site, with_url_columns
from hitmerge.operators.components import components
from hitmerge.operators.hits import first_non_empty, longest, merged_signal_columns, pack_signals
from hitmerge.operators.numbering import count_before
from hitmerge.session import cut_lineage

HOT_BUCKET = 64       # rows of a bucket beyond which its copies are folded onto leading rows first
LEADERS = 16          # leading rows of a bucket
FOLD_ROUNDS = 3       # of leading rows
FOLD_EDGES = 1 << 20  # matches that one task folds
SKETCH_BITS = 1 << 12 # of a text
BLOCK = 512           # sketches of one title that meet those of another block in one task

Q, POS = "query_id", "pos"
MODE = "conservative"


class DedupResult(NamedTuple):
    """hits: the surviving rows; absorbed: one row per merged-away URL; owners: its row ids."""
    hits: DataFrame
    absorbed: DataFrame
    owners: DataFrame


# ---- row features --------------------------------------------------------------------------
def features(hits: DataFrame, mode: str = "default") -> DataFrame:
    """Everything the decision needs, one narrow row per hit; the snippet only as a digest."""
    snippet = norm_text(F.coalesce(F.col("snippet"), F.lit("")))
    base = with_url_columns(
        hits.select(Q, F.col("hit_ord").alias(POS), "url", "title", snippet.alias("snip")), mode=mode)
    return base.select(
        Q, POS, "url", "norm_url", "host", "site", "head_key",
        norm_title(F.col("title")).alias("tkey"), norm_text(F.col("title")).alias("ttext"),
        F.when(F.col("snip") == "", "").otherwise(F.md5(F.col("snip"))).alias("shash"),
        number_set(F.col("url"), F.col("title")).alias("nums"),
        # Same for all rows that can match: equal canonical URLs start with the same host.
        registrable_site(F.regexp_extract("norm_url", "^([^/?:]*)", 1)).alias("grp"))


def snippet_texts(hits: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """query_id, pos, snip of the wanted (query_id, pos), or of all rows; only these are normalised."""
    if wanted is not None:
        hits = hits.join(wanted.select(Q, F.col(POS).alias("hit_ord")), [Q, "hit_ord"], "left_semi")
    return hits.select(Q, F.col("hit_ord").alias(POS),
                       norm_text(F.coalesce(F.col("snippet"), F.lit(""))).alias("snip"))


def _placed() -> Column:
    return (F.col("host") != "") & (F.col("head_key") != "")


def _numbers() -> Column:
    """The numbers of a row, one empty text if it has none: two rows without a common one are vetoed."""
    return F.when(F.size("nums") > 0, F.col("nums")).otherwise(F.array(F.lit("")))


def _buckets() -> Column:
    """Bucket ids of a row. Hash collisions cost a comparison, never a wrong merge: the decision
    checks the keys themselves."""
    none = F.array().cast("array<bigint>")

    def by_number(kind: str, key: str) -> Column:
        return F.when(_placed() & (F.col(key) != ""), F.transform(_numbers(), lambda n: F.xxhash64(
            F.lit(kind), F.col("site"), F.col("head_key"), F.col(key), n))).otherwise(none)

    url = F.when(F.col("norm_url") != "", F.array(F.xxhash64(F.lit("url"), F.col("norm_url")))).otherwise(none)
    return F.concat(url, by_number("title", "tkey"), by_number("snippet", "shash"))


# ---- the decision --------------------------------------------------------------------------
def _same(a: Column, b: Column, field: str) -> Column:
    return (a[field] != "") & (a[field] == b[field])


def relation(a: Column, b: Column) -> dict[str, Column]:
    """Structural signals of two feature structs."""
    return {
        "same_url": _same(a, b, "norm_url"), "same_title": _same(a, b, "tkey"),
        "same_snippet": _same(a, b, "shash"), "host_same": _same(a, b, "host"),
        "site_same": (a["host"] != "") & (b["host"] != "") & (a["site"] == b["site"]),
        "head_same": _same(a, b, "head_key"), "num_overlap": number_overlap(a["nums"], b["nums"]),
    }


def veto(r: dict[str, Column]) -> Column:
    """First reason not to merge two rows that share a title or snippet; NULL when none."""
    return (F.when(~r["site_same"], "veto:cross_site").when(~r["head_same"], "veto:diff_section")
            .when(r["num_overlap"] < fv.NUMBERS_MIN, "veto:diff_numbers"))


def title_similarity(a: Column, b: Column) -> Column:
    return text_jaccard(a["ttext"], b["ttext"], fv.TITLE_GRAM)


@lru_cache(maxsize=4096)
def _url_grams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + fv.URL_GRAM] for i in range(max(len(text) - fv.URL_GRAM, 0) + 1))


def _url_jaccards(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        ga, gb = _url_grams(x), _url_grams(y)
        common = len(ga & gb)
        return common / (len(ga) + len(gb) - common)
    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def url_similarity(a: Column, b: Column) -> Column:
    """``text_jaccard(norm_text(a.url), norm_text(b.url), URL_GRAM)``, with the grams of an address made once, not once a pair."""
    return F.pandas_udf(_url_jaccards, "double").asNondeterministic()(norm_text(a["url"]), norm_text(b["url"]))


_NO_CHAR = 0x1FFFFF   # fills up texts shorter than a gram


@lru_cache(maxsize=256)
def _gram_ids(text: str) -> np.ndarray:
    """Distinct 3-grams of a normalised text as numbers: a code point has 21 bits, so 63 hold a gram without loss."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("int64")
    if len(c) < fv.SNIPPET_GRAM:
        c = np.append(c, [_NO_CHAR] * (fv.SNIPPET_GRAM - len(c)))
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _gram_jaccard(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    ga, gb = _gram_ids(a), _gram_ids(b)
    common = len(np.intersect1d(ga, gb, assume_unique=True))
    return common / (len(ga) + len(gb) - common)


def _snippet_jaccards(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_gram_jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _gram_lists(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _gram_ids(t) if t else [])


def gram_ids(norm: Column) -> Column:
    """``shingles(norm, 3)`` as numbers. Not pushed below joins, where it would cut the texts of all rows."""
    return F.pandas_udf(_gram_lists, "array<bigint>").asNondeterministic()(norm)


def snippet_similarity(a: Column, b: Column) -> Column:
    """``text_jaccard(a, b, SNIPPET_GRAM)`` by sorted numbers; grams as strings took some 13 ms a pair of whole documents.
    Marked as not deterministic so that a later filter does not compute it again."""
    return F.pandas_udf(_snippet_jaccards, "double").asNondeterministic()(a, b)


def _sketch(text: str) -> tuple[int, bytes]:
    """Number of 3-grams, and a bit for each of ``SKETCH_BITS`` classes of them: whether it holds an odd number."""
    if not text:
        return 0, bytes(SKETCH_BITS // 8)
    grams = _gram_ids(text)
    of = (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(of.astype(np.int64), minlength=SKETCH_BITS) & 1
    return len(grams), np.packbits(odd.astype(np.uint8)).tobytes()


def _sketches(texts: pd.Series) -> pd.DataFrame:
    made = [_sketch(t) for t in texts]
    return pd.DataFrame({"n": pd.Series([n for n, _ in made], dtype="int32"), "bits": [b for _, b in made]})


def sketch(norm: Column) -> Column:
    """struct(n, bits) of a normalised text; not pushed below joins."""
    return F.pandas_udf(_sketches, "n int, bits binary").asNondeterministic()(norm)


def _room(total, least: float):
    """Most grams in which two texts with ``total`` grams differ if their Jaccard similarity is ``least`` or more."""
    return (1 - least) / (1 + least) * total + 1e-6


def sketches_close(a: Column, b: Column, least: float) -> Column:
    """False only if the similarity of the sketched texts is below ``least``."""
    def run(na: pd.Series, xa: pd.Series, nb: pd.Series, xb: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(c), np.uint64).reshape(len(na), SKETCH_BITS // 64) for c in (xa, xb))
        total = na.to_numpy(np.int64) + nb.to_numpy(np.int64)
        return pd.Series(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= _room(total, least))
    return F.pandas_udf(run, "boolean").asNondeterministic()(a["n"], a["bits"], b["n"], b["bits"])


def _apart(a: Column, b: Column) -> Column:
    """Whether the cheap tests, each only where those before leave it open, say that two rows do not merge."""
    r = relation(a, b)
    title_ok = title_similarity(a, b) >= fv.TITLE_MIN
    return (F.when(r["same_url"], False).when(~(r["same_title"] | r["same_snippet"]), True)
            .when(veto(r).isNotNull(), True).when(~title_ok, True).otherwise(False))


def _verdict(a: Column, b: Column) -> Column:
    """url / text / url_like / none of rows that are not ``_apart``, or ask:* when the snippet texts have to decide; reads the
    similarity of their addresses as ``url_sim``."""
    r = relation(a, b)
    url_like = F.when(F.col("url_sim") >= fv.URL_MIN, "url_like").otherwise("none")
    open_snippet = r["host_same"] & (a["shash"] != "") & (b["shash"] != "")
    return (
        F.when(r["same_url"], "url")
        .when(r["host_same"] & r["same_snippet"], "text")
        .when(open_snippet, F.concat(F.lit("ask:"), url_like))
        .otherwise(url_like))


def _reason(verdict: Column) -> Column:
    """Trace of a merge from its verdict and the columns ``shared`` and ``host_same``."""
    shared = F.col("shared")
    return (
        F.when(verdict == "url", "d1:url_exact,same_url")
        .when(verdict == "text", F.concat_ws(",", shared, F.lit("same_site_path,text_high")))
        .when(verdict == "url_like", F.concat_ws(",", shared, F.lit("url+title_high"), F.when(
            F.col("host_same"), "same_host").otherwise("same_site"))))


class Texts(NamedTuple):
    """snips: query_id, pos, snip of all rows whose texts a decision can need; sketches: query_id, pos, sk of the same rows."""
    snips: DataFrame
    sketches: DataFrame


def _askable(rows: DataFrame, *keep: str) -> DataFrame:
    """(query_id, pos, scope, keep...) of the rows that share host, section, title and a number with a row of another text: no other
    pair is decided by its texts."""
    cut = _cut_scopes(rows.filter(_placed() & (F.col("tkey") != "") & (F.col("shash") != "")), "title,snippet", "site", "head_key", "tkey", "host") \
        .select(Q, POS, "scope", "shash", *keep)
    mixed = cut.groupBy("scope").agg(F.min("shash").alias("least"), F.max("shash").alias("most")).filter("least < most").select("scope")
    return cut.select(Q, POS, "scope", *keep).join(mixed, "scope", "left_semi")


def texts_of(hits: DataFrame, feats: DataFrame) -> Texts:
    """Texts and sketches of the rows of ``features`` whose texts can decide, from one reading of the pool."""
    wanted = _askable(feats).select(Q, POS).distinct()
    snips = cut_lineage(snippet_texts(hits, wanted))
    return Texts(snips, cut_lineage(snips.select(Q, POS, sketch(F.col("snip")).alias("sk"))))


def _matches(pairs: DataFrame, texts: Texts, *keep: str) -> DataFrame:
    """Accepted pairs (query_id, i, j, reason, keep...) of the joined feature structs a and b.
    Texts are read only for the pairs they decide."""
    a, b = F.col("a"), F.col("b")
    r = relation(a, b)
    judged = cut_lineage(pairs.filter(~_apart(a, b)).withColumn("url_sim", url_similarity(a, b)).select(
        Q, "i", "j", *keep, _verdict(a, b).alias("verdict"), r["host_same"].alias("host_same"),
        F.concat_ws(",", F.when(r["same_title"], "d1:title_exact"),
                    F.when(r["same_snippet"], "d1:snippet_exact")).alias("shared")) \
        .filter(F.col("verdict").isin("url", "text", "url_like") | F.startswith("verdict", F.lit("ask:"))))
    asks = judged.filter(F.startswith("verdict", F.lit("ask:")))
    settled = judged.filter(~F.startswith("verdict", F.lit("ask:")))
    if not asks.isEmpty():
        asked = cut_lineage(asks.join(texts.sketches.withColumnsRenamed({POS: "i", "sk": "ka"}), [Q, "i"]) \
            .join(texts.sketches.withColumnsRenamed({POS: "j", "sk": "kb"}), [Q, "j"]) \
            .withColumn("close", sketches_close(F.col("ka"), F.col("kb"), fv.SNIPPET_MIN)).drop("ka", "kb"))
        apart = asked.filter(~F.col("close")).withColumn("verdict", F.substring_index("verdict", ":", -1)).filter("verdict <> 'none'")
        settled = settled.unionByName(apart.select(*settled.columns))
        asks = asked.filter("close").drop("close")
        answered = asks.join(texts.snips.withColumnsRenamed({POS: "i", "snip": "sa"}), [Q, "i"]) \
            .join(texts.snips.withColumnsRenamed({POS: "j", "snip": "sb"}), [Q, "j"]) \
            .withColumn("sim", snippet_similarity(F.col("sa"), F.col("sb"))) \
            .withColumn("verdict", F.when(F.col("sim") >= fv.SNIPPET_MIN, "text")
                        .otherwise(F.substring_index("verdict", ":", -1))).filter("verdict <> 'none'")
        settled = cut_lineage(settled.unionByName(answered.select(*settled.columns)))
    return settled.select(Q, "i", "j", *keep, _reason(F.col("verdict")).alias("reason"))


# ---- survivors -----------------------------------------------------------------------------
def _pack() -> Column:
    return F.struct("url", "norm_url", "host", "site", "head_key", "tkey", "ttext", "shash", "nums")


def _only_shared_buckets(rows: DataFrame) -> DataFrame:
    """Keep the bucket ids that more than one row has, and the rows that have such a bucket."""
    narrow = rows.select(Q, POS, F.explode(_buckets()).alias("bucket"))
    shared = narrow.groupBy(Q, "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = narrow.join(shared, [Q, "bucket"], "left_semi").groupBy(Q, POS).agg(
        F.collect_set("bucket").alias("buckets"))
    return rows.join(kept, [Q, POS]).select(Q, POS, "grp", _pack().alias("f"), "buckets")


def _attached(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of row ids with the features of both rows as ``a`` and ``b``."""
    info = rows.select(Q, POS, "f")
    return pairs.join(info.withColumnsRenamed({POS: "i", "f": "a"}), [Q, "i"]) \
        .join(info.withColumnsRenamed({POS: "j", "f": "b"}), [Q, "j"])


def _listed(rows: DataFrame) -> DataFrame:
    """Every pair of rows that share a bucket: query_id, grp, i, j, and whether j is still open. Absorbed rows only
    look for an owner before the one they have."""
    entry = rows.select(Q, "grp", POS, "open", "owner", F.explode("buckets").alias("bucket"))
    left = entry.filter("open").select(Q, "grp", "bucket", F.col(POS).alias("i"))
    right = entry.select(Q, "bucket", F.col(POS).alias("j"), "open", "owner")
    return left.join(right, [Q, "bucket"]).filter("i < j and (open or i < owner)").select(Q, "grp", "i", "j", "open").distinct()


_OWNERS = f"{Q} string, {POS} bigint, owner bigint, reason string"


def _fold(edges: pd.DataFrame) -> pd.DataFrame:
    """Walk matches in (i, j) order. When a row absorbs, all rows before it are decided."""
    gone, owners = set(), {}
    edges = edges.sort_values(["i", "j", "reason"], kind="stable")
    for i, j, is_open, reason in zip(edges["i"], edges["j"], edges["open"], edges["reason"], strict=True):
        if i not in gone and j not in owners:
            owners[j] = (i, reason)
            if is_open:
                gone.add(j)
    return pd.DataFrame({Q: edges[Q].iloc[0] if len(edges) else None, POS: list(owners), "owner": [o for o, _ in owners.values()],
                         "reason": [r for _, r in owners.values()]}).astype({POS: "int64", "owner": "int64"})


def _edge_rounds(edges: DataFrame) -> DataFrame:
    """Owners by rounds over matches alone: a row that no undecided row before it matches survives and absorbs."""
    found = None
    while not edges.isEmpty():
        waiting = edges.filter("open").select(Q, F.col("j").alias("i")).distinct()
        firm = edges.select(Q, "i").distinct().join(waiting, [Q, "i"], "left_anti")
        taken = cut_lineage(edges.join(firm, [Q, "i"], "left_semi").groupBy(Q, "j").agg(
            F.min(F.struct("i", "reason")).alias("first"), F.bool_or("open").alias("was_open")))
        found = taken if found is None else found.unionByName(taken)
        left = edges.join(firm, [Q, "i"], "left_anti").join(
            taken.filter("was_open").select(Q, F.col("j").alias("i")), [Q, "i"], "left_anti")
        edges = cut_lineage(left.join(taken.select(Q, "j", "first"), [Q, "j"], "left").filter("first is null or i < first.i")
                            .withColumn("open", F.col("open") & F.col("first").isNull()).drop("first"))
    return found.groupBy(Q, F.col("j").alias(POS)).agg(F.min("first").alias("first")) \
        .select(Q, POS, "first.i", "first.reason").withColumnRenamed("i", "owner")


def _settle(edges: DataFrame, fold_edges: int) -> DataFrame:
    """query_id, pos, owner, reason from all accepted matches (query_id, grp, i, j, open, reason)."""
    many = edges.groupBy(Q, "grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold_edges) \
        .select(Q, "grp").persist(StorageLevel.MEMORY_AND_DISK)
    few = edges
    parts = []
    if not many.isEmpty():
        few = edges.join(many, [Q, "grp"], "left_anti")
        node = lambda c: F.xxhash64(Q, F.col(c))
        rest = cut_lineage(edges.join(many, [Q, "grp"], "left_semi").withColumns({"u": node("i"), "v": node("j")}))
        rest = rest.join(components(rest.select("u", "v")).withColumnRenamed("node", "u"), "u").drop("u", "v")
        large = cut_lineage(rest.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > fold_edges).select("component"))
        parts.append(rest.join(large, "component", "left_anti").groupBy(Q, "component").applyInPandas(_fold, _OWNERS))
        if not large.isEmpty():
            parts.append(_edge_rounds(cut_lineage(rest.join(large, "component", "left_semi").select(Q, "i", "j", "open", "reason"))))
    out = few.groupBy(Q, "grp").applyInPandas(_fold, _OWNERS)
    for part in parts:
        out = out.unionByName(part)
    return out


def _round(state: DataFrame, texts: Texts, leaders: int) -> DataFrame:
    """One round: leaders against their buckets, then the new status of every row; survivors leave."""
    members = state.select(Q, POS, "f", "open", "owner", F.size("buckets").alias("n_buckets"),
                           F.explode("buckets").alias("bucket"))
    place = F.row_number().over(W.partitionBy(Q, "bucket").orderBy(POS))
    lead = members.filter("open").select(
        Q, "bucket", F.col(POS).alias("i"), F.col("f").alias("a"), "n_buckets", place.alias("place")) \
        .filter(F.col("place") <= leaders)
    # Rows that lead in all their buckets: every open row before them in a bucket leads it too.
    compared = lead.groupBy(Q, "i", "n_buckets").agg(F.count(F.lit(1)).alias("n")) \
        .filter("n = n_buckets").select(Q, "i")
    rest = members.select(Q, "bucket", F.col(POS).alias("j"), F.col("f").alias("b"), "open", "owner")
    pairs = lead.join(rest, [Q, "bucket"]).filter(
        (F.col("i") < F.col("j")) & (F.col("open") | (F.col("i") < F.col("owner")))) \
        .select(Q, "i", "j", "a", "b", "open")
    matched = _matches(pairs, texts, "open")

    waiting = matched.filter("open").select(Q, F.col("j").alias("i")).distinct()
    survivors = compared.join(waiting, [Q, "i"], "left_anti")
    taken = matched.join(survivors, [Q, "i"], "left_semi").groupBy(Q, F.col("j").alias(POS)).agg(
        F.min(F.struct("i", "reason")).alias("first"))
    marks = survivors.select(Q, F.col("i").alias(POS), F.lit(True).alias("survives"))
    found, first = F.col("first").isNotNull(), F.col("first")
    better = found & (F.col("owner").isNull() | (first["i"] < F.col("owner")))
    return cut_lineage(
        state.join(marks, [Q, POS], "left").join(taken, [Q, POS], "left")
        .filter(F.col("survives").isNull())
        .select(Q, POS, "grp", "f", "buckets", (F.col("open") & ~found).alias("open"),
                F.when(better, first["i"]).otherwise(F.col("owner")).alias("owner"),
                F.when(better, first["reason"]).otherwise(F.col("reason")).alias("reason")))


def _settled(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off absorbed rows that no open row of their site could still claim; open rows
    without a bucket have no possible absorber and survive."""
    first_open = state.filter("open").groupBy(Q, "grp").agg(F.min(POS).alias("first_open"))
    tagged = state.join(first_open, [Q, "grp"], "left")
    lonely = F.size("buckets") == 0
    done = lonely | F.col("first_open").isNull() | (F.col("first_open") > F.col("owner"))
    return (tagged.filter(~F.col("open") & done).select(Q, POS, "owner", "reason"),
            tagged.filter((F.col("open") & ~lonely) | (~F.col("open") & ~done)).drop("first_open"))


def _cut_scopes(rows: DataFrame, label: str, *scope: str) -> DataFrame:
    """Rows with ``scope``, an id of their coarse bucket and one of their numbers."""
    return rows.withColumn("num", F.explode(_numbers())).withColumn("scope", F.xxhash64(F.lit(label), F.col(Q), *scope, F.col("num"))).drop("num")


def _scoped(rows: DataFrame, label: str, *scope: str) -> DataFrame:
    """``_cut_scopes`` where another row has the scope too."""
    cut = _cut_scopes(rows, label, *scope)
    shared = cut.groupBy("scope").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    return cut.join(shared, "scope", "left_semi")


def _rare(rows: DataFrame, grams: Column, least: float) -> DataFrame:
    """(query_id, pos, bucket) for the rarest shingles of each row that a partner with Jaccard >= ``least`` must share, for
    each class of sizes that a partner in its scope can have; rarity is counted inside ``scope``."""
    cut = rows.withColumn("g", grams).select(Q, POS, "scope", F.size("g").alias("n"), F.explode("g").alias("gram"))
    often = cut.groupBy(Q, "scope", "gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = cut.join(often, [Q, "scope", "gram"]).groupBy(Q, POS, "scope", "n").agg(
        F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("order")) \
        .withColumn("class", F.floor(F.log("n") / np.log(1.05)))
    ranked = cut_lineage(ranked)
    sizes = ranked.groupBy(Q, "scope", F.col("class").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    met = ranked.join(sizes, [Q, "scope"]).filter(F.greatest("n", "lo") * least <= F.least("n", "hi") + F.lit(1e-9))
    needed = F.ceil((F.col("n") + F.col("lo")) * (least / (1 + least)) - F.lit(1e-9))
    length = F.greatest(F.col("n") - needed + 1, F.lit(0)).cast("int")
    first, second = F.least("class", "other"), F.greatest("class", "other")
    return met.select(Q, POS, F.explode(F.transform(
        F.slice("order", F.lit(1), length), lambda e: F.xxhash64("scope", first, second, e["gram"]))).alias("bucket"))


def _close_pairs(least: float):
    """Pairs of a tile whose sketches are close and whose earlier row may meet the later; of two blocks only pairs between them."""
    def run(tile: pd.DataFrame) -> pd.DataFrame:
        out = []
        for scope, part in tile.groupby("scope", sort=False):
            bits = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1)
            sign = np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1
            n, pos, limit, second = (part[c].to_numpy() for c in ("n", POS, "limit", "second"))
            mine, other = np.flatnonzero(~second), np.flatnonzero(second)
            firm = limit == pos
            if other.size:
                # Only a firm row is the earlier one of a pair; of one firm and one other row it may stand on either side.
                sides = [(mine[firm[mine]], other), (mine[~firm[mine]], other[firm[other]])]
            else:
                sides = [(mine[firm[mine]], mine)]
            for x, y in sides:
                apart = (SKETCH_BITS - sign[x] @ sign[y].T) / 2
                u, v = np.nonzero(apart <= _room(n[x][:, None].astype(np.int64) + n[y][None, :], least))
                u, v = x[u], y[v]
                early, late = np.where(pos[u] < pos[v], u, v), np.where(pos[u] < pos[v], v, u)
                met = firm[early] & (pos[early] < limit[late])
                if not other.size:
                    met &= pos[u] < pos[v]
                out.append(pd.DataFrame({"scope": scope, "i": pos[early[met]], "j": pos[late[met]]}))
        return pd.concat(out).astype("int64")
    return run


def _similar_texts(rows: DataFrame, least: float) -> DataFrame:
    """(query_id, pos, bucket) with a bucket for each pair of rows (query_id, pos, scope, snip) of a scope whose texts can have
    Jaccard >= ``least``."""
    return _similar_sketches(rows.select(Q, POS, F.col(POS).alias("limit"), "scope", sketch(F.col("snip")).alias("sk")), least)


def _similar_sketches(rows: DataFrame, least: float) -> DataFrame:
    """The same of rows (query_id, pos, limit, scope, sk), for the pairs (i, j) with i before the limit of j only; rows whose limit
    is not their own place are no i. The pairs that remain are those of survivors, not all of a group of similar texts.

    Large scopes are cut into blocks of similar size that meet block by block, several small ones share a task: each tile
    holds a bounded number of sketches. The number of comparisons grows with the square of the texts of one title."""
    rows = cut_lineage(rows.select(Q, POS, "limit", "scope", "sk.*"))
    sized = rows.withColumn("step", F.floor(F.log(F.greatest("n", F.lit(1))) / -np.log(least)))
    count = rows.groupBy("scope").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > BLOCK).select("scope")
    large = sized.join(count, "scope", "left_semi")
    cuts = large.groupBy("scope", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("cuts"))
    large = large.join(cuts, ["scope", "step"]).withColumn("cut", F.pmod(F.xxhash64(POS), "cuts"))
    block = cuts.select("scope", "step", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    other = block.select("scope", F.col("step").alias("step2"), F.col("cut").alias("cut2"))
    met = block.withColumn("step2", F.explode(F.array(F.col("step"), F.col("step") + 1))).join(other, ["scope", "step2"]) \
        .filter("step < step2 or cut <= cut2").withColumn("tile", F.xxhash64("scope", "step", "cut", "step2", "cut2"))
    sides = met.select("tile", "scope", "step", "cut", F.lit(False).alias("second")).unionByName(
        met.filter("step < step2 or cut < cut2").select("tile", "scope", F.col("step2").alias("step"), F.col("cut2").alias("cut"), F.lit(True).alias("second")))
    kept = ["tile", "scope", POS, "limit", "n", "bits", "second"]
    shared = max(1, rows.count() // (4 * BLOCK))
    small = sized.join(count, "scope", "left_anti").withColumns({"tile": F.pmod(F.xxhash64("scope"), F.lit(shared)), "second": F.lit(False)})
    pairs = large.join(sides, ["scope", "step", "cut"]).select(*kept).unionByName(small.select(*kept)) \
        .groupBy("tile").applyInPandas(_close_pairs(least), "scope long, i long, j long")
    named = rows.select("scope", Q).distinct()
    return pairs.select("scope", F.xxhash64("scope", "i", "j").alias("bucket"), F.explode(F.array("i", "j")).alias(POS)) \
        .join(named, "scope").select(Q, POS, "bucket")


def _fine_buckets(flat: DataFrame, sketches: DataFrame, slack: float = 0.0) -> DataFrame:
    """(query_id, pos, bucket, by_text) of the two accept paths, with thresholds lowered by ``slack``: rows that share a
    title or snippet in one section and could pass share one of these buckets. ``flat`` has the ``limit`` of ``_visible``: survivors
    meet the rows that they can absorb or miss. ``sketches`` are those of ``_askable`` rows; rows of one text meet by their snippet."""
    flat = flat.filter(_placed())
    url_grams = shingles(norm_text(F.col("url")), fv.URL_GRAM)
    title_grams = gram_ids(F.col("ttext"))
    title_scope = ["site", "head_key", "tkey"]
    snip_scope = ["site", "head_key", "shash"]
    titled = flat.filter("tkey <> ''")
    snipped = flat.filter("shash <> ''")
    with_text = _askable(flat, "limit").join(sketches, [Q, POS])
    by_url = _rare(_scoped(titled, "title,url", *title_scope), url_grams, fv.URL_MIN - slack).unionByName(
        _rare(_scoped(snipped, "snippet,url", *snip_scope), url_grams, fv.URL_MIN - slack))
    by_text = _similar_sketches(with_text, fv.SNIPPET_MIN - slack).unionByName(
        _rare(_scoped(snipped, "snippet,title", *snip_scope, "host"), title_grams, fv.TITLE_MIN - slack))
    return by_url.withColumn("by_text", F.lit(False)).unionByName(by_text.withColumn("by_text", F.lit(True)))


def _cut_finer(state: DataFrame, sketches: DataFrame) -> DataFrame:
    """Replace title and snippet buckets by rare-shingle buckets of the two accept paths."""
    narrow = cut_lineage(_fine_buckets(state.select(Q, POS, F.coalesce("owner", POS).alias("limit"), "f.*"), sketches).select(Q, POS, "bucket").unionByName(state.filter("f.norm_url <> ''").select(
        Q, POS, F.xxhash64(F.lit("url"), F.col("f.norm_url")).alias("bucket"))))
    shared = narrow.groupBy(Q, "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    kept = narrow.join(shared, [Q, "bucket"], "left_semi").groupBy(Q, POS).agg(
        F.collect_set("bucket").alias("buckets"))
    return state.drop("buckets").join(kept, [Q, POS], "left").select(
        Q, POS, "grp", "f", F.coalesce("buckets", F.array().cast("array<bigint>")).alias("buckets"),
        "open", "owner", "reason")


def _opened(rows: DataFrame) -> DataFrame:
    return rows.select(Q, POS, "grp", "f", "buckets", F.lit(True).alias("open"),
                       F.lit(None).cast("bigint").alias("owner"), F.lit(None).cast("string").alias("reason"))


def find_owners(hits: DataFrame, mode: str = "default", hot_bucket: int = HOT_BUCKET, leaders: int = LEADERS,
                fold_rounds: int = FOLD_ROUNDS, fold_edges: int = FOLD_EDGES, feats: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """query_id, pos, owner, reason for every absorbed row. ``feats`` are stored ``features(hits, mode)``, ``texts`` are ``texts_of`` these."""
    rows = cut_lineage(_only_shared_buckets(cut_lineage(features(hits, mode)) if feats is None else feats))
    texts = texts_of(hits, rows.select(Q, POS, "f.*")) if texts is None else texts
    hot = rows.select(Q, "grp", F.explode("buckets").alias("bucket")).groupBy(Q, "grp", "bucket") \
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_bucket).select(Q, "grp").distinct() \
        .persist(StorageLevel.MEMORY_AND_DISK)
    if hot.isEmpty():
        hot.unpersist()
        pairs = _attached(_listed(_opened(rows)), rows)
        matched = _matches(pairs, texts, "grp", "open")
        out = cut_lineage(_settle(matched, fold_edges))
    else:
        state, done = _opened(rows.join(hot, [Q, "grp"], "left_semi")), []
        for _ in range(fold_rounds):
            settled, state = _settled(_round(state, texts, leaders))
            done.append(settled)
        state = cut_lineage(_cut_finer(state, texts.sketches))
        rest = _opened(rows.join(hot, [Q, "grp"], "left_anti"))
        matched = _matches(_attached(_listed(rest.unionByName(state)), rows), texts, "grp", "open")
        late = _settle(matched, fold_edges)
        # Rows absorbed by a leader keep it unless a row before it survived as well.
        held = state.filter("owner is not null").select(Q, POS, "owner", "reason").unionByName(late)
        for part in done:
            held = held.unionByName(part)
        out = cut_lineage(held.groupBy(Q, POS).agg(F.min(F.struct("owner", "reason")).alias("o")).select(Q, POS, "o.owner", "o.reason"))
        hot.unpersist()
    return out


# ---- merging -------------------------------------------------------------------------------
def absorb(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Surviving rows with the engines, best ranks, longest texts, first date and signals of the
    rows they absorbed. Rows without duplicates pass through unshuffled."""
    owned = owners.select(Q, F.col(POS).alias("hit_ord"), "owner")
    owning = owners.select(Q, F.col("owner").alias("hit_ord")).distinct().withColumn("owns", F.lit(True))
    tagged = hits.join(owned, [Q, "hit_ord"], "left").join(owning, [Q, "hit_ord"], "left")
    alone = tagged.filter(F.col("owner").isNull() & F.col("owns").isNull()).select(*hits.columns)
    group = tagged.filter(F.col("owner").isNotNull() | F.col("owns").isNotNull()) \
        .withColumn("keeper", F.coalesce("owner", "hit_ord"))
    texts = group.groupBy(Q, "keeper").agg(
        longest("title", ["hit_ord"]).alias("title"), longest("snippet", ["hit_ord"]).alias("snippet"),
        F.min_by("url", "hit_ord").alias("url"),
        first_non_empty(F.col("date"), ["hit_ord"]).alias("date"),
        *merged_signal_columns("signals", ["hit_ord"]))
    ranks = group.select(Q, "keeper", "positions", F.explode("engine").alias("e")) \
        .groupBy(Q, "keeper", "e").agg(F.min(F.try_element_at("positions", F.col("e"))).alias("rank"))
    by_engine = ranks.groupBy(Q, "keeper").agg(
        F.array_sort(F.collect_list("e")).alias("engine"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(
            F.col("rank").isNotNull(), F.struct("e", "rank"))))).alias("positions"))
    merged = pack_signals(texts).join(by_engine, [Q, "keeper"], "left") \
        .withColumn("engine", F.coalesce("engine", F.array().cast("array<string>"))) \
        .withColumn("positions", F.coalesce("positions", F.create_map().cast("map<string,bigint>"))) \
        .withColumnRenamed("keeper", "hit_ord").select(*hits.columns)
    return alone.unionByName(merged)


def absorbed_urls(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per merged-away URL with its own title, engines and the reason; the long form of
    the survivor's ``merged_from`` map, which one hot page could make as large as the table."""
    return hits.join(owners.withColumnRenamed(POS, "hit_ord"), [Q, "hit_ord"]).select(
        Q, F.col("owner").alias("survivor"), F.col("hit_ord").alias("absorbed"), "url", "title",
        "engine", "reason")


def dedup(hits: DataFrame, mode: str = "default", **sizes: int) -> DedupResult:
    """Deduplicate pools (query_id, hit_ord, engine, positions, title, snippet, url, date, signals).

    ``hits`` is read several times: pass a stored or checkpointed table."""
    owners = find_owners(hits, mode, **sizes)
    return DedupResult(absorb(hits, owners), absorbed_urls(hits, owners), owners)


# ---- statistics ----------------------------------------------------------------------------
def dedup_stats(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Per query: rows in and out and the two stages, URL-equal and judged."""
    raw = hits.groupBy(Q).agg(F.count(F.lit(1)).alias("raw"))
    by_url = F.startswith("reason", F.lit("d1:url_exact"))
    merged = owners.groupBy(Q).agg(F.count_if(by_url).alias("url_merged"),
                                   F.count_if(~by_url).alias("judged_merged"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return raw.join(merged, Q, "left").select(
        Q, F.lit(MODE).alias("mode"), F.lit(fv.TITLE_MIN).alias("threshold"), "raw",
        (F.col("raw") - zero("url_merged") - zero("judged_merged")).alias("final"),
        (zero("url_merged") + zero("judged_merged")).alias("total_merged"),
        zero("url_merged").alias("d1_url_exact_merged"), zero("judged_merged").alias("d2_judged_merged"),
        (F.col("raw") - zero("url_merged")).alias("d1_url_exact_after"))


def pass_histogram(owners: DataFrame) -> DataFrame:
    """How often each piece of accepting evidence occurred."""
    return owners.select(Q, F.explode(F.split("reason", ",")).alias("evidence")) \
        .filter(~F.startswith("evidence", F.lit("d1:"))).groupBy(Q, "evidence") \
        .agg(F.count(F.lit(1)).alias("n"))


def candidate_counts(hits: DataFrame, mode: str = "default") -> DataFrame:
    """Per query the number of row pairs that share the canonical URL, the title or the snippet,
    by kind and in total. Counted from group sizes; no pair is formed."""
    rows = features(hits, mode).select(Q, "norm_url", "tkey", "shash")
    keys = {"u": ["norm_url"], "t": ["tkey"], "s": ["shash"], "ut": ["norm_url", "tkey"],
            "us": ["norm_url", "shash"], "ts": ["tkey", "shash"], "uts": ["norm_url", "tkey", "shash"]}
    tags = []
    for name, cols in keys.items():
        filled = F.lit(True)
        for c in cols:
            filled = filled & (F.col(c) != "")
        tags.append(F.when(filled, F.struct(F.lit(name).alias("kind"),
                                            F.md5(F.concat_ws("\u0001", *cols)).alias("key"))))
    sizes = rows.select(Q, F.explode(F.array_compact(F.array(*tags))).alias("k")) \
        .groupBy(Q, "k").agg(F.count(F.lit(1)).alias("n"))
    pairs = sizes.groupBy(Q).agg(*[
        F.sum(F.when(F.col("k.kind") == name, (F.col("n") * (F.col("n") - 1) / 2).cast("bigint"))
              .otherwise(0)).alias(name) for name in keys])
    total = F.expr("u + t + s - ut - us - ts + uts")
    return pairs.select(Q, F.col("u").alias("url_pairs"), F.col("t").alias("title_pairs"),
                        F.col("s").alias("snippet_pairs"), total.alias("candidate_pairs"))


def _visible(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Add ``limit``: a row meets exactly the survivors before this place, then its owner."""
    return rows.join(owners.select(Q, POS, "owner"), [Q, POS], "left") \
        .withColumn("limit", F.coalesce("owner", POS))


def _met(rows: DataFrame, levels: dict[str, tuple[Column, list[str]]]) -> DataFrame:
    """For each level the number of (survivor, row) encounters that share a title or snippet and
    the level's key; from running counts of survivors per key, without forming pairs."""
    tags = []
    for name, (holds, cols) in levels.items():
        for sign, kind, text in ((1, "t", ["tkey"]), (1, "s", ["shash"]), (-1, "ts", ["tkey", "shash"])):
            filled = holds
            for c in text:
                filled = filled & (F.col(c) != "")
            tags.append(F.when(filled, F.struct(
                F.lit(name).alias("level"), F.lit(sign).alias("sign"),
                F.md5(F.concat_ws("\u0001", F.lit(kind), *text, *cols)).alias("key"))))
    tagged = rows.select(Q, POS, "limit", "owner", F.explode(F.array_compact(F.array(*tags))).alias("k"))
    key = [F.col(Q), F.col("k.level").alias("level"), F.col("k.sign").alias("sign"), F.col("k.key").alias("key")]
    probes = tagged.select(*key, F.col("limit").alias("x"), F.lit(0).alias("mark"))
    counted = tagged.filter(F.col("owner").isNull()).select(*key, F.col(POS).alias("x"), F.lit(1).alias("mark"))
    met = count_before(probes.unionByName(counted), [Q, "level", "sign", "key"])
    return met.groupBy(Q).agg(*[
        F.coalesce(F.sum(F.when(F.col("level") == name, F.col("sign") * F.col("before"))), F.lit(0))
        .alias(name) for name in levels])


def _similar_numbers(rows: DataFrame) -> DataFrame:
    """Per query the encounters within one section whose number sets overlap enough.

    Only distinct number sets of a (section, title or snippet) are compared, those that share one of their
    rarest numbers; the rows behind two similar sets are counted by running counts, never paired."""
    tags = []
    for sign, kind, text in ((1, "t", ["tkey"]), (1, "s", ["shash"]), (-1, "ts", ["tkey", "shash"])):
        filled = F.lit(True)
        for c in text:
            filled = filled & (F.col(c) != "")
        tags.append(F.when(filled, F.struct(F.lit(sign).alias("sign"), F.md5(F.concat_ws(
            "\u0001", F.lit(kind), *text, "site", "head_key")).alias("scope"))))
    tagged = rows.filter(_placed() & (F.size("nums") > 0)) \
        .select(Q, POS, "limit", "owner", F.array_sort("nums").alias("nums"), F.explode(F.array_compact(F.array(*tags))).alias("k")) \
        .select(Q, POS, "limit", "owner", "nums", "k.sign", "k.scope").withColumn("set", F.xxhash64("scope", "nums"))
    sets = cut_lineage(tagged.select(Q, "scope", "set", "nums").distinct())
    rare = _rare(sets.select(Q, F.col("set").alias(POS), "nums", F.xxhash64(Q, "scope").alias("scope")), F.col("nums"), fv.NUMBERS_MIN)
    met = rare.withColumnRenamed(POS, "mine").join(rare.withColumnRenamed(POS, "theirs"), [Q, "bucket"]) \
        .filter("mine <> theirs").select(Q, "mine", "theirs").distinct()
    side = lambda name: sets.select(Q, F.col("set").alias(name), F.col("nums").alias(f"n_{name}"), F.col("scope").alias(f"s_{name}"))
    near = met.join(side("mine"), [Q, "mine"]).join(side("theirs"), [Q, "theirs"]) \
        .filter((F.col("s_mine") == F.col("s_theirs")) & (number_overlap(F.col("n_mine"), F.col("n_theirs")) >= fv.NUMBERS_MIN))
    pairs = near.select(Q, "mine", "theirs").unionByName(sets.select(Q, F.col("set").alias("mine"), F.col("set").alias("theirs")))
    probes = tagged.withColumnRenamed("set", "theirs").join(pairs, [Q, "theirs"]).select(
        Q, "sign", F.col("mine").alias("set"), F.col("limit").alias("x"), F.lit(0).alias("mark"))
    counted = tagged.filter(F.col("owner").isNull()).select(Q, "sign", "set", F.col(POS).alias("x"), F.lit(1).alias("mark"))
    return count_before(probes.unionByName(counted), [Q, "sign", "set"]).groupBy(Q).agg(
        F.sum(F.col("sign") * F.col("before")).alias("similar"))


def veto_histogram(hits: DataFrame, owners: DataFrame, mode: str = "default", feats: DataFrame | None = None) -> DataFrame:
    """query_id, veto, n: how often each veto kept two candidate rows apart. A candidate counts
    when its earlier row survives and its later row is not yet absorbed at that point."""
    rows = cut_lineage(_visible(features(hits, mode) if feats is None else feats, owners))
    hosted = F.col("host") != ""
    met = _met(rows, {
        "all": (F.lit(True), []), "site": (hosted, ["site"]),
        "section": (_placed(), ["site", "head_key"]),
        "bare": (_placed() & (F.size("nums") == 0), ["site", "head_key"]),
    }).join(_similar_numbers(rows), Q, "left")
    counts = F.array(
        F.struct(F.lit("veto:cross_site").alias("veto"), F.expr("all - site").alias("n")),
        F.struct(F.lit("veto:diff_section").alias("veto"), F.expr("site - section").alias("n")),
        F.struct(F.lit("veto:diff_numbers").alias("veto"),
                 F.expr("section - bare - coalesce(similar, 0)").alias("n")))
    return met.select(Q, F.explode(counts).alias("c")).select(Q, "c.veto", "c.n").filter("n > 0")


# ---- audit ---------------------------------------------------------------------------------
def merge_audit(hits: DataFrame, owners: DataFrame, mode: str = "default") -> DataFrame:
    """Judged merges with the margin by which they passed; a thin margin asks for review, merges
    by equal URL need none."""
    judged = owners.filter(~F.startswith("reason", F.lit("d1:url_exact")))
    involved = judged.select(Q, F.explode(F.array(POS, "owner")).alias("hit_ord")).distinct()
    few = hits.join(involved, [Q, "hit_ord"], "left_semi")
    info = cut_lineage(features(few, mode).select(Q, POS, _pack().alias("f")))
    texts = snippet_texts(few)
    both = judged.join(info.withColumnsRenamed({POS: "owner", "f": "a"}), [Q, "owner"]) \
        .join(info.withColumnRenamed("f", "b"), [Q, POS]) \
        .join(texts.withColumnsRenamed({POS: "owner", "snip": "sa"}), [Q, "owner"]) \
        .join(texts.withColumnRenamed("snip", "sb"), [Q, POS])
    a, b = F.col("a"), F.col("b")
    scored = both.select(
        Q, F.col("owner").alias("survivor"), F.col(POS).alias("absorbed"), "reason",
        url_similarity(a, b).alias("url_sim"), title_similarity(a, b).alias("title_sim"),
        snippet_similarity(F.col("sa"), F.col("sb")).alias("snippet_sim"))
    by_text = F.contains("reason", F.lit("text_high"))
    margin = F.least(F.col("title_sim") - fv.TITLE_MIN, F.when(
        by_text, F.col("snippet_sim") - fv.SNIPPET_MIN).otherwise(F.col("url_sim") - fv.URL_MIN))
    return scored.withColumn("margin", F.round(margin, 6)) \
        .withColumn("review", F.col("margin") < fv.REVIEW_MARGIN)


def near_misses(hits: DataFrame, owners: DataFrame, mode: str = "default", gap: float = fv.NEAR_MISS_GAP,
                feats: DataFrame | None = None, texts: Texts | None = None) -> DataFrame:
    """Rejected candidates of one section that were not vetoed and miss the nearer accept path by
    less than ``gap``: query_id, i, j, gap. Only rows with a common rare shingle of their addresses or titles or close
    sketches of their texts are compared, and only those that can still miss by less are asked for their texts. ``feats`` and
    ``texts`` as for ``find_owners``."""
    rows = cut_lineage(_visible(features(hits, mode) if feats is None else feats, owners))
    # A candidate shares title or snippet inside one section, so rows alone with theirs leave first.
    place = [Q, "site", "head_key"]
    shared = [rows.filter(_placed() & (F.col(key) != "")).select(*place, key).groupBy(*place, key).agg(F.count(F.lit(1)).alias("n"))
              .filter("n > 1").drop("n") for key in ("tkey", "shash")]
    rows = cut_lineage(rows.join(shared[0], [*place, "tkey"], "left_semi").unionByName(
        rows.join(shared[1], [*place, "shash"], "left_semi").select(*rows.columns)).distinct())
    texts = texts_of(hits, rows) if texts is None else texts
    entries = cut_lineage(_fine_buckets(rows, texts.sketches, gap).distinct().join(rows.select(Q, POS, "limit", "owner"), [Q, POS]))
    left = entries.filter(F.col("owner").isNull()).select(Q, "bucket", F.col(POS).alias("i"), "by_text")
    right = entries.select(Q, "bucket", F.col(POS).alias("j"), "limit")
    met = left.join(right, [Q, "bucket"]).filter((F.col("i") < F.col("limit")) & (F.col("i") < F.col("j"))) \
        .groupBy(Q, "i", "j").agg(F.bool_or("by_text").alias("by_text"))
    a, b = F.col("a"), F.col("b")
    r = relation(a, b)
    open_pairs = _attached(met, rows.select(Q, POS, _pack().alias("f"))) \
        .filter((r["same_title"] | r["same_snippet"]) & veto(r).isNull())
    # Equal texts and pairs without a text need none; a pair of two hosts is not judged by its texts.
    known = F.when(r["same_snippet"], 1.0).when((a["shash"] == "") | (b["shash"] == "") | ~r["host_same"], 0.0)
    scored = open_pairs.select(
        Q, "i", "j", "by_text", r["host_same"].alias("host_same"), known.alias("known"), (fv.TITLE_MIN - title_similarity(a, b)).alias("t"),
        (fv.URL_MIN - url_similarity(a, b)).alias("u")).filter((F.col("t") < gap) & (F.col("by_text") | (F.col("u") < gap)))
    scored = cut_lineage(scored)
    asked = scored.filter("known is null").join(texts.snips.withColumnsRenamed({POS: "i", "snip": "sa"}), [Q, "i"]) \
        .join(texts.snips.withColumnsRenamed({POS: "j", "snip": "sb"}), [Q, "j"]) \
        .withColumn("known", snippet_similarity(F.col("sa"), F.col("sb")))
    both = scored.filter("known is not null").unionByName(asked.select(*scored.columns)).withColumn("s", fv.SNIPPET_MIN - F.col("known"))
    by_text = F.when(F.col("host_same"), F.greatest("t", "s"))
    return both.select(Q, "i", "j", F.round(F.least(by_text, F.greatest("t", "u")), 6).alias("gap")) \
        .filter(F.col("gap") < gap)
