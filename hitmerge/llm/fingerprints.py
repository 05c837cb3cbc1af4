"""Fingerprints of hits: every shingle hash below a fixed fraction of the hash range. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitmerge.llm.texts import SPACE
from hitmerge.session import cut_lineage

CHUNK_ROWS = 1024
BROADCAST_ROWS = 1 << 16        # of the list of large chunks, of some 100 bytes each; a longer one is joined as Spark chooses


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, words: int = 5, share: float = 0.25) -> Column:
    """Struct of the fingerprint (``print``) of a text and its least shingle hash (``least``, null without words).

    The least hash is no part of the fingerprint; it tells apart texts so short that no hash lies below the threshold."""
    limit = F.lit(-(1 << 63) + int(share * (1 << 63)) * 2)
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    none = F.array().cast("array<bigint>")

    def shingles(h):
        return F.when(F.size(h) == 0, none).otherwise(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, words))))

    def low(s):
        return F.struct(F.sort_array(F.array_distinct(F.filter(s, lambda x: x < limit))).alias("print"), F.array_min(s).alias("least"))

    return _let(F.transform(split, lambda w: F.xxhash64(w)), lambda h: _let(shingles(h), low))


def fingerprint(text: Column, words: int = 5, share: float = 0.25) -> Column:
    """Sorted distinct hashes of the runs of ``words`` words that lie in the lowest ``share`` of all 64-bit numbers.

    The threshold is the same for every text, so the fingerprint of a union of shingle sets is the union of theirs,
    and sizes and overlaps estimate those of the sets, also of very unequal texts. A text with fewer
    words is one shingle. Null and blank texts have no hash, and a text of few shingles may have none."""
    return sketch(text, words, share)["print"]


def alike(a: Column, b: Column) -> Column:
    """Likeness of two sketches; of two without a hash in their fingerprints it is 1 if their least hashes are equal, else 0."""
    return F.when((F.size(a["print"]) == 0) & (F.size(b["print"]) == 0), a["least"].eqNullSafe(b["least"]).cast("double")) \
        .otherwise(likeness(a["print"], b["print"]))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints; two empty ones are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has as well; an empty ``a`` lies in everything."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def printable(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda x: F.lower(F.hex(x))), " ")


def _chunked(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """``chunk`` of each row: an array that orders like ``hit_ord``, nulls first, shared by about ``chunk_rows`` rows.

    A chunk of more than four times as many rows is cut again, into equal ranges of its own ids, until none is left; one
    of a single id is cut by hash of its texts. Only equal rows can then share a large one."""
    rows = rows.withColumns({"chunk": F.array().cast("array<bigint>"), "done": F.lit(False)})
    while True:
        size = rows.where("not done").groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("hit_ord").alias("low"), F.max("hit_ord").alias("high"))
        hot = cut_lineage(size.where(F.col("n") > 4 * chunk_rows).select(
            "chunk", "low", (F.col("low") == F.col("high")) | F.col("low").isNull(), F.ceil(F.col("n") / chunk_rows),
            F.expr(f"ceil((cast(high AS decimal(20, 0)) - low + 1) * {chunk_rows} / n)")).toDF("chunk", "low", "single", "parts", "width"))
        many = hot.count()
        if not many:
            return rows.drop("done")
        single = F.coalesce("single", F.lit(False))
        # Nulls of a chunk with other ids stand before these.
        part = F.coalesce(F.expr("floor((cast(hit_ord AS decimal(20, 0)) - low) / width)"), F.lit(-1))
        if not hot.where("single").isEmpty():
            part = F.when(single, F.pmod(F.xxhash64("snippet"), F.col("parts"))).otherwise(part)
        rows = rows.join(F.broadcast(hot) if many <= BROADCAST_ROWS else hot, "chunk", "left").select(
            "hit_ord", "snippet", (F.col("done") | single).alias("done"),
            F.concat("chunk", F.array(F.when(F.col("parts").isNull(), 0).otherwise(part).cast("long"))).alias("chunk"))


def with_next(hits: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Hits cut into chunks of the order (``hit_ord`` descending, nulls last), each with the first hit of the chunk after it.

    Rows of one ``hit_ord`` are ordered by text, in a large group of them by parts of the hash of their texts.

    :return: ``hit_ord``, ``snippet``, ``chunk``, ``guest``; a guest row stands last in its chunk, and the chunk
        after the last one is the first. Only the list of chunks is ordered in one task, not the hits.
    """
    rows = _chunked(hits.select(F.col("hit_ord").cast("long").alias("hit_ord"), F.coalesce("snippet", F.lit("")).alias("snippet")), chunk_rows)
    head = rows.groupBy("chunk").agg(F.max("hit_ord").alias("head"))
    order = W.orderBy(F.desc("chunk"))
    turn = head.select(F.col("chunk").alias("of"), "head", F.coalesce(
        F.lag("chunk").over(order), F.min("chunk").over(W.partitionBy())).alias("before"))
    guest = rows.join(turn, (rows["chunk"] == turn["of"]) & rows["hit_ord"].eqNullSafe(turn["head"])) \
        .groupBy("before", "hit_ord").agg(F.min("snippet").alias("snippet")) \
        .select("hit_ord", "snippet", F.col("before").alias("chunk"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guest)


def fingerprints(hits: DataFrame, words: int = 5, share: float = 0.25, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fingerprint of every whole snippet and of its edited text, and how alike neighbours are.

    The edited text has its last third (rounded down) of code points replaced by the first as many (or
    all) of the next hit by descending ``hit_ord``; after the last comes the first.

    :param hits: ``hit_ord``, ``snippet``; other columns are not read, whatever their names
    :param words: words of a shingle; white space apart, lower case
    :param share: part of the hash range that is kept
    :param chunk_rows: hits of the order that one task sees together, on average
    :return: one row per row of ``hits`` with ``hit_ord``, ``n_chars``, ``edited_sha256``, ``print``,
        ``edited_print`` (arrays), ``near_edited`` and ``near_next``. A null snippet is an empty one. Rows
        that repeat a ``hit_ord`` stand next to each other (``with_next``); rows without one stand last. A single
        row is its own next.
    """
    chunked = with_next(hits, chunk_rows).repartition("chunk").withColumn("own", sketch(F.col("snippet"), words, share))
    # Within a chunk; a guest is seen by the last hit and then left out.
    order = W.partitionBy("chunk").orderBy("guest", F.desc_nulls_last("hit_ord"), "snippet")
    length = F.char_length("snippet")
    third = F.floor(length / 3).cast("int")
    both = chunked.withColumn("follows", F.lead("snippet").over(order)).withColumn("next", F.lead("own").over(order)).where(~F.col("guest"))
    edited = F.concat(F.substring(F.col("snippet"), F.lit(1), length - third), F.substring(F.col("follows"), F.lit(1), third))
    done = both.select("hit_ord", length.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next") \
        .withColumn("changed", sketch(F.col("edited"), words, share))
    return done.select("hit_ord", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own.print").alias("print"),
                       F.col("changed.print").alias("edited_print"), alike(F.col("own"), F.col("changed")).alias("near_edited"),
                       alike(F.col("own"), F.col("next")).alias("near_next"))
