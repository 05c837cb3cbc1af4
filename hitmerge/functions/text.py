"""Text columns: comparison text, titles, snippets, numbers, shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.columns import WHITE_TEXT, char_class, let, squeeze_white, trim_white

_NOISE = WHITE_TEXT + "\x1c\x1d\x1e\x1f" + fv.TEXT_NOISE
_SEP = char_class(fv.TITLE_SEPARATORS)
_LAST_SEP = f"(?s)^(.+)[{_SEP}]([^{_SEP}]*)$"
_SENTENCE = f"[{char_class(fv.SENTENCE_MARKS)}]"
CJK = r"\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}"


def norm_text(c: Column) -> Column:
    """Comparison text: lower case without white space and the listed punctuation."""
    return F.translate(F.lower(c), _NOISE, "")


def _strip_once(t: Column) -> Column:
    head = F.regexp_replace(F.regexp_extract(t, _LAST_SEP, 1), "[ \t]+$", "")
    tail = trim_white(F.regexp_extract(t, _LAST_SEP, 2))
    cut = (head != "") & (tail != "") & (F.length(tail) <= fv.SUFFIX_MAX_CHARS) & ~tail.rlike(_SENTENCE)
    return F.when(cut, head).otherwise(t)


def strip_site_suffix(c: Column) -> Column:
    """Cut the site name a title ends with, at most two of them."""
    t = trim_white(c)
    for _ in range(fv.SUFFIX_PASSES):
        t = let(t, _strip_once)
    return t


def norm_title(c: Column) -> Column:
    return norm_text(strip_site_suffix(c))


def repair_mojibake(c: Column) -> Column:
    """Undo UTF-8 read as Latin-1, only where the bytes decode without loss."""
    latin_only = c.rlike(r"[^\x00-\x7F]") & ~c.rlike(r"[^\x00-\xFF]")
    raw = F.encode(F.when(latin_only, c), "ISO-8859-1")
    fixed = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.when(latin_only & F.coalesce(fixed.rlike(r"[^\x00-\xFF]"), F.lit(False)), fixed).otherwise(c)


def clean_snippet(c: Column) -> Column:
    """Repair mojibake, drop Markdown images, reduce Markdown links to their text, squeeze space."""
    t = F.regexp_replace(repair_mojibake(c), r"!\[[^\]]*\]\([^)]*\)", "")
    return squeeze_white(F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1"))


def truncate_chars(c: Column, n: int) -> Column:
    """At most n characters, the last one an ellipsis when something was cut."""
    if n <= 0:
        return F.lit("")
    short = F.regexp_replace(F.substring(c, 1, n - 1), " +$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(short, F.lit("…")))


def positions_text(positions: Column) -> Column:
    """``(bing#1, exa#3)`` from a map of engine to rank; '' for an empty map."""
    parts = F.transform(F.array_sort(F.map_entries(positions)),
                        lambda e: F.concat(e["key"], F.lit("#"), e["value"].cast("string")))
    return F.when(F.size(parts) > 0, F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))) \
        .otherwise("")


def number_set(url: Column, title: Column) -> Column:
    """Distinct digit runs (any script) of URL and title."""
    return F.array_distinct(F.regexp_extract_all(
        F.concat_ws(" ", url, title), F.lit(r"(\p{Nd}+)"), F.lit(1)))


def shingles(norm: Column, n: int) -> Column:
    """Distinct character n-grams of an already normalised text. Grams are put together from the
    array of characters: ``substr`` walks from the start each time, quadratic on long texts."""
    def cut(chars: Column) -> Column:
        gram = lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)])
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(chars) - n), gram))

    return (
        F.when(norm == "", F.array().cast("array<string>"))
        .when(F.length(norm) <= n, F.array(norm))
        .otherwise(let(F.split(norm, ""), cut)))


def ngrams(c: Column, n: int) -> Column:
    return shingles(norm_text(c), n)


def jaccard(a: Column, b: Column) -> Column:
    """Set Jaccard of two arrays of distinct values; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0),
                  let(common, lambda k: k / (F.size(a) + F.size(b) - k))).otherwise(F.lit(0.0))


def text_jaccard(a: Column, b: Column, n: int) -> Column:
    """Shingle Jaccard of two normalised texts; equal texts need no shingles."""
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(let(F.struct(shingles(a, n).alias("a"), shingles(b, n).alias("b")),
                       lambda s: jaccard(s["a"], s["b"]))))


def number_overlap(a: Column, b: Column) -> Column:
    """Jaccard of the number sets, 1 when neither side has numbers."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(jaccard(a, b))


def query_locale(query: Column) -> Column:
    """struct(country, language): Chinese defaults when the query holds CJK characters."""
    cjk = query.rlike(r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]")
    return F.struct(F.when(cjk, "cn").otherwise("us").alias("country"),
                    F.when(cjk, "zh-cn").otherwise("en").alias("language"))


def card_type(attribute: Column) -> Column:
    """Type token of a result card from its JSON attribute, '' unless it is a JSON string."""
    token = F.when(attribute.rlike(r'"sc"\s*:\s*"'), F.get_json_object(attribute, "$.sc"))
    return F.coalesce(trim_white(token), F.lit(""))
