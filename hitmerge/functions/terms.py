"""Query terms: what an on-topic result could echo, and the pattern that finds it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.columns import let, squeeze_white
from hitmerge.functions.text import CJK

_NO_TERMS = "array<string>"
_OPERATOR = "(?i)^[+-]?(?:" + "|".join(fv.QUERY_OPERATORS) + "):"
# From a token that starts with -" to the first one that ends with a quote, or to the end.
_EXCLUDED = '(?<![^ ])-"(?:[^ ]*?"(?= |$)|.*?"(?= |$)|.*$)'
_QUOTES = "\"'“”《》「」"


def content_tokens(query: Column) -> Column:
    """White-space tokens without operators, booleans, exclusions and excluded phrases."""
    kept = F.regexp_replace(squeeze_white(query), _EXCLUDED, " ")
    return F.filter(F.split(kept, " "), lambda t: (t != "") & ~t.isin(fv.BOOLEAN_WORDS) & ~F.startswith(t, F.lit("-")) & ~t.rlike(_OPERATOR))


def bigrams(run: Column, start: int = 1) -> Column:
    """Character pairs of a string from the 1-based position on."""
    last = F.length(run) - 1
    return F.when(last >= start, F.transform(
        F.sequence(F.lit(start), last), lambda i: F.substr(run, i, F.lit(2)))) \
        .otherwise(F.array().cast(_NO_TERMS))


def stem(word: Column) -> Column:
    """Coarse stem of an ASCII word that keeps at least four letters."""
    out = F.when(word.rlike(r"[^\x00-\x7F]") | F.endswith(word, F.lit("ss")), word)
    for suffix in fv.STEM_SUFFIXES:
        keep = F.length(word) - len(suffix)
        out = out.when(F.endswith(word, F.lit(suffix)) & (keep >= fv.STEM_MIN_LETTERS),
                       F.substr(word, F.lit(1), keep))
    return out.otherwise(word)


def token_terms(token: Column) -> Column:
    """Bigrams of the CJK runs, then the stemmed words of the rest."""
    pairs = F.flatten(F.transform(
        F.regexp_extract_all(token, F.lit(f"([{CJK}]+)"), F.lit(1)), lambda r: bigrams(r)))
    words = F.regexp_extract_all(
        F.lower(F.regexp_replace(token, f"[{CJK}]+", " ")),
        F.lit(r"([\p{L}\p{N}]+(?:\.[0-9]+)+|[\p{L}\p{N}]+)"), F.lit(1))
    useful = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(fv.STOP_WORDS))
    return F.concat(pairs, F.transform(useful, stem))


def query_terms(query: Column) -> Column:
    """struct(anchor, rest): the terms a first-word-only bucket would match, and the others."""
    def split_terms(tokens: Column) -> Column:
        only = F.get(tokens, F.lit(0))
        bare = F.regexp_replace(only, f"^[{_QUOTES}]+|[{_QUOTES}]+$", "")
        one_run = (F.size(tokens) == 1) & bare.rlike(f"^[{CJK}]{{4,}}$") \
            & (F.size(F.regexp_extract_all(only, F.lit(f"([{CJK}]+)"), F.lit(1))) == 1)

        def by_token(terms: Column) -> Column:
            first = F.array_position(F.transform(terms, lambda t: F.size(t) > 0), True).cast("int")
            none = F.array().cast(_NO_TERMS)
            return F.struct(
                F.when(first > 0, F.get(terms, first - 1)).otherwise(none).alias("anchor"),
                F.when(first > 0, F.flatten(F.slice(terms, first + 1, F.size(terms)))).otherwise(none)
                .alias("rest"))

        return F.when(one_run, F.struct(
            F.array(F.substring(bare, 1, 2)).alias("anchor"), bigrams(bare, 3).alias("rest"))) \
            .otherwise(let(F.transform(tokens, token_terms), by_token))

    def independent(s: Column) -> Column:
        alone = F.filter(s["rest"], lambda t: ~F.exists(
            s["anchor"], lambda a: F.contains(t, a) | F.contains(a, t)))
        return F.struct(s["anchor"].alias("anchor"), F.array_distinct(alone).alias("rest"))

    return let(let(content_tokens(query), split_terms), independent)


def rest_pattern(rest: Column) -> Column:
    """Regexp that finds any rest term; terms of up to three non-CJK characters as whole words.

    A word boundary here is one between ASCII word characters and everything else, so ``go``
    is found in ``go语言``; Java's own ``\\b`` would take CJK characters for word characters."""
    def part(t: Column) -> Column:
        body = F.regexp_replace(t, r"([^\p{L}\p{N}])", r"\\$1")
        before = F.when(t.rlike("^[A-Za-z0-9_]"), "(?<![A-Za-z0-9_])").otherwise("(?<=[A-Za-z0-9_])")
        after = F.when(t.rlike("[A-Za-z0-9_]$"), "(?![A-Za-z0-9_])").otherwise("(?=[A-Za-z0-9_])")
        return F.when((F.length(t) <= 3) & ~t.rlike(f"[{CJK}]"), F.concat(before, body, after)).otherwise(body)

    return F.when(F.size(rest) > 0, F.concat(F.lit("(?iu)"), F.array_join(F.transform(rest, part), "|")))
