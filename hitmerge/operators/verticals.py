"""Query routing: vertical domain by keyword, sub-domain by catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmerge import fixed_values as fv
from hitmerge.functions.columns import squeeze_white


def vertical_domain(query: Column) -> Column:
    """First domain, in list order, with a keyword contained in the query; '' when none."""
    q = F.lower(query)
    out = None
    for domain, words in fv.DOMAIN_KEYWORDS:
        any_word = F.lit(False)
        for w in words.split():
            any_word = any_word | F.contains(q, F.lit(w))
        out = F.when(any_word, domain) if out is None else out.when(any_word, domain)
    return out.otherwise("")


def resolve_sub_domain(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """queries(query_id, query) with catalog(domain, pos, sub_domain, description, params
    map<string, struct<required: boolean>>): adds domain, tag and the required parameter names.

    The first catalog row whose name or description holds a query word of two or more characters
    wins, else the first row of the domain; queries without a domain or catalog get ''."""
    words = F.filter(F.split(squeeze_white(F.replace(F.lower("query"), F.lit("，"), F.lit(" "))), " "),
                     lambda w: F.length(w) >= 2)
    q = queries.withColumn("domain", vertical_domain(F.col("query"))).withColumn("__words", words)
    named = F.exists("__words", lambda w: F.contains(F.lower("sub_domain"), w)
                     | F.contains(F.lower("description"), w))
    required = F.array_sort(F.map_keys(F.map_filter(
        "params", lambda _, v: F.coalesce(v["required"], F.lit(False)))))
    best = q.join(catalog, "domain").groupBy("query_id").agg(F.min_by(
        F.struct(F.when(F.col("sub_domain") != "", F.col("sub_domain")).otherwise(F.col("domain")).alias("tag"),
                 F.coalesce(required, F.array().cast("array<string>")).alias("required")),
        F.struct(~named, F.col("pos"))).alias("best"))
    return q.drop("__words").join(best, "query_id", "left").select(
        *queries.columns, "domain", F.coalesce("best.tag", F.lit("")).alias("tag"),
        F.coalesce("best.required", F.array().cast("array<string>")).alias("required"))
