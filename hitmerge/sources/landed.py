"""Landed engine responses as raw_hits: one fixed schema and one projection per engine.

A new engine is one entry in ``ENGINES``."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitmerge import schemas
from hitmerge.functions.columns import first_non_blank, trim_white
from hitmerge.functions.text import clean_snippet


class Engine(NamedTuple):
    schema: str                              # of the response body
    items: Callable[[Column], Column]        # body -> array of result structs
    fields: Callable[[Column], dict]         # result struct -> column per raw_hits field
    failed: Callable[[Column], Column] = lambda body: F.lit(False)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _item(*names: str) -> str:
    return ",".join(f"{n}:string" for n in names)


ENGINES = {
    "exa": Engine(
        f"results array<struct<{_item('title', 'url', 'text', 'publishedDate')}>>",
        lambda b: b["results"],
        lambda r: dict(title=r["title"], url=r["url"], snippet=r["text"], date=r["publishedDate"])),
    "tavily": Engine(
        f"results array<struct<{_item('title', 'url', 'content', 'snippet')},score:double>>",
        lambda b: b["results"],
        lambda r: dict(title=r["title"], url=r["url"], snippet=first_non_blank(r["content"], r["snippet"]),
                       score=r["score"])),
    "anysearch": Engine(
        "code int, message string, data struct<results:array<struct<"
        f"{_item('title', 'name', 'url', 'link', 'content', 'snippet')}>>>",
        lambda b: F.filter(b["data"]["results"], lambda r: first_non_blank(r["title"], r["name"]) != ""),
        lambda r: dict(title=first_non_blank(r["title"], r["name"]), url=first_non_blank(r["url"], r["link"]),
                       snippet=first_non_blank(r["content"], r["snippet"])),
        lambda b: F.coalesce(b["code"], F.lit(0)) != 0),
    "serpapi": Engine(
        f"organic_results array<struct<{_item('title', 'link', 'snippet', 'date', 'source')}>>",
        lambda b: b["organic_results"],
        lambda r: dict(title=r["title"], url=r["link"], snippet=r["snippet"], date=r["date"],
                       source=trim_white(r["source"]))),
    "qianfan": Engine(
        f"references array<struct<{_item('title', 'url', 'snippet', 'content', 'date', 'website')},"
        "rerank_score:double,authority_score:double>>",
        lambda b: b["references"],
        lambda r: dict(title=r["title"], url=r["url"], snippet=first_non_blank(r["snippet"], r["content"]),
                       date=r["date"], rerank_score=r["rerank_score"], authority_score=r["authority_score"],
                       source=trim_white(r["website"]))),
    "metaso": Engine(
        f"webpages array<struct<{_item('title', 'link', 'score', 'snippet', 'date')}>>",
        lambda b: b["webpages"],
        lambda r: dict(title=r["title"], url=r["link"], snippet=r["snippet"], date=r["date"],
                       score_level=r["score"])),
    "tinyfish": Engine(
        f"results array<struct<position:bigint,{_item('site_name', 'title', 'snippet', 'url', 'date')}>>",
        lambda b: b["results"],
        lambda r: dict(title=r["title"], url=r["url"], snippet=r["snippet"], date=r["date"],
                       source=r["site_name"], rank=r["position"])),
}


def pack(fields: dict) -> Column:
    """Signal struct of the given fields, NULL when every one is empty."""
    parts, some = [], F.lit(False)
    for name in schemas.SIGNAL_FIELDS:
        kind = "double" if name in schemas.SIGNAL_NUMBERS else "string"
        c = fields.get(name)
        empty = 0.0 if kind == "double" else ""
        value = F.lit(None).cast(kind) if c is None else F.when(c != empty, c.cast(kind))
        some = some | value.isNotNull() if c is not None else some
        parts.append(value.alias(name))
    return F.when(some, F.struct(*parts))


def project(responses: DataFrame, engine: str) -> DataFrame:
    """responses(query_id, query, body struct) -> raw_hits. Rows without a URL are dropped before
    they are counted, so ranks are the running index of the kept rows."""
    e = ENGINES[engine]
    body = F.col("body")
    usable = F.filter(e.items(body), lambda r: _text(e.fields(r)["url"]) != "")
    rows = responses.filter(body.isNotNull() & ~e.failed(body)) \
        .select("query_id", "query", F.posexplode(usable).alias("ord", "r"))
    f = e.fields(F.col("r"))
    index = (F.col("ord") + 1).cast("bigint")
    rank = F.when(F.coalesce(f["rank"], F.lit(0)) > 0, f["rank"]).otherwise(index) if "rank" in f else index
    return rows.select(
        "query_id", "query", F.lit(engine).alias("engine"), F.col("ord").cast("bigint").alias("ord"),
        rank.alias("rank"), trim_white(_text(f["title"])).alias("title"), f["url"].alias("url"),
        clean_snippet(_text(f["snippet"])).alias("snippet"),
        trim_white(_text(f.get("date", F.lit("")))).alias("date"), pack(f).alias("signals"))


def from_bodies(responses: DataFrame, engine: str) -> DataFrame:
    """responses(query_id, query, body STRING): a body that is no JSON gives no rows."""
    parsed = F.from_json(F.col("body"), f"{ENGINES[engine].schema}")
    return project(responses.withColumn("body", parsed), engine)


def read_landed(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """JSON files of {query_id, query, body}, read with the engine's fixed schema."""
    fields = ",".join(_colon(f) for f in _split_top(ENGINES[engine].schema))
    return project(spark.read.schema(f"query_id string, query string, body struct<{fields}>").json(path), engine)


def _split_top(schema: str) -> list[str]:
    """Top-level fields of a DDL schema."""
    from pyspark.sql.types import _parse_datatype_string
    return [f"{f.name} {f.dataType.simpleString()}" for f in _parse_datatype_string(schema).fields]


def _colon(field: str) -> str:
    name, kind = field.split(" ", 1)
    return f"{name}:{kind}"
