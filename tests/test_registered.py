"""Registered queries against their SQL at the smallest scale, where the data folder exists."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from hitmerge import fixed_values as fv

SF = "/root/testdata/sf0.001"
FEW = ["exact_url_merge", "page_merge", "dedup_hits", "search_round", "sub_domain", "html_hits", "stream_merge",
       "stream_new_hosts", "stream_deadline", "stream_status", "report_json", "report_header", "page_articles", "flip_audit"]
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no data folder")


def canon(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@here
@pytest.mark.parametrize("name", FEW)
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())


@here
def test_entry(spark):
    assert entry.entry(spark).count() == 49


@here
def test_closed_rounds(spark):
    """Every engine of a closed round has its row."""
    st = entry.queries()["stream_status"](spark, SF).collect()
    per_round = {q: sorted(r["engine"] for r in st if r["query_id"] == q) for q in {r["query_id"] for r in st}}
    assert per_round and all(e == fv.ALL_ENGINES for e in per_round.values())
    assert all(not r["ok"] and r["count"] == 0 and r["error"] == fv.ABANDONED for r in st if r["engine"] == "serpapi")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
