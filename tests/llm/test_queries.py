import html
import math
import os
import re

import duckdb
import pytest

from hitmerge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
COLUMNS = {
    "op1_ngram_jaccard_join": "doc_id n_shingles component_id", "op2_language_id": "doc_id held_out lang_pred score",
    "op3_html_extraction": "page_id url text n_chars", "op4_mix_sources": "doc_id size source_size target taken",
    "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op6_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op7_substring_dedup": "doc_id start n_words first_doc_id", "op8_toxicity": "doc_id held_out score predicted",
    "op9_embedding_near_dedup": "vec_id n_links component_id kept",
    "op11_quality_classifier": "doc_id held_out score predicted", "op12_ranked_search": "item_id rank doc_id score",
    "op13_conversation_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) else a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = sorted(tuple(r) for r in QUERIES[name](spark, SF).select(*names).collect())
    assert len(got) == len(want) and all(same(x, y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(ORACLES)))
def test_runs_over_the_whole_table(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    n, docs = df.count(), spark.read.parquet(f"{SF}/{'pages' if name.startswith('op3') else 'documents'}.parquet").count()
    assert n >= docs if name.startswith("op5") else n > 0 if name.startswith("op7") else n == docs


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and set(ORACLES) <= set(QUERIES)


def test_main_text_of_the_pages(spark):
    squeezed = lambda t: re.sub(r"\s+", "", t)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op3_html_extraction"](spark, SF).collect():
        inside = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]]).group(1)
        assert squeezed(r["text"]) == squeezed(html.unescape(re.sub(r"<[^>]*>", " ", inside))) and r["n_chars"] == len(r["text"])
