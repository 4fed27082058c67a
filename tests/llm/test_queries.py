"""The registered queries: their contracts' columns and types, and their SQL where they have it."""

import os
from collections import Counter

import duckdb
import pytest

from tidewater.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
CONTRACTS = {
    "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_licence_scan": {"doc_id": "bigint", "licences": "string"},
    "op3_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "removed": "string"},
    "op4_hmm_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op5_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op7_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_benchmark_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "round_trip": "boolean"},
}
ROWS = {"op5_nearest_neighbours": None, "op6_html_extraction": "pages"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(QUERIES) == sorted(CONTRACTS)


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_and_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    assert CONTRACTS[name].items() <= dict(df.dtypes).items()
    got = df.collect()
    if table := ROWS.get(name, "documents"):
        assert len(got) == tables.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name in SQL:
        made = tables.execute(SQL[name])
        names = [d[0] for d in made.description]
        assert sorted(names) == sorted(df.columns)
        assert Counter(tuple(r[n] for n in names) for r in got) == Counter(made.fetchall())
