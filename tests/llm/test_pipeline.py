"""The pipeline's stages, each on what the one before kept."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_operators import AWKWARD, CLASHING, brute_components, brute_hits, brute_lines, documents, language_rows, row_ids, shingle_sets, without

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_brute_force(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    names = docs.columns
    items = [tuple(r) for r in corpus_pipeline.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, named = {r["doc_id"]: r["text"] for r in docs.collect()}, row_ids(docs)
        out = corpus_pipeline.saved(stage(spark, docs, SF))
        if name == "sentencepiece":
            assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out.collect())
            assert {r["doc_id"] for r in out.collect()} == set(before)
            break
        assert out.columns == names
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            assert Counter(after.items()) == without(named, brute_lines(named, 24, False))
        elif name == "ngram_join":
            top = brute_components(shingle_sets(list(before.items()), 5), 80)
            assert set(after) == {i for i in before if top[i] == i}
        else:
            hits = {i: brute_hits(t, items, 13) for i, t in before.items()}
            assert set(after) == {i for i, (_, h, _) in hits.items() if not h}
        docs = out


def test_awkward_rows_and_extra_columns(spark, tmp_path):
    rows = [(i + 10000 if i is not None else None, t, lang) for i, t, lang in language_rows()[:40]] + [r[:2] for r in AWKWARD]
    documents(spark, rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30
    documents(spark, []).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert CLASHING
