"""A corpus pipeline of five stages over the documents table, each one operator of the llm subpackage.

Stages take (spark, docs, sf_dir) and return rows with the columns of
documents (the last: the encoded texts). run() writes each stage's result as
Parquet in the shared folder and reads it back for the next.

Defined results, in every stage but where it says more: rows are kept or go as
they are, with all their columns, whatever the names; equal rows are treated
alike; an empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import saved, table
from tidewater.llm.decontaminate import clean
from tidewater.llm.langid import with_language
from tidewater.llm.line_dedup import NEVER, dedup_lines
from tidewater.llm.ngram_join import one_of_each
from tidewater.llm.pieces import digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null and empty texts, and those without a letter."""
    return with_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 24 code points or more within two edits of an earlier one go; so do documents of which nothing is left.

    Null texts stay. Rows that share a doc_id, or have none, are documents of their own where their texts differ."""
    out = dedup_lines(docs, equal_short=False, long=NEVER)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more) stays, the one of the smallest doc_id.

    Texts without words are in no group; of rows that repeat a doc_id one stays, and rows without one stay."""
    return one_of_each(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go, however long they are; null texts stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, n_bytes, round_trip, ids); a null text has null ids, an empty one none."""
    return digests(docs.select("doc_id", "text"), keep=["doc_id"], with_ids=True)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
