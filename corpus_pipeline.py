"""Corpus pipeline: quality rules, line deduplication, near-duplicate removal,
removal of personal data, and packing into training sequences.

Every stage takes the documents its predecessor kept (``documents`` at first)
and calls one operator over all of them; all but the last return the columns of
documents.  A null doc_id, null or empty texts, repeated rows and empty tables
have the results that the operators define."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import op2_packing, op4_simhash, op6_quality, op8_pii, op10_lines
from ledgerlens.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op6_quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur earlier, or nearly so, go; a document goes only if no
    word of it is left."""
    return op10_lines.remove_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component one row stays, that with the smallest id."""
    return op4_simhash.remove_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return op8_pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 2048 tokens."""
    return op2_packing.pack_documents(docs, op2_packing.word_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizers and fitted models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
