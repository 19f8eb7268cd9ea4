"""The SimHash stage keeps exactly one row of each component."""

import corpus_pipeline
from ledgerlens.llm import op4_simhash

SCHEMA = "doc_id long, text string, source string"


def _simhash_stage(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, corpus_pipeline.simhash_near_dedup(spark, df, "").collect()), key=repr)


A, B, C = ("the quick brown fox jumps over it " * 3, "completely other words stand in this one here", "a third text of its own kind")


def test_simhash_stage_keeps_texts_without_an_id(spark):
    rows = [(1, A, "x"), (None, A, "y"), (None, B, "x"), (None, C, "x")]
    assert _simhash_stage(spark, rows) == sorted([rows[0], rows[2], rows[3]], key=repr)
    # Only null ids in a component: still one row.
    assert len(_simhash_stage(spark, [(None, A, "x"), (None, A.upper(), "x"), (None, B, "x")])) == 2


def test_simhash_stage_keeps_other_texts_of_an_id(spark):
    rows = [(1, A, "x"), (2, A, "x"), (2, B, "x")]
    assert _simhash_stage(spark, rows) == sorted([rows[0], rows[2]], key=repr)
    assert len(_simhash_stage(spark, [(1, A, "x"), (1, A.upper(), "x")])) == 1


def test_simhash_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, A, "y"), (1, A, "x"), (1, A, "x"), (2, A, "a"), (3, B, "x"), (3, B, "x"), (4, C, "x")]
    assert _simhash_stage(spark, rows) == [(1, A, "x"), (3, B, "x"), (4, C, "x")]
    assert op4_simhash.remove_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
