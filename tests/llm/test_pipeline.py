"""The stages one after the other, and the registered queries."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from ledgerlens.llm import op2_packing
from ledgerlens.llm.queries import ORACLES, QUERIES

from ..conftest import SF_SMALL
from .fixtures import documents, empty, frame


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = frame(spark)
    columns, before = docs.columns, len(documents())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), name)
        assert docs.columns == columns
        assert docs.count() <= before
        before = docs.count()
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = dict((r[0], r[1]) for r in documents())
    assert kept and not any(t is None or t == "" for t in kept.values())
    assert not any("$$$ ###" in t or "SHOUT" in t for t in kept.values())
    assert not any("4012888888881881" in t for t in kept.values())
    assert len(kept) == len({" ".join(t.split()).lower() for t in kept.values()})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(kept) and set(kept) <= set(texts)


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "").count() == 0


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    rows = out.collect()
    assert rows and max(r["length"] for r in rows) <= op2_packing.CAPACITY


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {*QUERIES, "pipeline"} <= names
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracles(spark, key):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = QUERIES[key](spark, SF_SMALL)
    want = con.sql(ORACLES[key])
    assert sorted(got.columns) == sorted(want.columns)
    cols = ", ".join(sorted(got.columns))
    assert sorted(map(tuple, got.selectExpr(*sorted(got.columns)).collect())) == sorted(con.sql(f"SELECT {cols} FROM want").fetchall())
