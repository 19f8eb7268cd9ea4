"""The pipeline and its line stage against plain versions; columns with clashing names."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import common, op2_packing, op6_quality, op8_pii, op10_lines
from ledgerlens.llm.queries import QUERIES

from ..conftest import SF_SMALL
from . import plain
from .fixtures import frame
from .test_operators import sha


@pytest.fixture(scope="module")
def small():
    rows = duckdb.connect().sql(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{SF_SMALL}/documents.parquet')").fetchall()
    return sorted(rows)


def test_line_query_equals_plain_version(spark, small):
    lost = plain.lines_lost(small)
    want = Counter()
    for d, t in small:
        exact, near = lost.get((d, t), ([], []))
        want[d, t.count("\n") + 1, len(exact), len(near), sha(plain.without(t, {*exact, *near}))] += 1
    assert sum(n for _, _, n, _, _ in want) > 20 and sum(n for _, _, _, n, _ in want) > 0
    assert Counter(map(tuple, QUERIES["op10_lines"](spark, SF_SMALL).collect())) == want


@pytest.mark.parametrize("dense", [64, 3])
def test_a_family_of_lines_far_from_each_other(spark, dense):
    """Lines of one template that differ in words: nearly all share segments, few are near."""
    rnd = random.Random(dense)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    template = [rnd.choice(words) for _ in range(24)]
    docs = []
    for i in range(1000 if dense > 3 else 200):
        line = list(template)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            line[rnd.randrange(24)] = rnd.choice(words)
        docs.append((i, " ".join(line)))
    lost = plain.lines_lost(docs)
    want = {(d, tuple(lost[d, t][0]), tuple(lost[d, t][1])) for d, t in docs if (d, t) in lost}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = op10_lines.removed_lines(df, None, 20, dense).select("id", "exact", "near").collect()
    assert {(r["id"], tuple(r["exact"]), tuple(r["near"])) for r in got} == want


def test_signatures_never_exceed_the_letters_that_differ(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcxyz é,A") for _ in range(rnd.choice([0, 5, 40, 200]))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array(*op10_lines.signature(F.col("t"))).alias("s"))
    marks = {r["t"]: r["s"] for r in df.collect()}
    count = lambda t: [t.count(c) for c in op10_lines.LETTERS] + [sum(c not in op10_lines.LETTERS for c in t)]
    for a in texts:
        for b in texts:
            bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(marks[a], marks[b]))
            diff = [abs(x - y) for x, y in zip(count(a), count(b))]
            assert bits <= sum(diff) and (max(diff) > 8 or bits == sum(diff))


def test_short_lines_go_if_they_repeat(spark):
    rows = [(1, "ab\n\n \t\nown words here", "x"), (2, "ab\n\n \t\nother words here", "x"), (3, "ab", "x")]
    out = op10_lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted(map(tuple, out.collect())) == [rows[0], (2, "\n \t\nother words here", "x")]


def test_pipeline_equals_plain_stages(spark, small):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    # The verdicts of the fitted models come from their operators, which have tests of their own.
    kept = {(r["id"], r["th"]) for r in op6_quality.quality(docs).where("kept").collect()}
    rows = [(d, t) for d, t in small if (d, plain.xxhash_signed(t)) in kept]
    lost = plain.lines_lost(rows)
    rows = [(d, plain.without(t, {*lost[d, t][0], *lost[d, t][1]})) if (d, t) in lost else (d, t) for d, t in rows]
    rows = [(d, t) for d, t in rows if plain.WORD.search(t)]
    rows = plain.one_of_each_component(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {(r["id"], r["th"]): r["s"] for r in op8_pii.spans(df).select("id", "th", op8_pii._listed(F.col("spans")).alias("s")).collect()}
    rows = [(d, plain.redacted(t, spans[d, plain.xxhash_signed(t)])) for d, t in rows]
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(
        plain.cut(rows, op2_packing.word_tokenizer()))
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= op2_packing.CAPACITY


CLASHING = ["exact", "near", "__id", "__th", "__spans", "__t", "a.b", "th", "spans", "kept", "lines", "numbers", "merged", "_id", "_th"]


@pytest.mark.parametrize("stage", range(4))
def test_columns_with_names_of_inner_columns_are_kept(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = frame(spark).select("doc_id", "text")
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)], F.create_map(F.lit("k"), F.lit(1)).alias("row"))
    got, want = run(spark, more, ""), run(spark, docs, "")
    assert got.columns == more.columns and got.schema["row"].dataType == more.schema["row"].dataType
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(map(tuple, want.collect()))
    assert all(r[c] == i for r in rows for i, c in enumerate(CLASHING)) and all(r["row"] == {"k": 1} for r in rows)


def test_a_written_table_leaves_no_shuffle_files(spark, monkeypatch):
    """The write runs under Spark's setting that frees them, and the session's own value is back after it, and after a failure."""
    before, seen = spark.conf.get(common.FREE_SHUFFLES), []
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    real = type(df).write
    monkeypatch.setattr(type(df), "write", property(lambda self: (seen.append(spark.conf.get(common.FREE_SHUFFLES)), real.fget(self))[1]))
    assert sum(r["count"] for r in common.written(df, "seen").collect()) == 1000
    with pytest.raises(Exception):  # noqa: B017
        common.written(df.select(F.raise_error(F.lit("no")).alias("x")), "fails")
    assert seen == ["true", "true"] and spark.conf.get(common.FREE_SHUFFLES) == before == "false"
