"""Line deduplication: the stage, and lines within an edit limit that grows with their length."""

import random
import time

import pytest

import corpus_pipeline
from ledgerlens.llm import op10_lines

from .test_operators import _edits

SCHEMA = "doc_id long, text string, source string"


def test_line_stage_keeps_short_documents_with_words_left(spark):
    line = "Licensed under the terms that stand in the file"
    rows = [(1, line, "x"), (2, line + "\nfour words are left", "x"), (3, line, "x"), (4, "short", "x")]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(tuple, out)) == [rows[0], (2, "four words are left", "x"), rows[3]]


def _varied(rnd, line, times):
    x = list(line)
    for _ in range(times):
        at = rnd.randint(0, len(x))
        x[at:at + rnd.randint(0, 1)] = [rnd.choice("abcd")] * rnd.randint(0, 1)
    return "".join(x)


@pytest.mark.parametrize(("edits", "dense"), [(None, 64), (None, 1), (2, 1), (4, 2)])
def test_edits_grow_with_the_line(spark, edits, dense):
    rnd = random.Random(dense)
    base = ["".join(rnd.choice("abcd ") for _ in range(n)) for n in (20, 30, 39, 41, 60, 79, 100, 101, 124, 127, 300)]
    # A template: one part of the line is equal in all, the other in none.
    texts = [_varied(rnd, b, rnd.choice([0, 1, 2, 3, 5, 6, 7, 9])) for b in base for _ in range(12)]
    texts += [base[8][:90] + "".join(rnd.choice("abcd ") for _ in range(34)) for _ in range(20)]
    rnd.shuffle(texts)
    first = {}
    for i, x in enumerate(texts):
        if len(x) >= 20:
            first.setdefault(x, i)
    reach = lambda x, y: edits or min(6, -(-min(len(x), len(y)) // 20))
    want = {i for x, i in first.items() for y, j in first.items()
            if j < i and abs(len(x) - len(y)) <= 6 and _edits(x, y) <= reach(x, y)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op10_lines.removed_lines(df, edits, 20, dense).where("size(near) > 0").select("id").collect()
    assert {r["id"] for r in got} == want


@pytest.mark.parametrize("dense", [1, 64])
def test_a_longer_line_is_probed_whatever_the_hashes(spark, dense):
    """Two lines of a length class, the later with one character more in front: only the probe of the longer one
    meets the shorter one where the others of its keys are not near."""
    rnd = random.Random(5)
    docs = []
    for i in range(40):
        line = "".join(rnd.choice("abcdefgh ") for _ in range(24))
        other = line[:12] + "".join(rnd.choice("ijklm") for _ in range(12))
        docs += [(4 * i, other), (4 * i + 1, line), (4 * i + 2, line[:5] + "z" + line[5:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = op10_lines.removed_lines(df, 1, 20, dense).where("size(near) > 0").select("id").collect()
    assert sorted(r["id"] for r in got) == [4 * i + 2 for i in range(40)]


def test_one_word_replaced_is_a_near_copy(spark):
    line = "all files are distributed under the licence of the people who wrote them, without a warranty of any kind at all"
    rows = [(1, line, "x"), (2, line.replace("people", "persons") + "\nown words", "x")]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(map(tuple, out)) == [rows[0], (2, "own words", "x")]


def _words(rnd, n, letters="abcdefghijklmnopqrst"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(n))[:n]


@pytest.mark.parametrize("dense", [1, 64])
def test_long_lines_meet_by_chunks(spark, dense):
    """Edits at the cuts, lines on both sides of the least length, and lines that have too few chunks."""
    rnd = random.Random(dense)
    base = [_words(rnd, n) for n in (257, 262, 330, 388)] + [_words(rnd, 300, "uvwxyz"), "x" * 20 + _words(rnd, 280).replace(" ", "")]
    texts = {}
    for b, line in enumerate(base):
        for _ in range(14):
            x = list(line)
            for _ in range(rnd.randint(0, 8)):
                at = rnd.choice([i for i, c in enumerate(x) if c == " "] or range(len(x))) + rnd.randint(0, 1)
                x[at:at + rnd.randint(0, 1)] = [rnd.choice("ab ")] * rnd.randint(0, 1)
            texts.setdefault("".join(x), b)
    texts = rnd.sample(sorted(texts.items()), len(texts))
    want = {i for i, (x, b) in enumerate(texts) for y, c in texts[:i]
            if b == c and abs(len(x) - len(y)) <= 6 and _edits(x, y) <= 6}
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(texts)], "doc_id long, text string")
    got = op10_lines.removed_lines(df, None, 20, dense).where("size(near) > 0").select("id").collect()
    assert {r["id"] for r in got} == want and 0 < len(want) < len(texts)


def test_a_long_line_has_few_keys(spark):
    rnd = random.Random(1)
    rows = [(i, _words(rnd, n)) for i, n in enumerate((300, 460, 700, 1500, 9000) * 4)]
    keys = op10_lines.keys_of(spark.createDataFrame(rows, "nr long, line string"))
    assert max(r["count"] for r in keys.groupBy("nr").count().collect()) <= 2 * op10_lines.MAX_EDITS + 1


def test_two_lines_of_lengths_too_far_apart_are_no_candidates(spark):
    """Lines of one class whose first segments are equal: 4 characters more than an edit can make good, and 1 more."""
    rnd = random.Random(2)
    line = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(24))
    far, near = line(), line()
    rows = [(1, far), (2, far + "wxyz"), (3, near), (4, near + "w")]
    shared = op10_lines.shared_keys(spark.createDataFrame(rows, "nr long, line string"), None)
    assert {r["nr"] for r in shared.collect()} == {1, 2, 3, 4}
    shared = op10_lines.shared_keys(spark.createDataFrame(rows, "nr long, line string"), 2)
    assert {r["nr"] for r in shared.collect()} == {3, 4}


def test_keys_are_shuffled_once_as_two_numbers(spark):
    """Lengths and marks go with the hash: rows had four columns, and carried the line until they were made."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, _words(rnd, n)) for i, n in enumerate((20, 39, 40, 119, 120, 255, 300, 900))], "nr long, line string")
    keys = op10_lines.keys_of(df)
    assert keys.dtypes == [("packed", "bigint"), ("nr", "bigint")]
    plan = op10_lines.shared_keys(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_text_is_cut_into_lines_once(spark):
    """It was cut once more for each line that stays."""
    text = "\n".join(f"line {i}" for i in range(30_000))
    docs = spark.createDataFrame([(1, text), (2, "a\nb")], "doc_id long, text string")
    removed = docs.limit(1).where("doc_id = 1").selectExpr("doc_id AS id", "xxhash64(text) AS th", "array(0, 29999) AS exact", "array(7) AS near")
    removed = spark.createDataFrame(removed.collect(), removed.schema)
    start = time.monotonic()
    got = {r["row"]["doc_id"]: (r["kept"], r["n_exact"], r["n_near"]) for r in op10_lines.without_lines(docs, removed).collect()}
    assert time.monotonic() - start < 20
    assert got == {1: ("\n".join(f"line {i}" for i in range(1, 29_999) if i != 7), 2, 1), 2: ("a\nb", 0, 0)}
