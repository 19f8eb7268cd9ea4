"""Quality rules by weak supervision: each rule votes good, bad or abstains;
expectation-maximisation over the vote patterns estimates how reliable every
rule is, and a document stays if its posterior probability of good quality
reaches the threshold and the base rule does not fail.  Native Spark functions
only: measures are array expressions inside a row, the model reads one row for
each vote pattern, and its answers come back by a broadcast join (at most
``3 ** rules`` rows).

Defined results: null text is the empty text (no words: the base rule fails);
rows that share a doc_id are judged each by its own text; an empty table gives
an empty result; other columns are kept by :func:`filter_documents` and not
read otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, if_small, nested, read_table, same_text, spread, words, written
from .weak import Start, one_failure_each, posteriors, vote

SYMBOLS = "#*$%&|<>"
WINDOW = 8
THRESHOLD = 0.5
#: Good text is the rule, and a rule's bad vote, set off at extreme values only,
#: is rare on it.  Junk mostly fails one rule and passes the others, so there is
#: a way to be junk for every rule; what the other rules say of it is estimated.
RULES = 9
START = one_failure_each(RULES, share=0.85, if_positive=0.995, failing=0.05, passing=0.93, pseudo=20.0,
                         anchor=1.0)


def _covered(starts: Column, window: int) -> Column:
    """Words covered by windows at the (ascending) starts."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(starts, zero, lambda acc, i: F.struct(
        (acc["n"] + i + window - F.greatest(i.cast("long"), acc["end"])).alias("n"), (i + window).cast("long").alias("end")),
        lambda acc: acc["n"])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, th (64-bit hash of the text) and the measures of every row."""
    none = F.array().cast("array<struct<k:string,i:int>>")
    a = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    a = a.select("*", words(F.col("text")).alias("w"),
                 F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0).alias("lines"))
    a = a.select("*", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    at = F.sequence(F.lit(0), F.col("n") - window)
    a = a.select("*", F.when(F.col("n") >= window, F.transform(at, lambda i: F.xxhash64(F.slice("h", i + 1, window))))
                 .otherwise(F.array().cast("array<bigint>")).alias("g"))
    # Equal windows have equal hashes, so only texts with repeated hashes need
    # their windows as words.
    sorted_windows = F.sort_array(F.transform(at, lambda i: F.struct(
        F.array_join(F.slice("w", i + 1, window), " ").alias("k"), i.alias("i"))))
    a = a.select("*", F.when(F.size(F.array_distinct("g")) < F.size("g"), sorted_windows).otherwise(none).alias("s"))
    twice = F.filter("s", lambda x, j: (F.get("s", j - 1)["k"] == x["k"]) | (F.get("s", j + 1)["k"] == x["k"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    count = lambda c: F.length("text") - F.length(F.translate("text", c, ""))
    echoes = F.size(F.filter("h", lambda x, j: (j > 0) & (F.get("h", j - 1) == x)))
    return a.select(
        "id", F.xxhash64("text").alias("th"), F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(starts, window).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("h")).cast("long").alias("n_distinct_words"),
        echoes.cast("long").alias("n_echo_words"), F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        count("!?").cast("long").alias("n_shouts"), count("0123456789").cast("long").alias("n_digits"))


def rules() -> list[Column]:
    """The votes on the measures; a document without words is left to the base rule."""
    n, c = F.col("n_words"), lambda name: F.col(name)
    some = n > 0
    chars = F.col("word_chars")
    return [
        vote(some & (100 * c("n_symbols") <= 2 * n), some & (100 * c("n_symbols") > 20 * n)),
        vote(some & (100 * c("n_repeat_words") <= 10 * n), some & (100 * c("n_repeat_words") > 30 * n)),
        vote(10 * c("n_dup_lines") <= c("n_lines"), (10 * c("n_dup_lines") > 4 * c("n_lines")) & (c("n_lines") >= 5)),
        vote(some & (chars >= 3 * n) & (chars <= 8 * n), some & ((chars > 14 * n) | (2 * chars < 3 * n))),
        vote(some & (100 * c("n_upper") <= 12 * chars), some & (100 * c("n_upper") > 40 * chars) & (n >= 20)),
        vote(some & (100 * c("n_shouts") <= 10 * n), some & (100 * c("n_shouts") > 60 * n)),
        vote(100 * c("n_distinct_words") >= 40 * F.least(n, F.lit(2000)), some & (100 * c("n_distinct_words") < 35 * F.least(n, F.lit(400))) & (n >= 20)),
        vote(some & (100 * c("n_echo_words") <= 5 * n), some & (100 * c("n_echo_words") > 25 * n) & (n >= 20)),
        vote(some & (100 * c("n_digits") <= 10 * chars), some & (100 * c("n_digits") > 50 * chars)),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(measured: DataFrame, threshold: float = THRESHOLD, start: Start = START) -> DataFrame:
    """``measured`` (a written table, it is read twice) with base_failed,
    votes, quality (posterior) and kept."""
    votes = rules()
    coded = measured.withColumn("votes", F.concat(*votes)).withColumn("base_failed", base_failed())
    model = posteriors(coded.select("votes"), start, code="votes")
    answers = model.select(F.col("code").alias("__votes"), F.col("posterior").alias("quality"))
    # At most 3 ** rules rows of one short string and one number.
    judged = coded.join(F.broadcast(answers), F.col("votes") == F.col("__votes"), "left").drop("__votes")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= threshold))


def quality(docs: DataFrame, threshold: float = THRESHOLD, start: Start = START, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per input row: id, th, measures, base_failed, votes, quality, kept."""
    return judge(written(measures(docs, id_col, text_col), "measures"), threshold, start)


def filter_documents(docs: DataFrame, threshold: float = THRESHOLD, start: Start = START, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    bad = written(quality(docs, threshold, start, id_col, text_col).where("not kept").select("id", "th").distinct(), "rejected")
    rows = nested(docs, id_col, text_col)
    return spread(rows.join(if_small(bad), same_text(rows, bad), "left_anti"), docs)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: base measures and verdict of all documents."""
    q = quality(read_table(spark, sf_dir, "documents"))
    return q.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "votes", F.round("quality", 6).alias("quality"))
