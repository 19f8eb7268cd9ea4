"""Exact token counts for every context limit from one length histogram.

Each document is encoded once; the histogram counts documents by encoded
length.  With suffix sums over the lengths, any limit L has closed answers:
documents longer than L, tokens kept when every document is cut to L
(``tokens of documents up to L + L * documents beyond``), tokens lost, and
quantiles by rank.  The suffix sums run in two levels (bands of lengths, then
lengths within a band), so no task sees the whole histogram.

Defined results: null and empty texts have length 0 and are counted; an empty
table gives an empty histogram; columns other than the text are not read.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, read_table, text_bytes, written

BAND = 256


@lru_cache(maxsize=1)
def _encoding(rank_file: str, pattern: str):
    """One encoding for all tasks of a worker process."""
    import base64

    import tiktoken
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counter(rank_file: str, pattern: str):
    def make():
        encode = _encoding(rank_file, pattern).encode_ordinary
        return lambda batch: {"length": [len(encode(raw.decode())) for raw in text_bytes(batch)]}
    return make


def lengths(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``length``: encoded length of every document."""
    return arrow_map(docs.selectExpr(f"`{text_col}` AS text"), "length long", _counter(rank_file, pattern))


def histogram(encoded: DataFrame) -> DataFrame:
    """(length, n_docs) of ``lengths``."""
    return encoded.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, band: int = BAND) -> DataFrame:
    """Every length of the histogram, taken as a limit, with: n_docs (of that
    length), docs_from and tokens_from (documents at least as long and their
    tokens), total_docs, total_tokens, truncated_tokens (when documents are cut
    to the limit), lost_tokens, and rank_from/rank_to (the quantile ranks, from
    1, that the length holds)."""
    h = hist.withColumn("band", F.floor(F.col("length") / band)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    # One row for each ``band`` lengths up to the longest document: a short list.
    bands = h.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = bands.select("band", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
                         F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                         F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    within = Window.partitionBy("band").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    s = h.join(bands, "band").select(
        "length", "n_docs", (F.sum("n_docs").over(within) + F.col("d_after")).alias("docs_from"),
        (F.sum("tokens").over(within) + F.col("t_after")).alias("tokens_from"), "total_docs", "total_tokens")
    truncated = F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    return s.withColumn("truncated_tokens", truncated).withColumn("lost_tokens", F.col("total_tokens") - truncated) \
        .withColumn("rank_from", F.col("total_docs") - F.col("docs_from") + 1) \
        .withColumn("rank_to", F.col("total_docs") - F.col("docs_from") + F.col("n_docs"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any limits, one row each: context_limit, docs_over (longer
    documents), truncated_tokens, total_tokens."""
    # One pass: conditional sums for each of the given limits.
    n, size = F.col("n_docs"), F.col("length")
    cut = [F.struct(F.lit(int(x)).cast("long").alias("context_limit"),
                    F.coalesce(F.sum(F.when(size > x, n)), F.lit(0)).alias("docs_over"),
                    F.coalesce(F.sum(F.least(size, F.lit(int(x))) * n), F.lit(0)).alias("truncated_tokens"),
                    F.coalesce(F.sum(size * n), F.lit(0)).alias("total_tokens")) for x in limits]
    return sums.agg(F.array(*cut).alias("a")).select(F.inline("a"))


def quantiles(sums: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, length): the smallest length whose documents and shorter ones
    make up at least the fraction of all documents."""
    picks = [F.struct(F.lit(float(f)).alias("fraction"),
                      F.min(F.when(F.col("rank_to") >= F.ceil(F.col("total_docs") * F.lit(f)), F.col("length"))).alias("length"))
             for f in fractions]
    return sums.agg(F.array(*picks).alias("a")).select(F.inline("a")).where(F.col("length").isNotNull())


def op5_token_counts(spark: SparkSession, sf_dir: str, rank_file: str | None = None) -> DataFrame:
    """Query: the histogram of all documents with its suffix sums."""
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents")
    encoded = lengths(docs, rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    # The sums read the histogram twice; written, the documents are encoded once.
    return suffix_sums(written(histogram(encoded), "histogram"))
