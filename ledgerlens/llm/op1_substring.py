"""Substring deduplication: every word that lies in a window of ``window``
consecutive words whose sequence also starts anywhere else is removed.

Level-wise doubling.  The hash of a window is built from the hashes of two
windows of half its length.  The first level has windows of half the length;
only those repeated in the corpus are extended to the full window, and only the
full windows that are repeated mark words.  (Longer repeats need no further
level: each is covered by its full windows.)  The first level does not need
every start: of all half windows inside a full window, the one with the least
hash is its anchor.  Equal full windows have equal anchors, so a window whose
anchor is not repeated cannot be repeated, and about one start in ten is moved
instead of all.

Documents with the same words throughout form classes, found by SHA-256: their
members lose every word, and one of them stands for all in the levels.

Only hashes and positions are shuffled, but for the texts of documents that have
a repeated anchor.  Counts are made before rows are joined, so a passage that is
in a third of all documents is a row for each task and not a hot key; the joins
back are plain inner joins whose skewed side Spark may split.  A full window is
known by 128 bits: counts are by the first 64, and where the second 64 differ
among equal first ones, by all.

Defined results: null and empty texts have no words; texts shorter than the
window lose nothing; rows that share a doc_id are documents of their own; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, if_small, read_table, text_bytes, written

WINDOW = 35
CACHE_WORDS = 400_000
#: Multipliers of the 64-bit mixing function and of the hash pair.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
PAIR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of ``length`` words, doubled up from word hashes:
    a window is its first and its last half (which overlap if it is odd)."""
    if length == 1:
        return words if lane == 0 else _mix(words ^ np.uint64(PAIR[1]))
    half = -(-length // 2)
    h = window_hashes(words, half, lane)
    n = max(0, len(words) - length + 1)
    return _mix(h[:n]) * np.uint64(PAIR[lane]) + h[length - half:length - half + n]


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[:len(values) - rest], values[rest:]) if rest else values


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the half windows that are least in some full window."""
    half = -(-window // 2)
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = window_hashes(words, half)
    order = _mix(hashes)
    inside = window - half + 1
    least = _sliding(order, inside, np.minimum)  # one for each full window
    edge = np.zeros(inside - 1, np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), inside, np.maximum) == order)
    return chosen, hashes[chosen]


def candidate_starts(words: np.ndarray, window: int, repeated: np.ndarray) -> np.ndarray:
    """Starts of full windows whose least half window is among the repeated
    anchors."""
    half = -(-window // 2)
    if len(words) < window:
        return np.empty(0, np.int64)
    order = _mix(window_hashes(words, half))
    least = _sliding(order, window - half + 1, np.minimum)
    known = np.full(len(order), np.iinfo(np.uint64).max, np.uint64)
    known[repeated] = order[repeated]
    return np.flatnonzero(_sliding(known, window - half + 1, np.minimum) == least)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    """One cache for all tasks of a worker process."""
    return _WordHashes()


def _first_level(window: int):
    def make():
        hashes = _word_hashes()

        def step(batch):
            out = {k: [] for k in ("th", "n_words", "sha", "starts", "hashes")}
            for raw in text_bytes(batch):
                words = raw.split()
                out["n_words"].append(len(words))
                out["sha"].append(hashlib.sha256(b" ".join(words)).digest())
                starts, values = anchors(hashes.of(words), window)
                out["starts"].append(starts.astype(np.int32))
                out["hashes"].append(values.view(np.int64))
            return out | {"id": batch.column("id"), "th": batch.column("th"), "row": batch.column("row")}
        return step
    return make


def _full_windows(window: int):
    def make():
        hashes = _word_hashes()

        def run(batch):
            out = {k: [] for k in ("starts", "h1", "h2")}
            for raw, repeated in zip(text_bytes(batch), batch.column("starts")):
                words = hashes.of(raw.split())
                starts = candidate_starts(words, window, np.asarray(repeated.as_py(), np.int64))
                out["starts"].append(starts.astype(np.int32))
                for lane in (0, 1):
                    out[f"h{lane + 1}"].append(window_hashes(words, window, lane)[starts].view(np.int64))
            return out | {"row": batch.column("row")}
        return run
    return make


def _keeper(window: int, with_text: bool):
    def make():
        def run(batch):
            out = {"n_removed": [], "kept_sha256": [], "kept_text": []}
            for raw, starts in zip(text_bytes(batch), batch.column("starts")):
                words = raw.split()
                cover = np.zeros(len(words) + 1, np.int64)
                starts = np.asarray(starts.as_py() or [], np.int64)
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                keep = np.cumsum(cover)[:-1] == 0
                kept = b" ".join([w for w, k in zip(words, keep) if k])
                out["n_removed"].append(len(words) - int(keep.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept_text"].append(kept.decode())
            return out | {"row": batch.column("row")}
        return run
    return make


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """(row, start) of the windows (row, start, h1, h2) whose 128-bit key
    occurs more than once.  The windows are cheaper made twice than kept."""
    seen = windows.groupBy("h1").agg(F.count(F.lit(1)).alias("n"), F.min("h2").alias("lo"), F.max("h2").alias("hi"))
    several = written(seen.where("n > 1").select("h1", (F.col("lo") != F.col("hi")).alias("mixed")), "repeated")
    if several.where("mixed").isEmpty():
        return windows.join(several.select("h1"), "h1").select("row", "start")
    # Different windows share their first 64 bits: those by all 128 bits.
    sure = windows.join(several.where("not mixed").select("h1"), "h1").select("row", "start")
    mixed = windows.join(several.where("mixed").select("h1"), "h1")
    again = mixed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return sure.unionByName(mixed.join(again, ["h1", "h2"]).select("row", "start"))


class Repeats:
    """The levels for one table of documents."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"):
        self.window = window
        id_type = docs.schema[id_col].dataType.simpleString()
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
        numbered = self.texts.withColumn("row", F.monotonically_increasing_id())
        #: One row per document, written, so its row numbers are fixed.
        self.rows = written(arrow_map(numbered, f"row long, id {id_type}, th long, n_words long, sha binary, "
                                      "starts array<int>, hashes array<bigint>", _first_level(window)), "anchors")
        long = self.rows.where(F.col("n_words") >= window)
        classes = written(long.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1"),
                          "classes")
        #: Rows whose whole word sequence is that of another row; ``first`` stands for its class.
        self.copies = long.select("row", "sha").join(classes, "sha").select("row", (F.col("row") == F.col("first")).alias("stands"))

    def marked(self) -> DataFrame:
        """(row, text, starts): documents that have repeated windows, without
        copies, and the starts of these windows."""
        once = self.rows.select("row", F.explode("hashes").alias("hash"))
        # Written, so that the join reads it as a side of its own and Spark may split its hot keys.
        repeated = written(once.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
        pairs = self.rows.select("row", F.inline(F.arrays_zip("starts", "hashes")))
        survive = pairs.join(repeated.withColumnRenamed("hash", "hashes"), "hashes").groupBy("row").agg(
            F.collect_list("starts").alias("starts"))
        survive = written(survive.join(self.copies.where(~F.col("stands")).select("row"), "row", "left_anti"), "anchored")
        keys = written(survive.select("row").join(self.rows.select("row", "id", "th"), "row").select(
            "row", F.col("id").alias("__id"), F.col("th").alias("__th")), "wanted")
        met = self.texts.join(if_small(keys), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
        candidates = written(met.select("row", "text").join(survive, "row"), "candidates")
        windows = arrow_map(candidates, "row long, starts array<int>, h1 array<bigint>, h2 array<bigint>",
                            _full_windows(self.window))
        windows = windows.select("row", F.inline(F.arrays_zip(F.col("starts").alias("start"), "h1", "h2")))
        starts = _repeated_windows(windows).groupBy("row").agg(F.collect_list("start").alias("starts"))
        # A document that stands for copies is repeated as a whole.
        return candidates.drop("starts").join(starts, "row").join(self.copies.select("row"), "row", "left_anti")

    def result(self, with_text: bool = False) -> DataFrame:
        """One row per document: id, n_words, n_removed, kept_sha256."""
        schema = "row long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        done = arrow_map(self.marked(), schema, _keeper(self.window, with_text)).withColumnRenamed("row", "__row")
        whole = self.copies.select(F.col("row").alias("__copy"))
        rows = self.rows.select("row", "id", "th", "n_words", "sha")
        rows = rows.join(done, F.col("row") == F.col("__row"), "left").join(whole, F.col("row") == F.col("__copy"), "left")
        copy = F.col("__copy").isNotNull()
        nothing = hashlib.sha256(b"").hexdigest()
        return rows.select(
            "id", "th", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
            *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated words: the text of a document that loses
    words becomes its kept words joined by one space; others stay as they are."""
    changed = Repeats(docs, window, id_col, text_col).result(with_text=True).where("n_removed > 0").dropDuplicates(
        ["id", "th"]).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("kept_text").alias("__kept"))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.withColumn("__t", key).join(
        changed, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__th")), "left")
    return joined.withColumn(text_col, F.when(F.col("__th").isNotNull(), F.col("__kept")).otherwise(F.col(text_col))) \
        .select(*docs.columns)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: words of all documents in windows of 35 that start elsewhere, too."""
    out = Repeats(read_table(spark, sf_dir, "documents")).result()
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
