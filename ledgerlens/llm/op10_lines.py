"""Line deduplication with a segment-partition edit join.  Native Spark
functions only.

A line with a word is removed if the same line occurs earlier in the corpus; a line
of at least ``min_chars`` characters also if a line within reach of it has its first
occurrence before its own; earlier means by id, then line number.  Within reach are lines
that differ by at most one edit for each ``CHARS_PER_EDIT`` characters begun of
the shorter line, and by at most ``MAX_EDITS``; or by ``edits`` if it is given.
The edit join runs over the first occurrences:

1. Lengths fall into classes; with k edits allowed in a class, the first k + 1
   pieces of a line that its class cuts off are its segments.  Of two lines
   within k edits, the longer one holds some segment j of the shorter one intact,
   with at most j edits before and k - j behind it, so it is probed with the
   substrings that can match, by class, segment number and shift.  In classes of
   ``LONG_CHARS`` and more, a few chunks of the line stand for all of these (:func:`_chunks`).
2. The segments of a line are among its own probes, so one shuffle of the probes brings
   each key together; keys that no line owns, or only one has, go there.  Lines that share
   a key left are candidates; a candidate pair is verified by lengths, by the numbers of its
   letters (a signature of 32 bytes), and only then, with the texts, by the banded edit distance.
3. A key with more than ``dense`` lines is not paired off.  All its lines are
   compared with the earliest of them; those near it are decided, and need
   be met only as earlier lines.  If others are open, the lines of the key meet in a join
   that verifies a pair in the same way before it becomes a row.  So the rows
   made are near pairs; comparisons of signatures still grow with the square of a
   family whose lines share a segment but are not near each other.

Shuffled are hashes, positions, and the texts of distinct lines once; later on
texts are moved only for candidate lines and for documents that lose lines.

Defined results: null text is the empty text; lines without a word stay; rows that
share id and text share their decisions; a null id comes first; an empty table
gives an empty result; other columns are kept by :func:`remove_lines`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, if_small, nested, read_table, spread, with_decisions, words, written

MAX_EDITS = 6
CHARS_PER_EDIT = 20
MIN_CHARS = 20
DENSE = 8
#: Least lengths of the first and the last class whose lines meet by chunks.
LONG_CHARS, LONG_MOST = 256, 1 << 22
#: Where lines of classes from a length on are cut: at spaces before some letters.
CUTS = {LONG_CHARS: " (?=[a-l])", 384: " (?=[a-h])", 640: " (?=[a-e])", 1280: " (?=[b-d])"}
#: A key has its hash above 16 bits: 7 of the length beyond that of the class, up to a most, one
#: mark, and 8 that are empty.
KEY_SHIFT, LOW_SHIFT, MOST_BEYOND = 16, 8, (1 << 7) - 1
#: Bits of the number of a chunk in its line.
NUMBER_BITS = 24
PLACE = ("id", "th", "line_no")
#: Characters with a count of their own in a signature.
LETTERS = "abcdefghijklmnopqrstuvwxyz "


def least_chars(edits: int | None, min_chars: int) -> int:
    return max(min_chars, 2 * ((edits or 1) + 1))


def class_base(n: Column, edits: int | None, min_chars: int) -> Column:
    """Least length of the class of a length: a quarter of an octave; where the
    edits grow with the length, that of all lengths with as many edits."""
    octave = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n)) - 1)
    step = F.greatest(F.shiftright(octave, 2), F.lit(1))
    base = octave + F.floor((n - octave) / step).cast("int") * step
    if not edits:
        most = (MAX_EDITS - 1) * CHARS_PER_EDIT
        same = F.floor((n - 1) / CHARS_PER_EDIT).cast("int") * CHARS_PER_EDIT + 1
        base = F.when(n <= most, same).otherwise(F.greatest(base, F.lit(most + 1)))
    return F.greatest(base, F.lit(least_chars(edits, min_chars)))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines with a word: id, th (hash of the text), line_no, h1 and h2 (hashes of
    the line), line."""
    rows = nested(docs, id_col, text_col).select("id", "th", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1))
                                                 .alias("line_no", "line"))
    rows = rows.where(F.btrim("line", F.lit(" \t\x0b\x0c\r")) != "")
    return rows.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "line")


def distinct_lines(found: DataFrame) -> DataFrame:
    """One row per line text: first (its first place), n (occurrences), line, and for lines that
    repeat h1 and h2, which nothing else needs."""
    rows = found.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count(F.lit(1)).alias("n"),
                                         F.first("line").alias("line"))
    return rows.select(*[F.when(F.col("n") > 1, F.col(h)).alias(h) for h in ("h1", "h2")], "first", "n", "line")


def later_occurrences(found: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of lines whose text occurs earlier in the corpus."""
    several = distinct.where("n > 1").select("h1", "h2", "first")
    met = found.select(*PLACE, "h1", "h2").join(several, ["h1", "h2"])
    return met.where(~F.struct(*PLACE).eqNullSafe(F.col("first"))).select(*PLACE).distinct()


def _patterns(k: int) -> list[tuple[int, int]]:
    """(segment, shift) of the probes of a line, made for lines as long or shorter: a
    shift to the left has to be made good behind it.  Those for k edits are among those for more."""
    return [(j, s) for j in range(k + 1) for s in range(-min(j, k - j), j + 1)]


def _classed(distinct: DataFrame, edits: int | None, min_chars: int) -> DataFrame:
    """Lines with the classes they probe, those of lines as long or shorter
    by the edits that the class allows; home marks their own."""
    n, least = F.length("line"), F.lit(least_chars(edits, min_chars))
    # Where the edits grow with the length, no class between others is as short as the edits.
    shorter = range(1, 1 + edits) if edits else range(1, 1 + MAX_EDITS) if min_chars < CHARS_PER_EDIT else (MAX_EDITS,)
    lengths = [n] + [F.greatest(n - d, least) for d in shorter]
    bases = F.array_distinct(F.array(*[class_base(m, edits, min_chars) for m in lengths]))
    k = F.lit(edits) if edits else F.least(F.lit(MAX_EDITS), F.ceil(F.col("base") / CHARS_PER_EDIT).cast("int"))
    return distinct.select("nr", "line", F.posexplode(bases).alias("at", "base")).withColumn("home", F.col("at") == 0).withColumn("k", k)


def _chunks(rows: DataFrame, allowed: int) -> DataFrame:
    """Rows of :func:`_classed` with chunks (hashes of some chunks of a line of the long classes,
    else null) and few (whether the allowed edits can change every chunk of it).

    A line is cut where its class says, and by what stands there only.  So an edit
    changes one chunk or two neighbours, and k edits leave some of k + 1 chunks
    that are no neighbours.  All chunks have one order: long ones first, then by hash.  A line
    keeps its first ones, so many that k + 1 of them are no neighbours, or all if there are
    not that many: it is few.  Of two lines within k edits, take the one whose kept chunks end first in
    that order (a few line ends last): one of them is in the other line, which keeps
    it, too.  Only two few lines can miss each other."""
    in_line = F.lit((1 << NUMBER_BITS) - 1)

    def code(c: Column, i: Column) -> Column:
        """6 bits of length, 33 of hash, and the number."""
        by_length = F.shiftleft((63 - F.least(F.octet_length(c), F.lit(63))).cast("long"), 57)
        return by_length.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.xxhash64(c), 7 + NUMBER_BITS), NUMBER_BITS)).bitwiseOR(i.cast("long"))

    def apart(m: int) -> Column:
        """How many of the first m chunks are no neighbours."""
        numbers = F.sort_array(F.transform(F.slice("codes", 1, m), lambda c: c.bitwiseAND(in_line)))
        start = F.struct(F.lit(-2).cast("long").alias("last"), F.lit(0).alias("n"))
        return F.aggregate(numbers, start, lambda at, i: F.when(i - at["last"] < 2, at).otherwise(
            F.struct(i.alias("last"), (at["n"] + 1).alias("n"))), lambda at: at["n"])

    # Of 2 k + 1 chunks, k + 1 are no neighbours.
    most = 2 * allowed + 1
    cut_at = reduce(lambda at, c: F.when(F.col("base") >= c, F.lit(CUTS[c])).otherwise(at), sorted(CUTS), F.lit(" "))
    is_long = F.col("base").between(LONG_CHARS, LONG_MOST)
    cut = rows.withColumn("codes", F.when(is_long, F.sort_array(F.transform(F.split("line", cut_at, -1), code))))
    used = reduce(lambda done, m: F.when(apart(m) > allowed, m).otherwise(done), [m for m in (allowed + 5, allowed + 3) if m < most], F.lit(most))
    cut = cut.withColumn("used", F.when(is_long, used))
    few = F.when(is_long, F.when(F.size("codes") < F.col("used"), apart(most) <= allowed).otherwise(False))
    kept = F.transform(F.slice("codes", F.lit(1), F.col("used")), lambda c: F.shiftrightunsigned(c, NUMBER_BITS))
    return cut.withColumn("chunks", F.array_distinct(kept)).withColumn("few", few).drop("codes", "used")


def keys_of(distinct: DataFrame, edits: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """packed and nr for all probes of lines: 48 bits of hash (of class, segment number and
    substring, or of class and chunk), 7 of the length beyond the least one of the class, one that marks own
    keys.  Own are those that are segments of the line itself, in its own class and unshifted, and all chunks.
    Rows have two numbers, with the bytes that differ side by side, as the shuffle compresses them well so."""
    most = edits or MAX_EDITS
    rows = _chunks(_classed(distinct, edits, min_chars), most).withColumn("chars", F.length("line"))
    # What a line's probes share is made once, before them.
    rows = rows.withColumn("size", F.floor(F.col("base") / (F.col("k") + 1)).cast("int")).withColumn(
        "beyond", F.least(F.col("chars") - F.col("base"), F.lit(MOST_BEYOND)).cast("long") * 2).withColumn("by_segments", F.coalesce("few", F.lit(True)))
    pack = lambda key, own: F.shiftleft(key, KEY_SHIFT).bitwiseOR(F.shiftleft(F.col("beyond") + own, LOW_SHIFT))

    def probe(j: int, s: int) -> Column:
        """0 if the line has none: it is shorter, or its class allows too few edits."""
        start = F.col("size") * j + s
        has = F.col("by_segments") & (F.col("k") >= j + max(0, -s)) & (start >= 0) & (start + F.col("size") <= F.col("chars"))
        own = F.lit(0) if s else F.col("home").cast("int")
        return F.when(has, pack(F.xxhash64("base", F.lit(j), F.substr("line", start + 1, F.col("size"))), own)).otherwise(F.lit(0).cast("long"))

    chunks = F.coalesce(F.transform("chunks", lambda c: pack(F.xxhash64("base", c), F.lit(1))), F.array().cast("array<bigint>"))
    probes = F.concat(F.array(*[probe(j, s) for j, s in _patterns(most)]), chunks)
    # Rows are made of the finished keys, so none carries the line.  For explode() Spark would ask first
    # whether there are keys, and make them twice.
    return rows.select("nr", probes.alias("keys")).select(F.explode_outer("keys").alias("packed"), "nr").where("packed <> 0")


def signature(line: Column) -> list[Column]:
    """Four longs whose differing bits are at most the letters by which two lines
    differ in number: a byte for each of 27 characters and one for all others, that holds
    the number as a circular unary code of sixteen steps."""
    # Letters are one byte each.  The others are counted by themselves, not by all counts once more.
    counts = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c))) for c in LETTERS]
    counts.append(F.length(F.translate(line, LETTERS, "")))
    codes = F.array(*[F.lit((1 << n) - 1 if n < 8 else 255 ^ ((1 << n - 8) - 1)).cast("long") for n in range(16)])
    of = [F.get(codes, n % 16) for n in counts]
    return [reduce(Column.bitwiseOR, [F.shiftleft(c, 8 * i) for i, c in enumerate(of[at:at + 8])]) for at in range(0, 28, 8)]


def within(x: Column, y: Column, edits: int | Column) -> Column:
    """Whether two strings are within ``edits`` of each other."""
    edits = edits if isinstance(edits, Column) else F.lit(edits)
    return (F.abs(F.length(x) - F.length(y)) <= edits) & (F.call_function("levenshtein", x, y, edits) >= 0)


def shared_keys(distinct: DataFrame, edits: int | None = None, min_chars: int = MIN_CHARS) -> DataFrame:
    """nr, key, own and n (lines that own the key) of :func:`keys_of`, without the keys
    that no line owns, that only one line has, or only two whose lengths differ by more than the edits.
    One shuffle brings the keys together."""
    key = F.shiftrightunsigned("packed", KEY_SHIFT)
    keys = keys_of(distinct, edits, min_chars).repartition(key).select(
        key.alias("key"), "nr", F.shiftright("packed", LOW_SHIFT + 1).bitwiseAND(F.lit(MOST_BEYOND)).alias("beyond"),
        (F.col("packed").bitwiseAND(F.lit(1 << LOW_SHIFT)) != 0).alias("own"))
    of = Window.partitionBy("key")
    # A line can have a key twice, so of two rows both are one line's or each is one's.
    met = keys.select("*", F.count_if("own").over(of).alias("n"), F.count(F.lit(1)).over(of).alias("rows"),
                      F.min("nr").over(of).alias("low"), F.max("nr").over(of).alias("high"),
                      (F.max("beyond").over(of) - F.min("beyond").over(of)).alias("apart"))
    met = met.where((F.col("n") > 0) & (F.col("low") != F.col("high")) & ((F.col("rows") > 2) | (F.col("apart") <= (edits or MAX_EDITS))))
    return met.select("key", "nr", "own", "n")


def _reach(edits: int | None, shorter: Column) -> Column:
    return F.lit(edits) if edits else F.least(F.lit(MAX_EDITS), F.ceil(shorter / CHARS_PER_EDIT).cast("int"))


def _alike(x_n: Column, x_letters: Column, y_n: Column, y_letters: Column) -> tuple[Column, Column]:
    """By how much two lines differ in length, and at least in letters."""
    letters = [F.bit_count(F.get(x_letters, F.lit(i)).bitwiseXOR(F.get(y_letters, F.lit(i)))) for i in range(4)]
    return F.abs(x_n - y_n), reduce(Column.__add__, letters)


def _near(pairs: DataFrame, texts: DataFrame, edits: int | None) -> DataFrame:
    """(nr, place) of the later line of each pair (a, b) within reach.  Texts go only to
    pairs whose lengths and letters allow it."""
    side = lambda p, *columns: texts.select(F.col("nr").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    reach = _reach(edits, F.least("a_n", "b_n"))
    apart, letters = _alike(F.col("a_n"), F.col("a_letters"), F.col("b_n"), F.col("b_letters"))
    alike = pairs.join(side("a", "n", "letters"), "a").join(side("b", "n", "letters"), "b").where(
        (apart <= reach) & (letters <= 2 * reach - apart))
    alike = written(alike.select("a", "b"), "alike")
    met = alike.join(side("a", "first", "line"), "a").join(side("b", "first", "line"), "b").repartition("a", "b")
    close = met.where(within(F.col("a_line"), F.col("b_line"), _reach(edits, F.least(F.length("a_line"), F.length("b_line")))))
    later = F.greatest(F.struct("a_first", F.col("a").alias("nr")), F.struct(F.col("b_first").alias("a_first"), F.col("b").alias("nr")))
    return close.select(later.alias("l")).select(F.col("l.nr").alias("nr"), F.col("l.a_first").alias("place")).distinct()


def _pairs(shared: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of lines: one owns a key that the other has."""
    met = shared.where("own").select("key", F.col("nr").alias("a")).join(
        shared.select("key", F.col("nr").alias("b")), "key").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near_in(keyed: DataFrame, decided: DataFrame, texts: DataFrame, edits: int | None) -> DataFrame:
    """(nr, place) of the later line of each pair within reach that shares a key of
    ``keyed`` (nr, own_keys, keys) and is not decided.  Pairs are verified as they meet: lengths
    first, then letter counts, then the edit distance; only those within reach become rows."""
    known = decided.withColumn("done", F.lit(True))
    texts = written(texts.join(keyed, "nr").join(known, "nr", "left").withColumn("done", F.coalesce("done", F.lit(False))), "open-lines")

    def side(keys: str, name: str) -> DataFrame:
        columns = ("nr", "first", "line", "n", "done", "letters")
        return texts.select(F.explode(keys).alias(f"{name}_key"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    reach, apart = _reach(edits, F.col("a_n")), F.col("b_n") - F.col("a_n")
    letters = _alike(F.col("a_n"), F.col("a_letters"), F.col("b_n"), F.col("b_letters"))[1]
    a_first = F.col("a_first") < F.col("b_first")
    # The longer line is the one that is probed; lines of one length meet both ways round.
    once = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_nr") < F.col("b_nr")))
    # Numbers first: most pairs end there.
    wanted = (apart >= 0) & (apart <= reach) & (letters <= 2 * reach - apart) & once \
        & ~F.when(a_first, F.col("b_done")).otherwise(F.col("a_done")) \
        & (F.call_function("levenshtein", F.col("a_line"), F.col("b_line"), reach) >= 0)
    met = side("own_keys", "a").join(side("keys", "b"), (F.col("a_key") == F.col("b_key")) & wanted)
    later = F.when(a_first, F.struct(F.col("b_nr").alias("nr"), F.col("b_first").alias("place"))).otherwise(
        F.struct(F.col("a_nr").alias("nr"), F.col("a_first").alias("place")))
    return met.select(later.alias("l")).select("l.*").distinct()


def _by_line(shared: DataFrame) -> DataFrame:
    """nr, own_keys and keys: a line has at most some eighty keys."""
    return shared.groupBy("nr").agg(F.collect_set(F.when(F.col("own"), F.col("key"))).alias("own_keys"),
                                    F.collect_set("key").alias("keys"))


def near_lines(distinct: DataFrame, edits: int | None = None, dense: int = DENSE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Places of first occurrences that have an earlier one within reach;
    ``distinct`` is a written table of :func:`distinct_lines` with numbers nr."""
    distinct = distinct.where(F.length("line") >= least_chars(edits, min_chars))
    shared = written(shared_keys(distinct, edits, min_chars), "shared")
    # Texts are moved once, and only those of lines that have candidates.
    wanted = written(shared.select("nr").distinct(), "wanted")
    texts = written(distinct.select("nr", "first", "line", F.length("line").alias("n")).join(if_small(wanted, 4 * SMALL_ROWS), "nr", "left_semi")
                    .withColumn("letters", F.array(*signature(F.col("line")))), "texts")
    few = written(_pairs(shared.where(F.col("n") <= dense)), "pairs")
    near = _near(few, texts, edits)
    many = shared.where(F.col("n") > dense)
    if many.isEmpty():
        return near.select("place.*")
    # Lines of dense keys against the earliest of each.
    lines_of = written(_by_line(many), "members")
    placed = written(lines_of.join(texts.select("nr", "first"), "nr").select("nr", "first", F.explode("keys").alias("key")), "placed")
    heads = placed.groupBy("key").agg(F.min(F.struct("first", "nr")).alias("head")).select("key", F.col("head.nr").alias("head"))
    met = written(placed.select("key", "nr").join(heads, "key").where("nr <> head"), "met")
    leads = met.select(F.least("nr", "head").alias("a"), F.greatest("nr", "head").alias("b"))
    near = written(near.unionByName(_near(written(leads.distinct(), "leads"), texts, edits)).distinct(), "near")
    decided = near.select("nr").distinct()
    left = written(met.join(decided, "nr", "left_anti").select("key").distinct(), "open")
    if left.isEmpty():
        return near.select("place.*")
    open_keys = _by_line(many.join(if_small(left), "key", "left_semi"))
    return near.unionByName(_near_in(open_keys, decided, texts, edits)).select("place.*").distinct()


def removed_lines(docs: DataFrame, edits: int | None = None, min_chars: int = MIN_CHARS, dense: int = DENSE,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, exact and near: arrays of the line numbers a document loses."""
    all_lines = lines(docs, id_col, text_col)
    found = written(all_lines.drop("line"), "lines")
    # The numbers are written with the lines, so they stay.
    distinct = written(distinct_lines(all_lines).withColumn("nr", F.monotonically_increasing_id()), "distinct-lines")
    later = later_occurrences(found, distinct).withColumn("near", F.lit(False))
    near = near_lines(distinct, edits, dense, min_chars).select(*PLACE).withColumn("near", F.lit(True))
    return written(later.unionByName(near).groupBy("id", "th").agg(
        F.sort_array(F.collect_list(F.when(~F.col("near"), F.col("line_no")))).alias("exact"),
        F.sort_array(F.collect_list(F.when(F.col("near"), F.col("line_no")))).alias("near")), "removed")


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of the columns of ``docs``), text, kept (the text without the lines
    of ``removed``; the text itself if there are none), n_exact and n_near (lines removed)."""
    d = with_decisions(nested(docs, id_col, text_col), removed)
    touched = F.col("exact").isNotNull()
    all_lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # Bound by a function, as a text split inside another one would be split again for each line.
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.concat("exact", "near"))
    joined = lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n")
    kept = F.get(F.transform(F.array(all_lines), joined), F.lit(0))
    count = lambda c: F.when(touched, F.size(c)).otherwise(0).cast("long")
    return d.select("row", "text", F.when(touched, kept).otherwise(F.col("text")).alias("kept"),
                    count("exact").alias("n_exact"), count("near").alias("n_near"))


def remove_lines(docs: DataFrame, edits: int | None = None, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``docs`` without the removed lines, columns as they are.  A document
    that loses lines goes only if no word of it is left."""
    d = without_lines(docs, removed_lines(docs, edits, min_chars, DENSE, id_col, text_col), id_col, text_col)
    lost = F.col("n_exact") + F.col("n_near") > 0
    return spread(d.where(~(lost & (F.size(words(F.col("kept"))) == 0))), docs, text_col, F.col("kept"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: lines of all documents that repeat an earlier line."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = without_lines(docs, removed_lines(docs))
    text, kept = F.coalesce("text", F.lit("")), F.coalesce("kept", F.lit(""))
    return d.select("row.doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                    "n_exact", "n_near", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
