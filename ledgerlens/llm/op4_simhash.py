"""Near-duplicate groups by SimHash fingerprints.

Fingerprints: A-Z lower-cased words, 3-word shingles with repeats (the whole
sequence if there are fewer words), XXH64 with seed 42; a bit is set if it is
set in over half of the shingle hashes.  Texts without words have fingerprint
zero and link like any other.

Links: distinct fingerprints are cut into ``distance + 2`` blocks; two that
differ in at most ``distance`` bits agree in at least two blocks, so they meet
in the join on one of the pairs of blocks, and the Hamming distance of every
pair that meets is verified.  A bucket of a join key with more than ``dense``
fingerprints is not paired off: its members meet at the points one bit away
from each of them, of which two within two bits always share one, and such a
point has at most one fingerprint for each free bit.  That is exact as well and
linear in the size of the bucket.  Components then come from the link table.

Defined results: null text is the empty text; equal fingerprints always share a
component; rows that share a doc_id are rows of their own; component_id is null
only where all ids of a component are; an empty table gives an empty result;
columns other than id and text are not read.  :func:`remove_near_duplicates`
keeps one row of each component: the smallest id (null after all others), then
the smallest hash of the text, then the smallest of the other columns.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, if_small, nested, read_table, same_text, spread, text_bytes, written
from .graph import connected_components

SHINGLE = 3
DISTANCE = 2
DENSE = 32
#: Long texts are taken in pieces of about this many bytes.
PIECE = 1 << 20


def _word_pieces(raw: bytes, size: int = PIECE):
    """Lists of the words of a text, taken piece by piece."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end].split()
        at = end


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a UTF-8 text."""
    import xxhash
    hash_ = partial(xxhash.xxh64_intdigest, seed=42)
    set_bits, n, tail = np.zeros(64, np.int64), 0, []
    for words in _word_pieces(raw.lower()):
        words = tail + words
        count = len(words) - shingle + 1
        if count > 0:
            texts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
            hashes = np.fromiter(map(hash_, texts), "<u8", count)
            for i in range(0, count, 1 << 14):
                bits = np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                set_bits += bits.sum(axis=0, dtype=np.int64)
            n += count
        tail = words[max(0, count):] if count > 0 else words
    if not n:
        if not tail:
            return 0
        n = 1
        set_bits = np.unpackbits(np.array([hash_(b" ".join(tail))], "<u8").view(np.uint8), bitorder="little").astype(int)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprinter(shingle: int):
    def make():
        return lambda batch: {name: batch.column(name) for name in batch.schema.names if name != "text"} | {"fp": np.array(
            [fingerprint(raw, shingle) for raw in text_bytes(batch)], np.uint64).view(np.int64)}
    return make


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
                 with_hash: bool = False) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long.  On
    request also th, the hash of the text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[_text_hash(text_col).alias("th")] * with_hash)
    return arrow_map(rows, f"id {id_type}" + ", th long" * with_hash + ", fp long", _fingerprinter(shingle))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """(a, b) links between the distinct fingerprints ``fp`` of ``prints`` that
    connect exactly those within ``distance`` bits of each other."""
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    edges = [round(64 * i / (distance + 2)) for i in range(distance + 3)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    keys = F.array(*[F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    rows = prints.select("fp", F.inline(keys))
    sizes = rows.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(rows.join(sizes, ["pair", "key"]), "blocks")
    # Buckets of bounded size: all pairs in them, verified before they are made rows.
    members = F.array_sort("fps")
    pairs = F.flatten(F.transform(members, lambda x: F.transform(
        F.filter(members, lambda y: (y > x) & (_apart(x, y) <= distance)),
        lambda y: F.struct(x.alias("a"), y.alias("b")))))
    few = met.where(F.col("n") <= dense).groupBy("pair", "key").agg(F.collect_list("fp").alias("fps"))
    few = few.select(F.inline(pairs))
    # Dense buckets: meet at the points one free bit away, and verify.
    free = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    points = F.concat(F.array("fp"), F.transform(F.element_at(free, F.col("pair") + 1), lambda bit: F.col("fp").bitwiseXOR(bit)))
    many = met.where(F.col("n") > dense).select("fp", F.explode(points).alias("point"))
    # All that share a point are within two bits; within one bit they are of the point itself.
    middle = F.min("fp") if distance == 2 else F.max(F.when(F.col("fp") == F.col("point"), F.col("fp")))
    many = many.groupBy("point").agg(middle.alias("a"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    many = many.select("a", F.explode("fps").alias("b")).where((F.col("a") != F.col("b")) & (_apart(F.col("a"), F.col("b")) <= distance))
    return few.unionByName(many).distinct()


def component_roots(prints: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """(fp, least, root) for every distinct fingerprint: its smallest id and the
    fingerprint that stands for its component."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = written(connected_components(links(distinct, distance, dense)), "roots")
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").drop("node")
    return classes.withColumn("root", F.coalesce("root", "fp"))


def components(prints: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """``prints`` (id, fp; a written table, it is read more than once) with
    component_id."""
    linked = component_roots(prints, distance, dense)
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = linked.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return prints.join(of_print, F.col("fp") == F.col("__fp")).drop("__fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, dense: int = DENSE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    out = components(prints, distance, dense)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def remove_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, dense: int = DENSE,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component, columns as they are."""
    prints = written(fingerprints(docs, shingle, id_col, text_col, with_hash=True), "fingerprints")
    roots = component_roots(prints, distance, dense).select(F.col("fp").alias("__fp"), "root")
    texts = prints.groupBy("id", "th").agg(F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th").alias("place")
    texts = written(texts.join(roots, F.col("fp") == F.col("__fp")).select("id", "th", "n", "root", place), "texts")
    stays = texts.groupBy(F.col("root").alias("__root")).agg(F.min("place").alias("stays"))
    met = texts.join(stays, F.col("root") == F.col("__root")).withColumn("one", F.col("place").eqNullSafe(F.col("stays")))
    met = written(met.where("NOT one OR n > 1").select("id", "th", "one"), "more")
    rows = nested(docs, id_col, text_col)
    rest = rows.join(if_small(met), same_text(rows, met), "left_anti")
    # Repeated rows of the text that stays: one of them, found by an aggregate.  Rows
    # are told apart by their JSON form, as a map has no order.
    again = met.where("one")
    if again.isEmpty():
        return spread(rest, docs)
    repeated = rows.join(if_small(again), same_text(rows, again), "left_semi")
    once = repeated.groupBy("id", "th").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return spread(rest.select("row").unionByName(once.select("row")), docs)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: near-duplicate components of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))
