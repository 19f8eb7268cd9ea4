"""Exact deduplication by composable polynomial fingerprints.

A text (A-Z lower-cased, null as empty) is cut into byte chunks.  Every chunk
is hashed on its own as a polynomial in a fixed base modulo a prime; a chunk
hash shifted by the bytes that follow it adds up, over all chunks, to the hash
of the whole text.  Chunks of a huge document are therefore separate rows and
Spark's ``sum`` is the combiner.  Texts of equal fingerprint and length are then
compared chunk by chunk with the text of the row that stays, so the result does
not rest on the hash: colliding texts form groups of their own.

Defined results: null text is the empty text; all empty texts are one group;
rows that share a doc_id share its decision; a null doc_id never stays while
its group has a non-null one; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, ascii_lower, read_table, written

CHUNK_BYTES = 1 << 16
#: Two primes below 2**31 and a base for each: a byte times a power fits 39
#: bits, so 2**25 products can be summed in 64 bits without overflow.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 911382323)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, *keep: str) -> DataFrame:
    """One row per chunk: the kept columns, chunk number ``c`` and ``chunk``
    (bytes, not yet lower-cased), ``after`` (bytes of the text behind it) and
    ``n_bytes``.  An empty text has one empty chunk."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.octet_length(raw).cast("long")
    count = F.greatest(F.ceil(n / chunk_bytes).cast("int"), F.lit(1))
    chunks = F.transform(F.sequence(F.lit(0), count - 1),
                         lambda i: F.substring(raw, i * chunk_bytes + 1, F.lit(chunk_bytes)))
    rows = docs.select(F.col(id_col).alias("id"), *keep, n.alias("n_bytes"), F.posexplode(chunks).alias("c", "chunk"))
    return rows.withColumn("after", F.greatest(F.col("n_bytes") - (F.col("c").cast("long") + 1) * chunk_bytes,
                                               F.lit(0).cast("long")))


def _hasher(chunk_bytes: int, primes, bases):
    def make():
        powers = []
        for p, b in zip(primes, bases):
            row = np.empty(chunk_bytes, np.int64)
            x = 1
            for i in range(chunk_bytes):
                row[i] = x
                x = x * b % p
            powers.append(row[::-1].copy())

        def step(batch):
            cols = {n: batch.column(n) for n in batch.schema.names}
            hashes = [[] for _ in primes]
            for chunk, after in zip(cols["chunk"], cols["after"].to_pylist()):
                data = np.frombuffer((chunk.as_py() or b"").lower(), np.uint8).astype(np.int64)
                for out, p, b, table in zip(hashes, primes, bases, powers):
                    h = int((data * table[chunk_bytes - len(data):]).sum()) % p if len(data) else 0
                    out.append(h * pow(b, after, p) % p)
            return {"row": cols["row"], "id": cols["id"], "th": cols["th"], "sha": cols["sha"], "n_bytes": cols["n_bytes"],
                    "h1": hashes[0], "h2": hashes[1]}
        return step
    return make


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
                 primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per input row: id, th (64-bit hash of the raw text, which tells
    rows that share an id apart), sha (SHA-256 of the normalised text, hex),
    n_bytes, h1, h2 (the combined polynomial hashes)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)
    # The row number only keeps rows apart while their chunks are summed.
    rows = docs.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("row"), sha.alias("sha"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"))
    chunks = chunk_rows(rows, id_col, text_col, chunk_bytes, "row", "th", "sha")
    # The digest travels with the first chunk only.
    chunks = chunks.withColumn("sha", F.when(F.col("c") == 0, F.col("sha")))
    parts = arrow_map(chunks.select("row", "id", "th", "sha", "n_bytes", "chunk", "after"),
                      f"row long, id {id_type}, th long, sha string, n_bytes long, h1 long, h2 long",
                      _hasher(chunk_bytes, primes, bases))
    total = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("th").alias("th"), F.max("sha").alias("sha"), F.max("n_bytes").alias("n_bytes"),
                                     F.pmod(F.sum("h1"), F.lit(primes[0])).alias("h1"),
                                     F.pmod(F.sum("h2"), F.lit(primes[1])).alias("h2"))
    return total.drop("row")


def _same_text(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(id, th) of the rows of ``members`` (id, th, keep, keep_th) whose text
    differs from that of the row that stays.  Only the chunks of members are
    moved on, and only chunks of one number within one group meet."""
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("__id"), key.alias("__th"), F.col(text_col).alias("__text"))
    texts = texts.join(members, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__th") == F.col("th"))).select(
        "__id", "__th", "__text", "keep", "keep_th")
    chunks = chunk_rows(texts, "__id", "__text", chunk_bytes, "__th", "keep", "keep_th").drop("after", "n_bytes")
    # Cut characters do no harm: the comparison is byte by byte.
    chunks = chunks.withColumn("chunk", ascii_lower(F.decode("chunk", "ISO-8859-1")))
    kept = chunks.where(F.col("id").eqNullSafe(F.col("keep")) & (F.col("__th") == F.col("keep_th"))).select(
        F.col("keep").alias("__k"), F.col("keep_th").alias("__kth"), F.col("c").alias("__c"),
        F.col("chunk").alias("__chunk")).dropDuplicates(["__k", "__kth", "__c"])
    pairs = chunks.join(kept, F.col("keep").eqNullSafe(F.col("__k")) & (F.col("keep_th") == F.col("__kth"))
                        & (F.col("c") == F.col("__c")), "left")
    same = F.coalesce(F.col("chunk") == F.col("__chunk"), F.lit(False))
    return pairs.groupBy("id", F.col("__th").alias("th")).agg(F.min(same).alias("same")).where(~F.col("same")).drop("same")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES,
                primes=PRIMES, bases=BASES) -> DataFrame:
    """One row per input row: id, keep_id (largest id of the equal texts),
    group_size, kept, text_sha256."""
    prints = written(fingerprints(docs, id_col, text_col, chunk_bytes, primes, bases), "prints")
    fp = ["n_bytes", "h1", "h2"]
    open_rows, settled = prints, []
    while True:
        groups = open_rows.groupBy(*fp).agg(F.max(F.struct("id", "th")).alias("k"), F.count(F.lit(1)).alias("size"))
        # Written, so that the join back reads it as a side of its own and Spark may split a hot group.
        groups = written(groups.where("size > 1").select(*[F.col(c).alias(f"__{c}") for c in fp], "size", F.col("k.id").alias("keep"),
                                                         F.col("k.th").alias("keep_th")), "groups")
        same = (F.col("n_bytes") == F.col("__n_bytes")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
        alone = F.col("size").isNull()
        dealt = open_rows.join(groups, same, "left").select(
            "id", "th", "sha", *fp, F.coalesce("size", F.lit(1).cast("long")).alias("size"),
            F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"),
            F.when(alone, F.col("th")).otherwise(F.col("keep_th")).alias("keep_th"))
        members = dealt.where(F.col("size") > 1).select("id", "th", "keep", "keep_th").distinct()
        differ = written(_same_text(docs, members, id_col, text_col, chunk_bytes), "differ")
        if differ.isEmpty():
            settled.append(dealt.select("id", "sha", "keep", "size"))
            break
        # A collision: rows equal to the kept text are settled, the others
        # are grouped anew among themselves.
        differ = differ.select(F.col("id").alias("__d"), F.col("th").alias("__dth"))
        dealt = written(dealt.join(differ, F.col("id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__dth")), "left")
                        .withColumn("differs", F.col("__dth").isNotNull()).drop("__d", "__dth", "size"), "dealt")
        done = dealt.where(~F.col("differs"))
        sizes = done.groupBy(*fp).agg(F.count(F.lit(1)).alias("size"))
        settled.append(done.join(sizes, fp).select("id", "sha", "keep", "size"))
        open_rows = dealt.where("differs").select("id", "th", "sha", *fp)
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"),
                         F.col("size").cast("long").alias("group_size"),
                         F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: exact groups of all documents."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
