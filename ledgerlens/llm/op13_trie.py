"""Prefix trie of conversations: who shares which first turns, and what sharing
their computation would save.

1. The turns of a conversation are numbered, and a stream over (conversation, turn)
   chains their digests, so that every prefix has one digest of 128 bits.  Texts
   leave the plan here; their code points stay.
2. A count-min sketch of all prefix digests screens them.  Only "one" or "more"
   is asked, so its counters are bits: a cell is set if two or more prefixes fell into it.
   A prefix with an empty cell in any row is proved to be of one conversation; its
   node and all below are a tail, which is emitted where it stands.
3. Possibly shared prefixes are grouped exactly by digest (members, smallest
   member, ends), and joined back to their rows.
4. Sums over subtrees become sums over members: a node's text is saved by every
   member but the smallest, so a conversation's suffix sum of saved texts, added up
   over the members of a node, is the sum over its subtree.  Leaves and children are
   counted the same way, by their smallest members.  No pair of a node and an
   ancestor is ever made.
5. The conversations that end in a node are hashed as a stream over sorted chunks of ids.

Each key is aggregated map-side before it is shuffled.  The sketch has ``CELLS``
bits for each prefix up to ``MAX_BITS`` (32 MB) a row, the proven bound of its broadcast;
beyond, more prefixes than needed go the exact way, with the same result.  A
conversation is streamed through one task in order, and so are the sorted ids of a node.

Defined results: null role or text is empty; a null turn comes first; turns of equal
number are ordered by a digest of role and text, and repeated rows count as turns;
rows without a conversation id belong to no conversation and are left out; an empty
table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

DIGEST = 16
ROOT = bytes(DIGEST)
#: Sketch: rows, cells for each prefix, and bounds of a row's bits (powers of two).
ROWS, CELLS, MIN_BITS, MAX_BITS = 2, 8, 1 << 16, 1 << 28
#: Bits of one stored piece of the sketch (the size of Spark's bitmaps), and ids of one chunk.
PIECE_BITS, CHUNK_IDS_LOG2 = 32768, 10
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest, n_chars and last of every turn."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    full = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                        F.substring(F.unhex(full), 1, DIGEST).alias("digest"), F.length(text).cast("long").alias("n_chars")) \
        .where(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", "digest", "n_chars", F.row_number().over(order).cast("long").alias("pos"),
                       F.lead(F.lit(1)).over(order).isNull().alias("last"))


def inherited(numbered: DataFrame, own_base: Column, n_turns: Column, most: int) -> DataFrame:
    """Conversations rebuilt: the first ``n_turns`` turns (at most ``most``) of the
    conversation ``own_base``, then the own turns after as many.  Rows are in the
    order of (conv_id, kind, pos); a row of kind 2 ends each conversation."""
    convs = numbered.where("last").select("conv_id", own_base.alias("base"), n_turns.alias("h"))
    firsts = numbered.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "digest", "n_chars")
    taken = convs.where("h > 0").join(firsts, "base").where("pos <= h") \
        .select("conv_id", F.lit(0).alias("kind"), "pos", "digest", "n_chars")
    own = numbered.where(F.col("pos") > n_turns).select("conv_id", F.lit(1).alias("kind"), "pos", "digest", "n_chars")
    end = convs.select("conv_id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("pos"),
                       F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    return taken.unionByName(own).unionByName(end)


def prefix_digests(rebuilt: DataFrame) -> DataFrame:
    """A row for every prefix of every conversation, the empty one included:
    conv_id, depth, key, before (key of the prefix one turn shorter), n_chars of its
    last turn, last (the whole conversation)."""
    schema = "conv_id long, depth long, key binary, before binary, n_chars long, last boolean"

    def chain(batches):
        import pyarrow as pa
        types = {"conv_id": pa.int64(), "depth": pa.int64(), "key": pa.binary(), "before": pa.binary(),
                 "n_chars": pa.int64(), "last": pa.bool_()}
        held = None     # the prefix whose successor is not known yet
        for batch in batches:
            out = []
            for conv, kind, digest, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "digest", "n_chars"))):
                if held is None:
                    held = (conv, 0, ROOT, None, 0)
                if kind == 2:
                    out.append((*held, True))
                    held = None
                else:
                    out.append((*held, False))
                    key = hashlib.blake2b(held[2] + digest, digest_size=DIGEST).digest()
                    held = (conv, held[1] + 1, key, held[2], n)
            cols = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values())], names=list(types))

    return rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "pos").mapInArrow(chain, schema)


class Sketch:
    """Count-min sketch of digests with counters that tell none, one and more apart
    only as far as "more than one" (a bit)."""

    def __init__(self, keys: DataFrame, n_keys: int):
        """``keys``: a column ``key``, one row for each counted digest."""
        self.bits = min(MAX_BITS, max(MIN_BITS, 1 << (CELLS * max(1, n_keys) - 1).bit_length()))
        cells = keys.select(F.explode(F.array(*[self._cell(F.col("key"), r) for r in range(ROWS)])).alias("cell"))
        more = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
        self.pieces = written(more.groupBy(F.expr(f"cell div {PIECE_BITS}").alias("piece"))
                              .agg(F.bitmap_construct_agg(F.col("cell") % PIECE_BITS).alias("bits")), "sketch")

    def _cell(self, key: Column, row: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(row)), F.lit(self.bits)) + row * self.bits

    def probe(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with a boolean column: may ``key`` have been counted more than once?"""
        answers = []
        for r in range(ROWS):
            piece, bits = f"{name}_piece{r}", f"{name}_bits{r}"
            table = F.broadcast(self.pieces.select(F.col("piece").alias(piece), F.col("bits").alias(bits)))
            cell = self._cell(F.col(key), r)
            at = cell % PIECE_BITS
            rows = rows.join(table, F.floor(cell / PIECE_BITS) == F.col(piece), "left")
            byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            answers.append(F.col(bits).isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1))
        kept = [c for c in rows.columns if not c.startswith((f"{name}_piece", f"{name}_bits"))]
        return rows.select(*kept, F.coalesce(reduce(Column.__and__, answers), F.lit(False)).alias(name))


def screened(prefixes: DataFrame, sketch: Sketch) -> DataFrame:
    """Prefixes of one turn and more with ``open`` (the node above may be shared) and
    ``shared`` (so may this one).  What is not open is a tail."""
    rows = sketch.probe(sketch.probe(prefixes.where("depth > 0"), "key", "more"), "before", "more_before")
    opened = (F.col("depth") == 1) | F.col("more_before")
    return rows.select("conv_id", "depth", "key", "n_chars", "last", opened.alias("open"),
                       (opened & F.col("more")).alias("shared"))


def id_list_digests(enders: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ascending decimal conv_ids of a key, joined
    by commas.  Ids are joined in chunks of neighbours first; the chunks of a key are
    then hashed in order, one after the other, none of them kept."""
    chunks = enders.groupBy("key", F.shiftright("conv_id", CHUNK_IDS_LOG2).alias("chunk")) \
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids")) \
        .select("key", "chunk", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))

    def fold(batches):
        import pyarrow as pa
        key = state = None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()),
                                              pa.array([o[1] for o in out], pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                                             names=["key", "ends_sha256"])

    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(fold, "key binary, ends_sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations (:func:`inherited`)."""
    prefixes = written(prefix_digests(rebuilt), "prefixes")
    whole = prefixes.where("depth = 0").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"),
                                            F.coalesce(F.sum(F.col("last").cast("long")), F.lit(0)).alias("n_ends")).first()
    deeper = prefixes.where("depth > 0").select("key")
    rows = screened(prefixes, Sketch(deeper, deeper.count()))
    own_ends = F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def alone(nodes: DataFrame, parent: Column) -> DataFrame:
        return nodes.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"),
                            F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
                            zero.alias("saved_tokens"), own_ends.alias("ends_sha256"))

    tails = alone(rows.where("NOT open"), F.col("conv_id"))

    # Possibly shared prefixes and the heads of the tails below them.
    part = written(rows.where("open").drop("open"), "possibly-shared")
    exact = part.where("shared").groupBy("key").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.min(F.when(F.col("last"), F.col("conv_id"))).alias("end_id"))
    known = part.join(exact, "key", "left").withColumns({
        "n_convs": F.coalesce("n_convs", F.lit(1)), "owner": F.coalesce("owner", "conv_id"),
        "n_ends": F.coalesce("n_ends", F.col("last").cast("long"))})
    own = F.col("owner") == F.col("conv_id")
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    is_leaf = F.when(F.col("last"), own & (F.col("n_ends") == F.col("n_convs"))).otherwise(F.lit(True))
    below = F.when(F.lag("depth").over(up) == F.col("depth") + 1, F.lag(own).over(up)).otherwise(~F.col("last"))
    parent = F.when(F.col("depth") == 1, F.lit(whole["first"])) \
        .when(F.lead("depth").over(up) == F.col("depth") - 1, F.lead("owner").over(up)).otherwise(F.col("conv_id"))
    members = written(known.select(
        "conv_id", "depth", "key", "last", "shared", "n_convs", "owner", "n_ends", "end_id",
        F.sum(F.when(own, 0).otherwise(F.col("n_chars"))).over(so_far).alias("saved"),
        F.first(is_leaf.cast("long")).over(so_far).alias("leaf"), below.cast("long").alias("child"),
        parent.cast("long").alias("parent")), "members")

    root_ends = prefixes.where("depth = 0 AND last").select("key", "conv_id")
    ends = id_list_digests(members.where("shared AND last AND n_ends > 1").select("key", "conv_id").unionByName(root_ends))
    shared = members.where("shared").groupBy("key", "depth").agg(
        F.max("owner").alias("conv_id"), F.max(F.when(own, F.col("parent"))).alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.max("n_ends").alias("n_ends"), F.max("end_id").alias("end_id"))
    ends = written(ends, "ends")
    ending = F.when(F.col("n_ends") == 0, F.lit(NO_ENDS)) \
        .when(F.col("n_ends") == 1, F.sha2(F.col("end_id").cast("string").cast("binary"), 256)).otherwise(F.col("ends_sha256"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = written(shared.join(ends, "key", "left").withColumn("ends_sha256", ending).select(*columns)
                    .unionByName(alone(members.where("NOT shared"), F.col("parent"))), "nodes")
    at_root = nodes.where("depth = 1").select(one.alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends")) \
        .unionByName(ends.where(F.col("key") == F.lit(ROOT)).select(zero.alias("child"), zero.alias("n_leaves"),
                                                                    zero.alias("saved_tokens"), F.col("ends_sha256").alias("ends")))
    children = F.coalesce(F.sum("child"), zero)
    root = at_root.agg(
        F.lit(whole["first"]).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(whole["n"]).cast("long").alias("n_convs"), children.alias("n_children"),
        F.when(children > 0, F.sum("n_leaves")).otherwise(one).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), zero).alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.lit(NO_ENDS)).alias("ends_sha256")).where(F.col("n_convs") > 0)
    return root.unionByName(nodes).unionByName(tails)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the trie of all conversations, each taking its first turns from the
    first conversation of its hundred."""
    turns = numbered_turns(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    base = F.try_subtract(F.col("conv_id"), F.pmod(F.col("conv_id"), F.lit(100)))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return trie(inherited(written(turns, "turns"), base, h, 5))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS turns,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
               lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))) % 6 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS path
  FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - ((c.conv_id % 100) + 100) % 100),
p AS (
  SELECT conv_id, path[1:d] AS path, d, d = len(path) AS ends
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM r)),
g AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends
  FROM p GROUP BY path, d),
k AS (
  SELECT a.path, a.d, a.conv_id, a.n, a.ends, b.conv_id AS parent,
         (a.n - 1) * CASE WHEN a.d > 0 THEN length(a.path[a.d].text) ELSE 0 END AS saved,
         NOT EXISTS (SELECT 1 FROM g x WHERE x.d = a.d + 1 AND x.path[1:a.d] = a.path) AS leaf
  FROM g a LEFT JOIN g b ON b.d = a.d - 1 AND b.path = a.path[1:a.d - 1])
SELECT v.conv_id, v.d AS depth, v.parent AS parent_conv_id, v.n AS n_convs,
       count(*) FILTER (u.d = v.d + 1) AS n_children, count(*) FILTER (u.leaf) AS n_leaves,
       sum(u.saved)::BIGINT AS saved_tokens, v.ends AS ends_sha256
FROM k v JOIN k u ON u.d >= v.d AND u.path[1:v.d] = v.path
GROUP BY v.path, v.d, v.conv_id, v.n, v.parent, v.ends
"""
