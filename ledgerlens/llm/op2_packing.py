"""Best-fit packing of documents into sequences by linear grouping.

1. Documents are encoded in tasks (ids plus an end id); only documents longer
   than the capacity are cut, into full pieces and a rest.
2. The plan needs only the histogram of piece lengths, which has at most
   ``capacity`` entries however large the corpus is; it is made on the driver:
   large lengths form groups of equal cardinality and are rounded up to the
   largest of their group; configurations of these few sizes are chosen, the
   fullest first; the actual pieces take the places of the rounded ones; small
   pieces go, longest first, where they leave the least room.
3. The plan is a list of runs: equal sequences, each with the lengths it holds.
   A piece finds its place by its length and its rank among the pieces of that
   length.  Ranks come from counts by length and hash bucket, so no task has
   to see all pieces of one length.

Defined results: null text is the empty text (one piece of one id, the end);
an empty table gives an empty result; rows that share a doc_id are packed each
on their own; columns other than id and text are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, read_table, uncollected, written

CAPACITY = 2048
END_ID = 0
#: Linear grouping: number of groups, and the share of the capacity from which
#: a piece counts as large.
GROUPS = 512
LARGE = 1 / 4
BUCKETS = 64
CACHE_CHUNKS = 400_000
CACHE_BYTES = 64
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 8 << 20
SIGNS = b".,;:!?%$&*#|)"


class ChunkEncoder:
    """Token ids of whole texts through the tokenizers library.  Its
    pre-tokenizer drops white space, never joins across it, and parts letters
    from other characters, so a text is the sequence of its chunks between
    spaces and line ends, and a chunk that is letters with signs behind them is
    the letters and the signs.  Where normalising turns the last letter into
    more than letters (a mark would join the signs), the chunk stays whole.  The
    ids of chunks seen lately are kept, in two generations of bounded size."""

    def __init__(self, tokenizer_file: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.batch = partial(tokenizer.encode_batch_fast, add_special_tokens=False)
        self.text = partial(tokenizer.encode, add_special_tokens=False)
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    @staticmethod
    def _ends_in_letter(chunk: str) -> bool:
        """Whether the chunk ends in a letter before and after NFC and lower-casing."""
        last = chunk[-1:]
        if last.isascii():
            return last.isalpha()
        return last.isalpha() and last.lower().isalpha() and unicodedata.normalize("NFC", chunk) == chunk

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: as one text of which each is a word."""
        if not words:
            return []
        got = self.text(" ".join(words))
        ends = np.flatnonzero(np.diff(np.array(got.word_ids, np.int64))) + 1
        if len(ends) + 1 != len(words):  # some letter is more than one word to the tokenizer
            return [np.array(e.ids, "<u4").tobytes() for e in self.batch(words)]
        ids = np.array(got.ids, "<u4").tobytes()
        ends = [0, *(ends * 4).tolist(), len(ids)]
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """Puts the ids of the chunks into the cache; returns those of chunks
        too long for it."""
        new, old = self.new, self.old
        parts, unknown = [], {}
        for chunk in chunks:
            ids = old.pop(chunk, None)
            if ids is not None:
                new[chunk] = ids
                continue
            letters = chunk.rstrip(SIGNS)
            if len(letters) == len(chunk) or not self._ends_in_letter(letters.decode()):
                unknown[chunk] = None
                continue
            signs = chunk[len(letters):]
            parts.append((chunk, letters, signs))
            for part in (letters, signs):
                if part not in new:
                    unknown[part] = unknown.get(part) or old.pop(part, None)
        words, others = [], []
        for chunk, ids in unknown.items():
            if ids is None:
                (words if chunk.decode().isalpha() else others).append(chunk)
        for at in range(0, len(words), 500):
            part = words[at:at + 500]
            unknown.update(zip(part, self._words([c.decode() for c in part])))
        for chunk, got in zip(others, self.batch([c.decode() for c in others])):
            unknown[chunk] = np.array(got.ids, "<u4").tobytes()
        for chunk, letters, signs in parts:
            unknown[chunk] = (new.get(letters) or unknown[letters]) + (new.get(signs) or unknown[signs])
        long = {c: ids for c, ids in unknown.items() if len(c) > CACHE_BYTES}
        new.update(unknown)
        for chunk in long:
            del new[chunk]
        return long

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (little-endian, unsigned), and the place
        at which each text ends.  Each distinct chunk is looked up once."""
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.new) >= CACHE_CHUNKS:
            self.old, self.new = self.new, {b"": b""}
        long = self._learn(set(distinct).difference(self.new))
        known = self.new
        ids = [known[c] if c in known else long[c] for c in distinct] if long else list(map(known.__getitem__, distinct))
        table = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        of = coded.indices.to_numpy(zero_copy_only=False)
        many = sizes[of]
        ends = np.cumsum(many)
        # The ids of an occurrence follow one another in the table, too.
        place = np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - many), many)
        place += np.arange(len(place))
        return table[place], np.concatenate(([0], ends))[chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()]


@lru_cache(maxsize=1)
def _chunk_encoder(tokenizer_file: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker process."""
    return ChunkEncoder(tokenizer_file)


def _piecer(tokenizer_file: str, capacity: int, end_id: int, with_ids: bool):
    def make():
        encoder = _chunk_encoder(tokenizer_file)
        end = np.array([end_id], "<u4")
        width = capacity

        @uncollected
        def step(batch):
            out = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32", "ids")}
            keys = batch.column("id").to_pylist()
            texts = pc.fill_null(batch.column("text"), "")
            before = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(before, before[at] + GROUP_BYTES, "right")) - 1)
                ids, ends = encoder.encode(texts[at:to])
                first = 0
                for key, last in zip(keys[at:to], ends.tolist()):
                    own = np.concatenate((ids[first:last], end))
                    for piece, start in enumerate(range(0, len(own), width)):
                        part = own[start:start + width]
                        out["id"].append(key)
                        out["piece"].append(piece)
                        out["start"].append(start)
                        out["length"].append(len(part))
                        out["ids_crc32"].append(zlib.crc32(part))
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                    first = last
                at = to
            return out
        return step
    return make


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of the encoded documents: id, piece, start, length, ids_crc32
    and, on request, ids."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return arrow_map(docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), schema,
                     _piecer(tokenizer_file, capacity, end_id, with_ids))


# --- the plan, from the histogram of lengths -------------------------------


def grouped(hist: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Linear grouping: lengths, longest first, in at most ``groups`` groups of
    equal cardinality; a group is a list of (length, count)."""
    share = max(1, -(-sum(hist.values()) // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(hist, reverse=True):
        n = hist[length]
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n -= take
            room -= take
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """The configuration with the largest remaining size that fills the capacity
    best, as a count for each size; among equally full ones, that of the
    largest sizes.  A bounded subset-sum over capacity x sizes."""
    first = next(k for k, n in enumerate(left) if n)
    left = [n - (k == first) for k, n in enumerate(left)]
    capacity -= sizes[first]
    reach = np.zeros((len(sizes) + 1, capacity + 1), bool)
    reach[len(sizes), 0] = True
    for k in range(len(sizes) - 1, -1, -1):
        row = reach[k + 1].copy()
        size = sizes[k]
        shifted, most = reach[k + 1], min(left[k], capacity // size)
        for c in range(1, most + 1):
            row[c * size:] |= shifted[:capacity + 1 - c * size]
        reach[k] = row
    total = int(np.flatnonzero(reach[0])[-1])
    counts = []
    for k, size in enumerate(sizes):
        for c in range(min(left[k], total // size), -1, -1):
            if reach[k + 1, total - c * size]:
                counts.append(c)
                total -= c * size
                break
    counts[first] += 1
    return counts


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE):
    """Runs (first sequence, sequences, lengths held by each) that place every
    piece of the histogram."""
    hist = {int(k): int(v) for k, v in hist.items() if v}
    small = {k: n for k, n in hist.items() if k < large * capacity}
    parts = grouped({k: n for k, n in hist.items() if k not in small}, groups)
    sizes, left = [g[0][0] for g in parts], [sum(n for _, n in g) for g in parts]
    runs: list[list] = []  # [count, lengths]
    while any(left):
        config = fullest(sizes, left, capacity)
        used = [(k, c) for k, c in enumerate(config) if c]
        times = min(left[k] // c for k, c in used)
        slots = [k for k, c in used for _ in range(c)]
        # Substitute: each slot takes the next ``times`` actual pieces of its group.
        filled = [_take(parts[k], times) for k in slots]
        for k, c in used:
            left[k] -= c * times
        while times:
            n = min(f[-1][1] for f in filled)
            runs.append([n, [f[-1][0] for f in filled]])
            for f in filled:
                length, has = f.pop()
                if has > n:
                    f.append((length, has - n))
            times -= n
    return _best_fit(runs, small, capacity)


def _take(group: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Removes the ``n`` longest pieces of a group; the list is popped from its end."""
    out = []
    while n:
        length, has = group[0]
        got = min(has, n)
        out.append((length, got))
        n -= got
        if got == has:
            group.pop(0)
        else:
            group[0] = (length, has - got)
    return out[::-1]


def _best_fit(runs: list[list], small: dict[int, int], capacity: int):
    """Small pieces, longest first, go to the sequences they fill best; the
    sequences of a run are alike, so whole runs are served at once."""
    rooms: list[int] = []  # distinct free amounts, ascending
    by_room: dict[int, list[list]] = {}

    def put(run):
        room = capacity - sum(run[1])
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(run)

    for run in runs:
        put(run)
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                # A new sequence holds as many of the length as fit.
                each = min(n, capacity // length)
                put([n // each, [length] * each])
                n %= each
                continue
            room = rooms[at]
            run = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = min(room // length, n)
            times = min(run[0], n // each)
            if times < run[0]:
                put([run[0] - times, list(run[1])])
            put([times, run[1] + [length] * each])
            n -= times * each
    out, first = [], 0
    for room in rooms:
        for count, held in by_room[room]:
            out.append((first, count, held))
            first += count
    return out


def places(runs) -> np.ndarray:
    """(length, first rank, first sequence, offset) of every slot of the runs,
    ordered by length and rank: slot ranks of a length follow one another."""
    slots, seen = [], {}
    for first, count, held in runs:
        offset = 0
        for length in held:
            slots.append((length, seen.get(length, 0), first, offset))
            seen[length] = seen.get(length, 0) + count
            offset += length
    slots.sort()
    return np.array(slots, np.int64).reshape(-1, 4)


def _placer(table: np.ndarray):
    def make():
        lengths = np.unique(table[:, 0])
        begin = np.searchsorted(table[:, 0], lengths, "left")
        end = np.searchsorted(table[:, 0], lengths, "right")
        span = {int(n): (int(a), int(b)) for n, a, b in zip(lengths, begin, end)}

        def step(batch):
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.empty(len(length), np.int64)
            for n in np.unique(length):
                a, b = span[int(n)]
                at = length == n
                row[at] = a + np.searchsorted(table[a:b, 1], rank[at], "right") - 1
            out = {name: batch.column(name) for name in batch.schema.names if name != "rank"}
            out["sequence_id"] = table[row, 2] + rank - table[row, 1]
            out["offset"] = table[row, 3]
            return out
        return step
    return make


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE,
         buckets: int = BUCKETS) -> DataFrame:
    """``cut`` (id, piece, start, length, ids_crc32) with sequence_id and
    offset.  ``cut`` is read twice, so pass a written table."""
    bucket = F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int")
    rows = cut.withColumn("bucket", bucket)
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most capacity rows: a bound that does not grow with the corpus.
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not hist:
        return cut.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("length").alias("__length"), F.col("bucket").alias("__bucket"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = rows.withColumn("at", F.row_number().over(within) - 1).join(
        starts, (F.col("length") == F.col("__length")) & (F.col("bucket") == F.col("__bucket")))
    names = ["id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("at") + F.col("base")).alias("rank"))
    id_type = cut.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return arrow_map(ranked, schema, _placer(places(plan(hist, capacity, groups, large))))


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place of every piece: id, piece, start, length, ids_crc32, sequence_id,
    offset."""
    cut = written(pieces(docs, tokenizer_file, capacity, end_id, id_col, text_col), "pieces")
    return pack(cut, capacity).withColumnRenamed("id", id_col)


def word_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    """Query: places of all documents in sequences of at most 2048 ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file or word_tokenizer())
