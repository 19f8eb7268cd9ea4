"""Alignment of two tokenizers' tokens over a corpus.

1. Every text is encoded whole by both tokenizers (A byte-level, B pieces with a
   space mark), with a space before it, and the bytes of the tokens are compared
   with the text; a text that either does not spell out has no tokens.
2. Anchors are byte offsets at which a token of A and a token of B both end, and
   tokens marked with a space start on both sides.  They split a document
   into windows of a few tokens.  Equal windows, as tuples of A ids and B ids, align
   alike, so a task aligns each one once and keeps the result (bounded memo); equal
   windows of a batch are found by a code and compared token by token.
3. In a window, the offsets where both sides end cut groups.  The ends of both sides
   together cut the bytes into segments, and each of these is one overlapping pair
   of tokens: a link.
4. A document's links become counts of id pairs.  Pairs are counted over the corpus
   with map-side aggregation, the best of each B id are marked, and the counts are
   joined back to the documents' pairs, from which its sums are made.

Shuffled are id pairs of documents, each pair once a document; a pair that is in all
documents has as many rows, which a skewed join splits.  A document is handled alone
in memory; ids of a batch are kept as arrays.

Defined results: null, empty and unspelt texts have zeros and the empty
string for groups; special tokens in a text are plain text; rows that share id
and text each have their own row; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, read_table, text_bytes, uncollected, written

MEMO_WINDOWS = 200_000
#: Documents are aligned in groups of about so many bytes.
GROUP_BYTES = 4 << 20
#: A pair is one long: id of A times this, and id of B.
SHIFT = 32


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: a printable
    character is itself, the others follow from code point 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class ByteLevel:
    """Side A: a byte-level BPE tokenizer file without normalizer.  Where its merges
    are numbered in their order, as they are in the order of the ids, the ranks of its
    own vocabulary say all, and tiktoken encodes by them with the same ids."""

    #: The words of byte-level vocabularies, a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, words = spec["model"], spec["pre_tokenizer"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for token, i in (added | vocab).items():
            known = all(c in alphabet for c in token)
            self.bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = spec["normalizer"] is None and words["type"] == "ByteLevel" and words.get("use_regex", True) \
            and not words["add_prefix_space"] and not model.get("ignore_merges") and not model.get("dropout")
        if plain and all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges)):
            import tiktoken
            self.ranks = tiktoken.Encoding("ranks", pat_str=self.PATTERN, special_tokens={}, mergeable_ranks={
                self.bytes[i]: i for i in vocab.values() if i < 256 + len(merges)})
        else:
            from tokenizers import Tokenizer
            self.ranks, self.tokenizer = None, Tokenizer.from_file(file)
            self.tokenizer.encode_special_tokens = True

    def encode(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            return self.ranks.encode_to_numpy(" " + text).astype(np.int64)
        return np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.int64)


class Pieces:
    """Side B: a sentencepiece model that puts a space before the text itself."""

    def __init__(self, file: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=file)
        self.bytes = []
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i)
                              else piece.replace("▁", " ").encode())

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text), np.int64)


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... (many[i] of them), for all i."""
    ends = np.cumsum(many)
    return np.repeat(first - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)


def _merged(*sorted_arrays: np.ndarray) -> np.ndarray:
    """The distinct values of sorted arrays in order."""
    values = np.sort(np.concatenate(sorted_arrays), kind="stable")
    return values[np.diff(values, prepend=-1) > 0]


class Aligner:
    """Two encoders and the memo of windows: their groups, the groups' text form,
    and their links as bytes of 64-bit pairs."""

    def __init__(self, a: ByteLevel, b: Pieces, memo: int = MEMO_WINDOWS):
        self.sides, self.limit = (a, b), memo
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
        self.flat = [np.frombuffer(b"".join(side.bytes), np.uint8) for side in self.sides]
        self.spaced = [np.array([x[:1] == b" " for x in side.bytes]) for side in self.sides]
        # Decimal ids with what may follow them: a comma, or the end of a side of a group.
        self.decimal = [f"{i}{after}" for side, end in zip(self.sides, "|;") for i in range(len(side.bytes)) for after in ("," + end)]
        self.weights = np.random.default_rng(1).integers(0, 2**64, 64, np.uint64) | np.uint64(1)
        self.memo: dict[tuple[bytes, bytes], tuple[int, str, bytes]] = {}

    def _spelt(self, texts: list[bytes], encoded: list[list[np.ndarray]]) -> list[int]:
        """Which texts both sides spell out."""
        sized = [i for i, t in enumerate(texts) if t and all(
            s[side[i]].sum() == len(t) + 1 for s, side in zip(self.sizes, encoded))]
        if not sized:
            return []
        want = np.frombuffer(b"".join(b" " + texts[i] for i in sized), np.uint8)
        at = np.cumsum([0] + [len(texts[i]) + 1 for i in sized])[:-1]
        same = np.ones(len(sized), bool)
        for size, flat, side in zip(self.sizes, self.flat, encoded):
            ids = np.concatenate([side[i] for i in sized])
            spelt = flat[_runs((np.cumsum(size) - size)[ids], size[ids])]
            same &= np.logical_and.reduceat(spelt == want, at)
        return [i for i, ok in zip(sized, same.tolist()) if ok]

    def _align(self, ids, first, many) -> list[tuple[int, str, bytes]]:
        """Aligns windows (``first`` tokens and how ``many`` there are, on both sides)."""
        own = [i[_runs(f, m)] for i, f, m in zip(ids, first, many)]
        ends = [np.cumsum(s[i]) for s, i in zip(self.sizes, own)]
        cuts = _merged(*ends)
        # The piece of text that ends at a cut lies in one token of either side.
        links = own[0][np.searchsorted(ends[0], cuts)] << SHIFT | own[1][np.searchsorted(ends[1], cuts)]
        last = [np.cumsum(m) for m in many]
        link_ends = np.searchsorted(cuts, ends[0][last[0] - 1], "right").tolist()
        # Groups end where both sides do.  Text form: the ids of a group's first side, then
        # those of its second, each with what follows it.
        both = np.intersect1d(*ends, assume_unique=True)
        shared = [np.zeros(len(e), bool) for e in ends]
        for mark, e in zip(shared, ends):
            mark[np.searchsorted(e, both)] = True
        groups = [np.cumsum(s) - s for s in shared]
        upto = [np.cumsum(np.bincount(g)) for g in groups]      # tokens up to the end of each group
        place = np.empty(len(own[0]) + len(own[1]), np.int64)
        place[np.arange(len(own[0])) + np.concatenate(([0], upto[1]))[groups[0]]] = own[0] * 2 + shared[0]
        place[np.arange(len(own[1])) + upto[0][groups[1]]] = 2 * len(self.sizes[0]) + own[1] * 2 + shared[1]
        text = list(map(self.decimal.__getitem__, place.tolist()))
        text_ends, group_ends = (last[0] + last[1]).tolist(), (groups[0][last[0] - 1] + 1).tolist()
        out, group, link, token = [], 0, 0, 0
        for g, k, t in zip(group_ends, link_ends, text_ends):
            out.append((g - group, "".join(text[token:t]), links[link:k].tobytes()))
            group, link, token = g, k, t
        return out

    def _windows(self, ids, tokens):
        """Windows of texts (how many tokens each has, on both sides): first token and
        number of tokens on both sides, and the window at which each text starts."""
        starts = [np.cumsum(s[i]) - s[i] for s, i in zip(self.sizes, ids)]
        text_first = [np.cumsum(t) - t for t in tokens]
        marked = [np.flatnonzero(s[i]) for s, i in zip(self.spaced, ids)]
        # Space-marked on both sides and at the same byte; a text starts a window as well.
        begins = _merged(np.intersect1d(*(s[m] for s, m in zip(starts, marked)), assume_unique=True),
                         starts[0][text_first[0]])
        first = [np.searchsorted(s, begins) for s in starts]
        many = [np.diff(f, append=len(i)) for f, i in zip(first, ids)]
        return first, many, np.searchsorted(begins, starts[0][text_first[0]])

    def _numbered(self, ids, first, many) -> tuple[np.ndarray, np.ndarray]:
        """The number of its id tuple for each window, and a window of each number."""
        code = np.zeros(len(first[0]), np.uint64)
        for i, f, m in zip(ids, first, many):
            place = np.arange(len(i)) - np.repeat(f, m)
            mixed = (i.astype(np.uint64) + np.uint64(1)) * self.weights[place % 64] * (place // 64 + 1).astype(np.uint64)
            code = code * np.uint64(0x9E3779B97F4A7C15) + np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), f)
        of = np.unique(code, return_inverse=True)[1]
        example = np.empty(int(of.max()) + 1, np.int64)
        example[of[::-1]] = np.arange(len(of))[::-1]
        like = example[of]
        if all((m == m[like]).all() and (i == i[_runs(f[like], m)]).all() for i, f, m in zip(ids, first, many)):
            return of, example
        # Two tuples with one code: number the tuples themselves.
        numbers: dict[tuple, int] = {}
        parts = [[tuple(i[a:a + n].tolist()) for a, n in zip(f.tolist(), m.tolist())] for i, f, m in zip(ids, first, many)]
        of = np.array([numbers.setdefault(key, len(numbers)) for key in zip(*parts)], np.int64)
        example = np.empty(len(numbers), np.int64)
        example[of] = np.arange(len(of))
        return of, example

    def _known(self, ids, first, many):
        """Numbers of the distinct windows for all windows, and what is known of these.
        Windows that occur once in the texts are not kept."""
        of, example = self._numbered(ids, first, many)
        found: list = [None] * len(example)
        again = np.flatnonzero(np.bincount(of, minlength=len(example)) > 1)
        at = example[again]
        raw = [i.astype("<u4").tobytes() for i in ids]
        bounds = [((f[at] * 4).tolist(), ((f + m)[at] * 4).tolist()) for f, m in zip(first, many)]
        keys = dict(zip(again.tolist(), ((raw[0][i:j], raw[1][k:n]) for i, j, k, n in zip(*bounds[0], *bounds[1]))))
        if len(self.memo) + len(keys) > self.limit:
            self.memo.clear()
        for n, key in keys.items():
            found[n] = self.memo.get(key)
        new = [n for n, f in enumerate(found) if f is None]
        if new:
            at = example[new]
            for n, made in zip(new, self._align(ids, [f[at] for f in first], [m[at] for m in many])):
                found[n] = made
                if n in keys and len(self.memo) < self.limit:
                    self.memo[keys[n]] = made
        return of, found

    def group(self, texts: list[bytes]) -> dict[str, list]:
        """Columns for texts: n_a, n_b, n_groups, n_links, groups_sha256; pairs of all
        texts and how often each occurs (``pairs``, ``times``), of which a text has
        ``n_pairs``."""
        out = {n: ["" if n == "groups_sha256" else 0] * len(texts)
               for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs")}
        out |= {n: np.zeros(0, np.int64) for n in ("pairs", "times")}
        plain = [t.decode() for t in texts]
        encoded = [[side.encode(t) for t in plain] for side in self.sides]
        good = self._spelt(texts, encoded)
        if not good:
            return out
        tokens = [np.array([len(side[i]) for i in good], np.int64) for side in encoded]
        ids = [np.concatenate([side[i] for i in good]) for side in encoded]
        del encoded
        first, many, text_at = self._windows(ids, tokens)
        of, found = self._known(ids, first, many)
        bounds = [*text_at.tolist(), len(of)]
        n_groups = np.add.reduceat(np.array([f[0] for f in found], np.int64)[of], text_at)
        texts_of = [f[1] for f in found]
        numbers = of.tolist()
        # Links of a text: those of its distinct windows, as often as it has them.
        spans = np.array([len(f[2]) // 8 for f in found], np.int64)
        distinct, pair_of = np.unique(np.frombuffer(b"".join([f[2] for f in found]), np.int64), return_inverse=True)
        text_no = np.repeat(np.arange(len(good)), np.diff(bounds))
        seen, often = np.unique(text_no * len(found) + of, return_counts=True)
        window = seen % len(found)
        pairs = pair_of[_runs((np.cumsum(spans) - spans)[window], spans[window])]
        where = np.repeat(seen // len(found), spans[window]) * len(distinct) + pairs
        order = np.argsort(where)
        where = where[order]
        starts = np.flatnonzero(np.diff(where, prepend=-1))
        times = np.add.reduceat(np.repeat(often, spans[window])[order], starts)
        out["pairs"], out["times"] = distinct[where[starts] % len(distinct)], times
        own = np.bincount(where[starts] // len(distinct), minlength=len(good)).tolist()
        for k, i in enumerate(good):
            groups = "".join([texts_of[n] for n in numbers[bounds[k]:bounds[k + 1]]])[:-1]
            out["n_a"][i], out["n_b"][i] = int(tokens[0][k]), int(tokens[1][k])
            out["n_groups"][i] = int(n_groups[k])
            out["n_links"][i] = out["n_a"][i] + out["n_b"][i] - out["n_groups"][i]
            out["groups_sha256"][i] = hashlib.sha256(groups.encode()).hexdigest()
            out["n_pairs"][i] = own[k]
        return out

    @uncollected
    def batch(self, batch) -> dict:
        texts, at = list(text_bytes(batch)), 0
        groups = []
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_BYTES):
                size += len(texts[end])
                end += 1
            groups.append(self.group(texts[at:end]))
            at = end
        groups = groups or [self.group([])]
        out = {name: [v for g in groups for v in g[name]] for name in groups[0] if name not in ("pairs", "times")}
        ends = pa.array(np.concatenate(([0], np.cumsum(out.pop("n_pairs")))), pa.int32())
        lists = {n: pa.ListArray.from_arrays(ends, np.concatenate([g[n] for g in groups])) for n in ("pairs", "times")}
        return {"row": batch.column("row"), "id": batch.column("id")} | out | lists


@lru_cache(maxsize=1)
def _aligner(byte_level_file: str, pieces_file: str) -> Aligner:
    """One aligner for all tasks of a worker process."""
    return Aligner(ByteLevel(byte_level_file), Pieces(pieces_file))


def aligned(docs: DataFrame, byte_level_file: str, pieces_file: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """A row for each document with a number of its own (``row``), id, n_a, n_b,
    n_groups, n_links, groups_sha256, and its distinct id pairs with their
    numbers of links (``pairs``, ``times``)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " \
             "pairs array<long>, times array<long>"
    return arrow_map(rows, schema, lambda: _aligner(byte_level_file, pieces_file).batch)


def pair_counts(bags: DataFrame) -> DataFrame:
    """pair, count and best (as many links as any pair of its B id) from rows of
    ``pair`` and ``times``."""
    counts = bags.groupBy("pair").agg(F.sum("times").alias("count"))
    piece = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counts.groupBy(piece.alias("piece")).agg(F.max("count").alias("most"))
    return counts.withColumn("piece", piece).join(most, "piece") \
        .select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, byte_level_file: str, pieces_file: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """:func:`aligned` without pairs, and n_best and count_sum of every document."""
    rows = written(aligned(docs, byte_level_file, pieces_file, id_col, text_col), "aligned")
    bags = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times") \
        .withColumnRenamed("pairs", "pair")
    counts = written(pair_counts(bags), "pair-counts")
    sums = bags.join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: alignment of a byte-level and a piece vocabulary over all documents."""
    import public_tokenizers
    out = alignment(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                    public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")
