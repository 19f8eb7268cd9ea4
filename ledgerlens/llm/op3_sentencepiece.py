"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding works as the model defines it: the text gets its dummy prefix and the
space symbol, every character is a symbol, and an agenda of adjacent symbol
pairs ordered by score (leftmost first among equals) merges the best pair
again and again; symbols outside the vocabulary become byte pieces.  No piece
spans a boundary between letters, other characters and line ends (checked when
the model is loaded), so the text falls into chunks that are encoded on their
own, and a bounded cache keeps the ids of chunks already seen in the task.
The ids of every Arrow batch are compared with those of the sentencepiece
library; a difference fails the job rather than passing on wrong ids.  Decoding
is the library's.

Defined results: null text is the empty text, which has no ids and decodes to
the empty text; an empty table gives an empty result; columns other than id
and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, read_table, text_bytes, uncollected

#: Any letter as ``re`` knows it; a model moves signs such as superscripts out.
LETTER = re.compile(r"[^\W\d_]")
SIGNS = ".,;:!?%$&*#|)"
CACHE_CHUNKS = 300_000
CACHE_WORDS = 600_000
CACHE_CHARS = 64
#: Texts go to the library in groups of about so many characters.
GROUP_CHARS = 8 << 20


class MergeModel:
    """The vocabulary of a BPE model file and its agenda encoder."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(lib.vocab_size())]
        signs = re.escape("".join(sorted({c for p in pieces for c in p if LETTER.match(c) and not c.isalpha()})))
        # Letters, or other characters, each with the spaces before them; line ends.
        chunk = re.compile(rf" *[^\W\d_{signs}]+|\n| *(?:(?![ \n])[\W\d_{signs}])+| +")
        self.chunks = chunk.findall
        self.id_of, self.score, self.byte_id = {}, {}, {}
        for i, piece in enumerate(pieces):
            if lib.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                if not chunk.fullmatch(piece):
                    raise ValueError(f"piece {piece!r} spans a chunk boundary")
                self.id_of[piece], self.score[piece] = i, -lib.get_score(i)
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        # Decimal form of each id with a comma behind it, zero bytes after that.
        width = len(f"{len(pieces)},")
        self.decimals = np.array([f"{i},".encode() for i in range(len(pieces))], f"S{width}").view(np.uint8).reshape(-1, width)
        # Chunks seen lately, in two generations of bounded size.
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        # Whole words (what stands between single spaces), made of the chunks.
        self.words: dict[str, tuple[int, ...]] = {}

    def agenda(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk (spaces stand for the space symbol)."""
        score, n = self.score, len(chunk)
        symbols = list(chunk)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(score[pair], i, i + 1, pair) for i, pair in enumerate(map(add, chunk, chunk[1:])) if pair in score]
        heapify(agenda)
        while agenda:
            _, i, j, merged = heappop(agenda)
            # A pair is stale once one of its symbols has been merged since.
            if right[i] != j or symbols[i] + symbols[j] != merged:
                continue
            symbols[i], symbols[j] = merged, ""
            nxt = right[i] = right[j]
            right[j] = -1
            if nxt < n:
                left[nxt] = i
                pair = merged + symbols[nxt]
                if pair in score:
                    heappush(agenda, (score[pair], i, nxt, pair))
            prev = left[i]
            if prev >= 0:
                pair = symbols[prev] + merged
                if pair in score:
                    heappush(agenda, (score[pair], prev, i, pair))
        ids: list[int] = []
        for symbol in symbols:
            if symbol:
                known = self.id_of.get(symbol)
                ids.extend((known,) if known is not None else (self.byte_id[b] for b in symbol.encode()))
        return tuple(ids)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the decimal ids of a text, joined by commas."""
        padded = self.decimals[ids]
        return padded[padded != 0][:-1]

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        made = self.old.get(chunk) or self.agenda(chunk)
        if len(chunk) <= CACHE_CHARS:
            self.new[chunk] = made
        return made

    def _pieces(self, text: str):
        """Ids of the chunks of a text."""
        get, make = self.new.get, self._chunk
        return chain.from_iterable([get(c) or make(c) for c in self.chunks(text)])

    def _word(self, word: str) -> tuple[int, ...]:
        letters = word.rstrip(SIGNS)
        if letters.isalpha():   # one chunk of letters, and one of the signs behind them
            made = self.new.get(" " + letters) or self._chunk(" " + letters)
            if len(letters) < len(word):
                signs = word[len(letters):]
                made += self.new.get(signs) or self._chunk(signs)
        else:
            made = tuple(self._pieces(" " + word))
        if len(word) <= CACHE_CHARS:
            self.words[word] = made
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (int32) of each text, without begin and end ids.  Each distinct word is looked up
        once."""
        if len(self.new) >= CACHE_CHUNKS:
            self.old, self.new = self.new, {}
        if len(self.words) >= CACHE_WORDS:
            self.words = {}
        spaced = [t.replace("▁", " ") for t in texts]
        out = [np.empty(0, np.int32)] * len(texts)
        plain = []
        for i, text in enumerate(spaced):
            if "  " in text or text[:1] == " " or text[-1:] == " ":
                # Spaces in a row belong to the chunk behind them.
                out[i] = np.array(list(self._pieces(" " + text)), np.int32)
            elif text:
                plain.append(i)
        if plain:
            words = pc.split_pattern(pa.array([spaced[i] for i in plain], pa.string()), " ")
            coded = words.flatten().dictionary_encode()
            get, make = self.words.get, self._word
            ids = [get(w) or make(w) for w in coded.dictionary.to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            table = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            of = coded.indices.to_numpy(zero_copy_only=False)
            many = sizes[of]
            ends = np.cumsum(many)
            # The ids of an occurrence follow one another in the table, too.
            place = np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - many), many)
            place += np.arange(len(place))
            found = table[place]
            bounds = [0, *ends[words.offsets.to_numpy()[1:] - 1].tolist()]
            for i, first, last in zip(plain, bounds, bounds[1:]):
                out[i] = found[first:last]
        return out


@lru_cache(maxsize=1)
def _model(model_file: str) -> MergeModel:
    """One model for all tasks of a worker process."""
    return MergeModel(model_file)


def _encoded(model: MergeModel, batch):
    """For each group of texts of a batch: ids, and the texts that the library decodes
    them to.  The library encodes every text, too."""
    texts = [raw.decode() for raw in text_bytes(batch)]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_CHARS):
            size += len(texts[end])
            end += 1
        group = texts[at:end]
        ids = model.encode(group)
        theirs = model.library.encode(group, num_threads=1)
        if len(ids) != len(theirs) or any(x.tobytes() != array("i", y).tobytes() for x, y in zip(ids, theirs)):
            raise ValueError("ids differ from those of the sentencepiece library")
        yield ids, model.library.decode(theirs, num_threads=1)
        at = end


def _coder(model_file: str):
    def make():
        model = _model(model_file)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

        @uncollected
        def step(batch):
            out = {"id": batch.column("id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids, decoded in _encoded(model, batch):
                out["n_tokens"] += map(len, ids)
                out["ids_sha256"] += [hashlib.sha256(model.joined(x)).hexdigest() for x in ids]
                out["decoded_sha256"] += map(digest, decoded)
            return out
        return step
    return make


def _encoder(model_file: str):
    def make():
        model = _model(model_file)

        @uncollected
        def step(batch):
            out = {"id": batch.column("id"), "ids": [], "decoded": []}
            for ids, decoded in _encoded(model, batch):
                out["ids"] += ids
                out["decoded"] += decoded
            return out
        return step
    return make


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    return (docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), docs.schema[id_col].dataType.simpleString())


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids (array of int), decoded (their text)."""
    rows, id_type = _narrow(docs, id_col, text_col)
    return arrow_map(rows, f"id {id_type}, ids array<int>, decoded string", _encoder(model_file)) \
        .withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`encode` with the id lists and texts reduced to digests in the
    task that makes them: id, n_tokens, ids_sha256, decoded_sha256."""
    rows, id_type = _narrow(docs, id_col, text_col)
    schema = f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(rows, schema, _coder(model_file)).withColumnRenamed("id", id_col)


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Query: ids and decoded text of all documents, as digests."""
    if model_file is None:
        import public_tokenizers
        model_file = public_tokenizers.path("piece_bpe_32k.model")
    return encode_digests(read_table(spark, sf_dir, "documents"), model_file)
