"""Ids as arrays: their digests, and the comparison with the library."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from ledgerlens.llm import op3_sentencepiece

TEXTS = ["plain words, and more of them.", "", "two  spaces ", None, "漢字 ▁ \x00 é", "a"]


def _batch():
    return pa.RecordBatch.from_pydict({"id": list(range(len(TEXTS))), "text": pa.array(TEXTS, pa.string())})


def test_ids_are_arrays_and_joined_as_decimals():
    model = op3_sentencepiece.MergeModel(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [t or "" for t in TEXTS]
    ids = model.encode(texts)
    assert all(x.dtype == np.int32 for x in ids)
    assert [x.tolist() for x in ids] == model.library.encode(texts)
    last = model.library.vocab_size() - 1
    for x in [*ids, np.array([0, 9, 10, 100, 0, last], np.int32)]:
        assert bytes(model.joined(x)) == ",".join(map(str, x.tolist())).encode()


def test_ids_other_than_the_library_s_fail_the_job(monkeypatch):
    step = op3_sentencepiece._coder(public_tokenizers.path("piece_bpe_32k.model"))()
    got = step(_batch())
    assert got["n_tokens"][1] == got["n_tokens"][3] == 0 and got["ids_sha256"][1] == hashlib.sha256(b"").hexdigest()
    right = op3_sentencepiece.MergeModel.encode
    for wrong in (lambda x: x[:-1], lambda x: x + 1):
        monkeypatch.setattr(op3_sentencepiece.MergeModel, "encode", lambda self, texts, f=wrong: [*right(self, texts)[:-1], f(right(self, texts)[-1])])
        with pytest.raises(ValueError, match="differ"):
            step(_batch())
