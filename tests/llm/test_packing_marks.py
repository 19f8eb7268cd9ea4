"""Chunks whose last letter is normalised to a letter and a mark."""

import zlib

import numpy as np

from ledgerlens.llm import op2_packing


def test_packing_of_letters_that_normalise_to_marks(spark):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(op2_packing.word_tokenizer())
    texts = ["EV\u0130.", "evi EV\u0130, \u0130! a\u0130)", "\ufb2a. \ufb2a,x a\ufb2a;", "\u00e9. \u00c9! \u03a3, e\u0301.",
             "\u0130 \u0130 a \u0130.", "don't. \u65e5\u672c. \ufb01."]
    want = []
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op2_packing.pack_documents(df, op2_packing.word_tokenizer()).select("doc_id", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
