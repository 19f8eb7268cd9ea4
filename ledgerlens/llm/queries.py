"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op1_substring,
    op2_packing,
    op3_sentencepiece,
    op4_simhash,
    op5_token_counts,
    op6_quality,
    op7_chat,
    op8_pii,
    op9_exact_dedup,
    op10_lines,
    op11_align,
    op12_html,
    op13_trie,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": op1_substring.op1_substring,
    "op2_packing": op2_packing.op2_packing,
    "op3_sentencepiece": op3_sentencepiece.op3_sentencepiece,
    "op4_simhash": op4_simhash.op4_simhash,
    "op5_token_counts": op5_token_counts.op5_token_counts,
    "op6_quality": op6_quality.op6_quality,
    "op7_chat": op7_chat.op7_chat,
    "op8_pii": op8_pii.op8_pii,
    "op9_exact_dedup": op9_exact_dedup.op9_exact_dedup,
    "op10_lines": op10_lines.op10_lines,
    "op11_align": op11_align.op11_align,
    "op12_html": op12_html.op12_html,
    "op13_trie": op13_trie.op13_trie,
}

#: Operators that SQL cannot express (tokenizers, fitted models, packing) have none.
ORACLES: dict[str, str] = {
    "op7_chat": op7_chat.ORACLE,
    "op9_exact_dedup": op9_exact_dedup.ORACLE,
    "op13_trie": op13_trie.ORACLE,
}
