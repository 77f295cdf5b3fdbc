"""Queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chosenpath, extraction, hashing, langid, maxscore, mixing, phraseindex, prefixtrie, sharding, spans, suffixes, variants

_MODULES = {
    "op1_html_extraction": extraction,
    "op2_suffix_array": suffixes,
    "op3_sentence_spans": spans,
    "op4_sharding": sharding,
    "op5_exact_top_k": maxscore,
    "op6_byte_level_bpe": bpe,
    "op7_nearest_neighbours": hashing,
    "op8_mixing": mixing,
    "op9_jaccard_join": chosenpath,
    "op10_language_id": langid,
    "op11_spelling_variants": variants,
    "op12_prefix_trie": prefixtrie,
    "op13_benchmark_decontamination": phraseindex,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
