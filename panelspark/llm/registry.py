"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, hilbert, line_dedup, mixing, multi_index, near_dups, prefix_trie, quality, sanitise, spelling, token_counts, token_files, toxicity

_MODULES = {
    "op1_mixing": mixing,
    "op2_toxicity": toxicity,
    "op3_quality": quality,
    "op4_hilbert_shards": hilbert,
    "op5_token_counts": token_counts,
    "op6_line_dedup": line_dedup,
    "op7_token_files": token_files,
    "op8_multi_index": multi_index,
    "op9_decontaminate": decontaminate,
    "op10_near_dups": near_dups,
    "op11_spelling": spelling,
    "op12_sanitise": sanitise,
    "op13_prefix_trie": prefix_trie,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
