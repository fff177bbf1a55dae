"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import binary_store, bpe, language, lines, minhash, packing, quality, repeats, topk, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
    "op3_repeated_substrings": repeats.op3_repeated_substrings,
    "op4_best_fit": packing.op4_best_fit,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_near_duplicates": minhash.op6_near_duplicates,
    "op7_language": language.op7_language,
    "op8_token_store": binary_store.op8_token_store,
    "op9_substring_dedup": windows.op9_substring_dedup,
    "op10_top_k": topk.op10_top_k,
}
SQL: dict[str, str] = {"op1_quality": quality.OP1_SQL, "op5_line_dedup": lines.OP5_SQL, "op10_top_k": topk.OP10_SQL}
