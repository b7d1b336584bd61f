"""The corpus operators' queries and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, language, mixing, packing, pii, simhash, suffix_dedup, urls, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": urls.op1_query,
    "op2_suffix_dedup": suffix_dedup.op2_query,
    "op3_language_id": language.op3_query,
    "op4_best_fit_packing": packing.op4_query,
    "op5_pii": pii.op5_query,
    "op6_chat_preferences": chat.op6_query,
    "op7_exact_dedup": exact_dedup.op7_query,
    "op8_simhash": simhash.op8_query,
    "op9_nearest_neighbours": vectors.op9_query,
    "op10_mixing": mixing.op10_query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": urls.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op6_chat_preferences": chat.OP6_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_mixing": mixing.OP10_SQL,
}
