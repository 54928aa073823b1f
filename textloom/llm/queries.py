"""The training-data queries and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, line_crf, line_dedup, mixing, ngram_lm, packing, pii, quality_rules, simhash, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": mixing.op1_mix,
        "op2_lm_score": ngram_lm.op2_lm_score,
        "op3_simhash": simhash.op3_simhash,
        "op4_chat": chat.op4_chat,
        "op5_personal_data": pii.op5_personal_data,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_pack": packing.op7_pack,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_quality": line_crf.op9_quality,
        "op10_nearest": vector_search.op10_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix": mixing.MIX_SQL,
        "op4_chat": chat.CHAT_SQL,
        "op6_quality_rules": quality_rules.RULES_SQL,
        "op10_nearest": vector_search.NEAREST_SQL,
    }
