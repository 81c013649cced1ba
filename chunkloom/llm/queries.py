"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm import decontamination, divergence, exact_dedup, hard_negatives, language, near_dedup, page_text, passages, private_data, quality, repeats, token_counts, word_codec


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": language.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_decontamination": decontamination.query,
        "op4_word_codec": word_codec.query,
        "op5_page_text": page_text.query,
        "op6_near_dedup": near_dedup.query,
        "op7_private_data": private_data.query,
        "op8_quality": quality.query,
        "op9_token_counts": token_counts.query,
        "op10_repeats": repeats.query,
        "op11_divergence": divergence.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_passages": passages.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op11_divergence": divergence.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_passages": passages.SQL}
