"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_repeats, chat_threads, embed_dedup, exact_dedup, html_text, mixing, near_dedup, pieces, quality, repeats, resample, url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_pieces": pieces.op2_pieces,
        "op3_repeats": repeats.op3_repeats,
        "op4_chat_threads": chat_threads.op4_chat_threads,
        "op5_embed_dedup": embed_dedup.op5_embed_dedup,
        "op6_main_text": html_text.op6_main_text,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_url_rules": url_rules.op8_url_rules,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_resample": resample.op11_resample,
        "op12_byte_repeats": byte_repeats.op12_byte_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_repeats": repeats.OP3_SQL,
        "op4_chat_threads": chat_threads.OP4_SQL,
        "op5_embed_dedup": embed_dedup.OP5_SQL,
        "op7_mix_sources": mixing.OP7_SQL,
        "op8_url_rules": url_rules.OP8_SQL,
        "op9_near_dedup": near_dedup.OP9_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_resample": resample.OP11_SQL,
        "op12_byte_repeats": byte_repeats.OP12_SQL,
    }
