"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from refloom.llm import bag_minhash, chat_format, language_id, mixing, repetition, secret_scan, suffix_dedup, tiling, url_filter, warc


def queries() -> dict:
    return {
        "op1_bag_minhash": bag_minhash.query,
        "op2_url_filter": url_filter.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_warc": warc.query,
        "op5_repetition_rules": repetition.query,
        "op6_chat_format": chat_format.query,
        "op7_secret_scan": secret_scan.query,
        "op8_mix_sources": mixing.query,
        "op9_language_id": language_id.query,
        "op10_string_tiling": tiling.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: not of boosted trees, kernel regression and greedy tiling."""
    return {
        "op1_bag_minhash": bag_minhash.ORACLE,
        "op3_suffix_dedup": suffix_dedup.ORACLE,
        "op4_warc": warc.ORACLE,
        "op5_repetition_rules": repetition.ORACLE,
        "op6_chat_format": chat_format.ORACLE,
        "op7_secret_scan": secret_scan.ORACLE,
        "op8_mix_sources": mixing.ORACLE,
    }
