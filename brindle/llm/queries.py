"""The queries of this subpackage, and the SQL that DuckDB can run beside them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, line_dedup, lm_scoring, quality, simhash, suffix_dedup, token_counts, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.query,
        "op2_quality": quality.query,
        "op3_decontaminate": decontaminate.query,
        "op4_bpe": bpe.query,
        "op5_token_counts": token_counts.query,
        "op6_chat_format": chat.query,
        "op7_warc": warc.query,
        "op8_suffix_dedup": suffix_dedup.query,
        "op9_line_dedup": line_dedup.query,
        "op10_lm_scoring": lm_scoring.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.ORACLE_SQL,
        "op6_chat_format": chat.ORACLE_SQL,
        "op7_warc": warc.ORACLE_SQL,
        "op9_line_dedup": line_dedup.ORACLE_SQL,
        "op10_lm_scoring": lm_scoring.ORACLE_SQL,
    }
