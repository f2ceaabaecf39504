"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from corpusloom.llm import bpe, chat, language_id, line_dedup, media, mixing, ngram_join, quality, substring, token_counts

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_language_id": language_id.op2_language_id,
    "op3_bpe": bpe.op3_bpe,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_chat": chat.op6_chat,
    "op7_media": media.op7_media,
    "op8_quality": quality.op8_quality,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}

ORACLE: dict[str, str] = {
    "op1_substring_dedup": substring.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op10_ngram_join": ngram_join.ORACLE_SQL,
    "op8_quality": quality.ORACLE_SQL,
}
