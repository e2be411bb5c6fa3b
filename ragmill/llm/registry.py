"""Queries of this subpackage and the SQL that some of them have."""

from __future__ import annotations

from ragmill.llm import op1_toxicity, op2_jaccard, op3_suffix, op4_media, op5_language, op6_mixing, op7_html, op8_license, op9_chat, op10_decontaminate

QUERIES = {
    "op1_toxicity": op1_toxicity.op1_toxicity,
    "op2_jaccard_join": op2_jaccard.op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix.op3_suffix_dedup,
    "op4_media_columns": op4_media.op4_media_columns,
    "op5_language_id": op5_language.op5_language_id,
    "op6_mixing": op6_mixing.op6_mixing,
    "op7_html_text": op7_html.op7_html_text,
    "op8_license_scan": op8_license.op8_license_scan,
    "op9_chat_format": op9_chat.op9_chat_format,
    "op10_decontamination": op10_decontaminate.op10_decontamination,
}

ORACLE_SQL = {
    "op6_mixing": op6_mixing.OP6_SQL,
    "op8_license_scan": op8_license.OP8_SQL,
    "op9_chat_format": op9_chat.OP9_SQL,
}
