"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, chat, filter_audit, fingerprints, html_text, language, line_dedup, lloyd, mixing, near_dedup, ngram_lm, oracles, orc_ids, packing

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_pack_windows": packing.op3_pack_windows,
    "op4_orc_ids": orc_ids.op4_orc_ids,
    "op5_language_filters": language.op5_language_filters,
    "op6_learned_partitions": ann.op6_learned_partitions,
    "op7_weighted_minhash": near_dedup.op7_weighted_minhash,
    "op9_line_runs": line_dedup.op9_line_runs,
    "op10_html_text": html_text.op10_html_text,
    "op8_entropy_mix": mixing.op8_entropy_mix,
    "op11_deleted_interpolation": ngram_lm.op11_deleted_interpolation,
    "op12_lloyd": lloyd.op12_lloyd,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = oracles.SQL
