"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_tools, line_runs, mixing, mpeg_audio, near_duplicates, quality_rules, sentence_pieces, token_counts, token_files, wrapper_induction

QUERIES = {
    "op1_mpeg_audio": mpeg_audio.op1,
    "op2_sentencepiece": sentence_pieces.op2,
    "op3_token_counts": token_counts.op3,
    "op4_chat_tools": chat_tools.op4,
    "op5_token_files": token_files.op5,
    "op6_line_runs": line_runs.op6,
    "op7_near_duplicates": near_duplicates.op7,
    "op8_mixing": mixing.op8,
    "op9_quality_rules": quality_rules.op9,
    "op10_html_wrappers": wrapper_induction.op10,
}
ORACLE_SQL = {"op4_chat_tools": chat_tools.SQL, "op6_line_runs": line_runs.SQL, "op8_mixing": mixing.SQL, "op9_quality_rules": quality_rules.SQL}
