"""Queries of the subpackage and the SQL that states their results."""

from __future__ import annotations

import corpus_pipeline
from quernstone.llm import chat, decontaminate, language_model, license_scan, line_align, mixing, near_dup, pii, repetition, suffix_dedup

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_mixing": mixing.op1_mixing,
    "op2_repetition": repetition.op2_repetition,
    "op3_contextual_pii": pii.op3_contextual_pii,
    "op4_deep_shallow": suffix_dedup.op4_deep_shallow,
    "op5_recurrent_lm": language_model.op5_recurrent_lm,
    "op6_line_alignment": line_align.op6_line_alignment,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_fm_index": decontaminate.op8_fm_index,
    "op9_chat": chat.op9_chat,
    "op10_near_duplicates": near_dup.op10_near_duplicates,
}
ORACLE_SQL = {
    "op6_line_alignment": line_align.OP6_SQL,
    "op8_fm_index": decontaminate.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_near_duplicates": near_dup.OP10_SQL,
}
