"""Queries of this folder, and their SQL."""

from __future__ import annotations

from . import exact_dedup, html_extract, language_id, line_dedup, mixing, ngram_join, packing, pii, quality, substring_dedup

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_html_extraction": html_extract.op2_html_extraction,
    "op3_language_id": language_id.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_ngram_jaccard_join": ngram_join.op6_ngram_jaccard_join,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_mixing": mixing.op8_mixing,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_line_dedup": line_dedup.SQL,
}
