"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from waypost.llm import (
    caps, lines, middles, mixing, neighbours, pages, pieces, quality, repeats, scoring, simhash, sql, substrings, whitening,
)

QUERIES = {
    "op1_lm_scores": scoring.query,
    "op3_neighbours": neighbours.query,
    "op2_main_text": pages.query,
    "op4_pieces": pieces.query,
    "op5_quality": quality.query,
    "op6_near_vectors": caps.query,
    "op7_line_dedup": lines.query,
    "op8_simhash": simhash.query,
    "op9_substring_dedup": substrings.query,
    "op10_mixing": mixing.query,
    "op11_repeat_rules": repeats.query,
    "op12_whitening": whitening.query,
    "op13_fill_in_middle": middles.query,
}

ORACLES = {
    "op7_line_dedup": sql.LINES,
    "op9_substring_dedup": sql.SUBSTRINGS,
    "op10_mixing": sql.MIXING,
    "op11_repeat_rules": sql.REPEATS,
    "op13_fill_in_middle": sql.MIDDLES,
}
