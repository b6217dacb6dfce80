"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corvane.llm import op1_suffixes, op10_jaccard, op2_decontamination, op3_token_counts, op4_neighbours, op5_windows, op6_packing, op7_lines, op8_secrets, op9_toxicity


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_suffixes.query,
        "op2_decontamination": op2_decontamination.query,
        "op3_token_counts": op3_token_counts.query,
        "op4_neighbours": op4_neighbours.query,
        "op5_near_passages": op5_windows.query,
        "op6_packing": op6_packing.query,
        "op7_line_dedup": op7_lines.query,
        "op8_secrets": op8_secrets.query,
        "op9_toxicity": op9_toxicity.query,
        "op10_jaccard_join": op10_jaccard.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": op1_suffixes.SQL, "op7_line_dedup": op7_lines.SQL, "op10_jaccard_join": op10_jaccard.SQL}
