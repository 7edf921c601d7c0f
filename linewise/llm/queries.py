"""Queries and oracle SQL of this subpackage, by registered name."""

from __future__ import annotations

from linewise.llm import op1_decontaminate, op10_neardup, op11_licenses, op12_runs, op13_merkle, op2_lm, op3_token_counts, op4_jaccard, op5_toxicity, op6_quality, op7_bpe, op8_language, op9_pii

QUERIES = {
    "op1_decontaminate": op1_decontaminate.query,
    "op2_lm": op2_lm.query,
    "op3_token_counts": op3_token_counts.query,
    "op4_jaccard": op4_jaccard.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_quality": op6_quality.query,
    "op7_bpe": op7_bpe.query,
    "op8_language": op8_language.query,
    "op9_pii": op9_pii.query,
    "op10_neardup": op10_neardup.query,
    "op11_licenses": op11_licenses.query,
    "op12_runs": op12_runs.query,
    "op13_merkle": op13_merkle.query,
}

SQL: dict[str, str] = {
    "op11_licenses": op11_licenses.oracle(),
    "op13_merkle": op13_merkle.oracle(),
}
