"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_text, lm_score, simhash, substring_dedup, token_files, toxicity, url_reputation

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_bpe": bpe.op2_bpe,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_reputation": url_reputation.op7_url_reputation,
    "op8_token_files": token_files.op8_token_files,
    "op9_simhash": simhash.op9_simhash,
    "op10_html_text": html_text.op10_html_text,
}

SQL = {
    "op1_lm_score": lm_score.OP1_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_url_reputation": url_reputation.OP7_SQL,
}
