"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from . import bpe, decontaminate, hmm_scores, html_text, licenses, near_dedup, substring_dedup, token_files, topk, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_bpe_encode_decode": bpe.op2_bpe_encode_decode,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_orc": token_files.op6_token_orc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_html_text": html_text.op9_html_text,
    "op10_hmm_lm_scores": hmm_scores.op10_hmm_lm_scores,
}
ORACLES = {
    "op1_license_scan": licenses.ORACLE,
    "op3_minhash_near_dedup": near_dedup.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op8_exact_topk": topk.ORACLE,
}
