"""Queries of this package for the driver: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from quillgraph.llm import bpe, decontam, html, langid, lm, omh, pii, secrets, simhash, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_decontamination": decontam.op2,
    "op3_lm_scores": lm.op3,
    "op4_bpe": bpe.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_language_id": langid.op6,
    "op7_secret_scan": secrets.op7,
    "op8_html_text": html.op8,
    "op9_order_minhash": omh.op9,
    "op10_pii_pseudonyms": pii.op10,
}

ORACLE_SQL = {
    "op2_decontamination": decontam.OP2_SQL,
}
