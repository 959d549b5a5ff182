"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import brown, decontamination, html_text, jaccard, langid, packing, quality, rollups, toxicity, warc

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_brown_scores": brown.op2_brown_scores,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_rollups": rollups.op4_token_rollups,
    "token_rollups_bpe": rollups.token_rollups_bpe,
    "op5_warc": warc.op5_warc,
    "op6_quality": quality.op6_quality,
    "op7_language_id": langid.op7_language_id,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_packing": packing.op9_packing,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLES = {
    "op4_token_rollups": rollups.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
}
