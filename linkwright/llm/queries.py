"""The queries of this subpackage: opN_<name> -> callable(spark, sf_dir), and their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, licenses, lm_scores, media, mixing, near_dedup, quality, suffix_dedup, token_counts

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_lm_scores": lm_scores.query,
    "op3_media_columns": media.query,
    "op4_decontaminate": decontaminate.query,
    "op5_license_scan": licenses.query,
    "op6_html_text": html_text.query,
    "op7_near_dedup": near_dedup.query,
    "op8_mix_sources": mixing.query,
    "op9_quality": quality.query,
    "op10_token_counts": token_counts.query,
}

SQL = {"op2_lm_scores": lm_scores.SQL, "op7_near_dedup": near_dedup.SQL}
