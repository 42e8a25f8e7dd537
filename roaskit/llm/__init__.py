"""Operators for training data, each with one query over a whole table. Nothing else in the library imports them."""

from __future__ import annotations


def load_queries() -> dict:
    """The registered queries of this folder by name."""
    from roaskit.llm import (bpe, decontaminate, exact_dedup, hard_negatives, html_extract, mixing, near_dedup, periodic_runs, quality,
                             secret_scan, substring_dedup, token_files, warc)
    from roaskit.plans.catalog import Query
    every = [Query("op1_substring_dedup", substring_dedup.op1_substring_dedup, None),
             Query("op2_token_files", token_files.op2_token_files, None),
             Query("op3_html_extract", html_extract.op3_html_extract, None),
             Query("op5_warc", warc.op5_warc, warc.OP5_SQL),
             Query("op4_decontaminate", decontaminate.op4_decontaminate, None),
             Query("op6_quality", quality.op6_quality, None),
             Query("op7_near_dedup", near_dedup.op7_near_dedup, None),
             Query("op8_bpe", bpe.op8_bpe, None),
             Query("op9_secret_scan", secret_scan.op9_secret_scan, None),
             Query("op10_exact_dedup", exact_dedup.op10_exact_dedup, exact_dedup.OP10_SQL),
             Query("op11_periodic_runs", periodic_runs.op11_periodic_runs, None),
             Query("op12_mixing", mixing.op12_mixing, None),
             Query("op13_hard_negatives", hard_negatives.op13_hard_negatives, hard_negatives.OP13_SQL)]
    return {q.name: q for q in every}
