"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from celestrum.llm import decontaminate, html_text, near_dups, ngram, packing, quality, repeats, sharding, topk, url_rules

QUERIES = {
    "op1_url_filter": url_rules.query,
    "op2_ngram": ngram.query,
    "op3_decontamination": decontaminate.query,
    "op4_suffix_array": repeats.query,
    "op5_packing": packing.query,
    "op6_sharding": sharding.query,
    "op7_quality": quality.query,
    "op8_topk": topk.query,
    "op9_minhash": near_dups.query,
    "op10_html": html_text.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_url_filter": url_rules.ORACLE,
    "op3_decontamination": decontaminate.ORACLE,
    "op4_suffix_array": repeats.ORACLE,
    "op8_topk": topk.ORACLE,
    "op9_minhash": near_dups.ORACLE,
}
