"""One query per operator over its whole table, and SQL for those it can express."""

from __future__ import annotations

from quarterdeck.llm import (
    collocations, licenses, negatives, packing, pieces, quality, rules, simhash, token_files, topk, toxicity, urls, windows,
)

QUERIES = {
    "op1_sentencepiece": pieces.query,
    "op2_quality_rules": rules.query,
    "op3_url_filters": urls.query,
    "op4_toxicity": toxicity.query,
    "op5_simhash": simhash.query,
    "op6_quality_classifier": quality.query,
    "op7_license_scan": licenses.query,
    "op8_best_fit_packing": packing.query,
    "op9_token_files": token_files.query,
    "op10_exact_top_k": topk.query,
    "op11_window_packing": windows.query,
    "op12_collocations": collocations.query,
    "op13_hard_negatives": negatives.query,
}

SQL = {
    "op2_quality_rules": rules.SQL,
    "op3_url_filters": urls.SQL,
    "op7_license_scan": licenses.SQL,
    "op10_exact_top_k": topk.SQL,
    "op12_collocations": collocations.SQL,
    "op13_hard_negatives": negatives.SQL,
}
