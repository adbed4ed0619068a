"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: query name -> module that holds its function; SQL is the module's SQL, where it has one.
MODULES = {
    "op1_secret_scan": "secrets",
    "op2_exact_top_k": "topk",
    "op3_toxicity": "toxicity",
    "op4_media_columns": "media",
    "op5_language_score": "language",
    "op6_best_fit_packing": "packing",
    "op7_budget_mix": "mixing",
    "op8_line_dedup": "lines",
    "op9_ngram_jaccard": "near",
    "op10_token_files": "tokenfiles",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict:
    out = {}
    for name, module in MODULES.items():
        sql = getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None)
        if sql:
            out[name] = sql
    return out
