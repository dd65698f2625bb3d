"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

_WHERE = {
    "op1_source_mix": "op1_mixing",
    "op2_toxicity": "op2_toxicity",
    "op3_url_filter": "op3_urls",
    "op4_repeated_passages": "op4_repeats",
    "op5_licence_scan": "op5_licences",
    "op6_decontaminate": "op6_benchmark",
    "op7_token_counts": "op7_tokens",
    "op8_quality_rules": "op8_quality",
    "op9_lm_scores": "op9_lm",
    "op10_near_duplicates": "op10_near",
    "op11_phrases": "op11_phrases",
    "op12_nearest": "op12_nearest",
    "op13_hard_negatives": "op13_negatives",
}


def queries():
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in _WHERE.items()}


def oracle_sql():
    found = {name: getattr(importlib.import_module(f".{module}", __package__), "ORACLE", None) for name, module in _WHERE.items()}
    return {name: sql for name, sql in found.items() if sql}
