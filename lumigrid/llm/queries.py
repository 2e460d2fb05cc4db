"""Queries of this subpackage and their SQL, for the entry point."""

from __future__ import annotations

import importlib

MODULES = {
    "op4_warc": "warc",
    "op2_suffix_array_dedup": "suffix_array",
    "op7_packing": "packing",
    "op3_lm_scoring": "suffix_tree_lm",
    "op1_minhash_fingerprints": "minhash",
    "op6_toxicity": "toxicity",
    "op8_quality_rules": "compression_bands",
    "op9_mixing": "mixing",
    "op10_url_filters": "url_filter",
    "op5_simhash_near_dedup": "simhash",
    "op13_filter_audit": "filter_audit",
    "op12_source_divergence": "divergence",
    "op11_topk_search": "kd_search",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"lumigrid.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"lumigrid.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
