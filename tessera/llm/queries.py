"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_language": "language",
    "op2_licenses": "licenses",
    "op3_preferences": "preferences",
    "op4_quality": "quality_crf",
    "op5_suffix_array": "substrings",
    "op6_packing": "packing",
    "op7_line_dedup": "line_dedup",
    "op8_quality_rules": "quality_rules",
    "op9_decontaminate": "decontaminate",
    "op10_minhash": "minhash",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
