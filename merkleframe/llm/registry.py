"""The queries of this subpackage, with production parameters, and their oracle SQL."""

from __future__ import annotations

import importlib

#: Each module has QUERIES and ORACLE.
MODULES = (
    "op1_decontamination",
    "op2_license_scan",
    "op3_quality_rules",
    "op4_training_order",
    "op5_zip_archives",
    "op6_ngram_join",
    "op7_line_dedup",
    "op8_perplexity",
    "op9_language_id",
    "op10_mixing",
)


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"merkleframe.llm.{name}"), what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
