"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

import importlib

#: Modules in the order of the operators; each has QUERIES and ORACLE.
MODULES = ("sharding", "ngram_join", "telephony", "byte_bpe", "packing", "line_dedup", "topk_search", "toxicity", "language_id", "quality", "decontaminate", "conversations", "hard_negatives")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tidewatch.llm.{name}"), what)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
