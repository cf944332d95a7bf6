"""Queries and SQL of the training-data operators."""

from __future__ import annotations

import importlib

MODULES = ["quality_rules", "ngram_join", "sentencepiece_sampling", "toxicity", "embedding_dedup", "pii", "secrets", "mixing", "url_filter", "suffix_dedup", "embedding_whitening", "importance_resampling", "winnowing"]


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"lodestone.llm.{name}"), attribute)
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLES")
