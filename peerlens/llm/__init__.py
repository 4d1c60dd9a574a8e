"""Operators of a training-data pipeline; each module holds one operator, its query and its SQL."""

from __future__ import annotations

import importlib

MODULES = ("langid", "license_scan", "mixing", "suffix_tree", "suffix_dedup", "quality", "pii", "decontam", "urlfilter", "simhash", "byte_bpe", "maxscore", "conversation")


def load() -> tuple[dict, dict]:
    """All queries and all SQL of this subpackage."""
    queries, sql = {}, {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
