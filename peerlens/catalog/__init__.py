"""All named queries. ``load()`` imports the modules that register them."""

from __future__ import annotations

import importlib

MODULES = ["io", "projections", "joins", "aggregates", "texts", "outliers", "peers", "learning", "end_to_end"]


def load():
    from peerlens.catalog import base

    for m in MODULES:
        importlib.import_module(f"peerlens.catalog.{m}")
    return base.QUERIES, base.ORACLES
