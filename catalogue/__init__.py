"""The queries and their SQL counterparts, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ("profiling", "grouping", "cleaning", "charts", "extraction", "questions")


def load():
    """Import every family and return (queries, oracles)."""
    from catalogue import registry

    for family in FAMILIES:
        importlib.import_module(f"catalogue.{family}")
    return registry.QUERIES, registry.ORACLES
