"""Composed queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ("labels", "rules", "features", "selection", "research", "reports", "modelled", "nulls", "reconcile", "compared")


def load():
    """All registered queries by name."""
    from . import registry
    for name in FAMILIES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(registry.QUERIES)


def checks():
    """SQL by query name."""
    load()
    from . import registry
    return dict(registry.CHECKS)
