"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["relational", "text", "learning", "live"]


def load_all():
    """Imports every query module; returns (queries, oracle SQL)."""
    from opinelake.queries import base

    for name in MODULES:
        import_module(f"opinelake.queries.{name}")
    return base.QUERIES, base.ORACLE
