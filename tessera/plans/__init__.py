"""Registered query plans."""

from __future__ import annotations

from importlib import import_module

MODULES = ("settling", "relational", "functions_", "files_", "extraction_", "checks", "semantic")


def all_queries():
    """(queries, oracles) of every module of plans."""
    from . import registry

    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLES
