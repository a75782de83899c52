"""Registered queries: each one a Spark plan over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("harmonise", "joins", "aggregates", "sampling", "scalars", "scans", "models", "scoring")


def registry() -> tuple[dict, dict]:
    for module in MODULES:
        import_module(f"fluxloom.plans.{module}")
    from fluxloom.plans.register import ORACLES, QUERIES

    return QUERIES, ORACLES
