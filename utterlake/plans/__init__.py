"""Registered queries, one per operator, over the given tables."""

from __future__ import annotations

import importlib

FAMILIES = ("texts", "lists", "scoring", "stabilizing", "latency", "runs", "signals", "tables", "streams")


def all_queries():
    from utterlake.plans import registry

    for name in FAMILIES:
        importlib.import_module(f"utterlake.plans.{name}")
    return registry.QUERIES, registry.ORACLES
