"""Query registry: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from utterlake.plans.fixture_sql import REUSED, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prepend the fixture views a statement mentions, in definition order."""
    need: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(VIEWS[name])
    hint = {n: " MATERIALIZED" if n in REUSED else "" for n in VIEWS}
    ctes = ", ".join(f"{n} AS{hint[n]} ({VIEWS[n]})" for n in VIEWS if n in need)
    if not ctes:
        return sql
    body = re.sub(r"(?i)^with(\s+recursive)?\b", ",", sql.strip())
    return f"WITH RECURSIVE {ctes} {body}"


def query(name: str, oracle: str | None = None):
    """Register a query under its operator name."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add
