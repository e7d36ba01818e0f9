"""The queries of the engine's own operators, and the SQL that stands beside each.

A module registers a query with the decorator; `load` imports the modules in which that happens.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "panel_daily"
MODULES = ["quarry.operators.market", "quarry.operators.features", "quarry.operators.preparation", "quarry.operators.documents", "quarry.operators.evaluation", "quarry.operators.graphs", "quarry.plans.factors", "quarry.operators.timeseries", "quarry.operators.models", "quarry.streaming.windows", "quarry.sources.readers", "quarry.operators.knowledge", "quarry.operators.research", "quarry.operators.performance", "quarry.operators.availability", "quarry.operators.regimes", "quarry.operators.relations", "quarry.operators.stories", "quarry.operators.checks", "quarry.plans.search", "quarry.functions.scalars", "quarry.sources.catalog", "quarry.streaming.control"]


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query of (spark, sf_dir), with the SQL that DuckDB runs on the same tables where there is such."""

    def register(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def load() -> None:
    for m in MODULES:
        import_module(m)
