"""Failure workload derived from the given tables; shared by queries, tests and benchmarks."""

from __future__ import annotations

from collections.abc import Callable


def all_queries() -> dict[str, Callable]:
    from workload import context_queries, core_queries, input_queries, quality_queries

    modules = (core_queries, input_queries, context_queries, quality_queries)
    return {name: query for module in modules for name, query in module.QUERIES.items()}
