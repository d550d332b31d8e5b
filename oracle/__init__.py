"""Independent SQL answers to the queries, written for DuckDB."""

from __future__ import annotations


def all_statements() -> dict[str, str]:
    from oracle import context, core, inputs, quality

    modules = (core, inputs, context, quality)
    return {name: sql for module in modules for name, sql in module.STATEMENTS.items()}
