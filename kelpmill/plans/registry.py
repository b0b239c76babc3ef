"""Registers queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict[str, str], Callable]:
    """(queries, SQL, add): add(name, sql)(f) registers f(spark, sf_dir); without sql there is no twin."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def add(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = f
            if sql:
                sqls[name] = sql
            return f

        return keep

    return queries, sqls, add


QUERIES, SQL = {}, {}
