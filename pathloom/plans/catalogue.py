"""Queries of the core operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pathloom.plans import event_queries, function_queries, group_queries, star_queries, task_queries, tree_queries

_ALL = {**event_queries.QUERIES, **task_queries.QUERIES, **star_queries.QUERIES, **tree_queries.QUERIES, **group_queries.QUERIES, **function_queries.QUERIES}


def queries() -> dict[str, Callable]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
