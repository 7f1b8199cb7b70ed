"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from lamina.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "sequence_split"
MODULES = ("state_queries", "sequence_queries", "map_queries", "stack_queries", "path_queries")

for _m in MODULES:
    import_module(f"lamina.plans.{_m}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
