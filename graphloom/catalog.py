"""All core queries by name, and their SQL."""

from __future__ import annotations

from graphloom.operators import queries as problems
from graphloom.operators import store_queries
from graphloom.plans import queries as cypher

_MODULES = (problems, cypher, store_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
