"""The queries of the core, by module: each has QUERIES and SQL."""

from __future__ import annotations

from webloom.queries import content, crawldb, links, parsing, problems, stores

MODULES = (problems, crawldb, links, content, parsing, stores)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
