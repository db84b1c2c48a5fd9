"""Queries of the text problems, by module: each has QUERIES and SQL."""

from __future__ import annotations

from webloom.llm import p2, p3, p4, p5, p6, p7, p8, p9, p10

MODULES = (p2, p3, p4, p5, p6, p7, p8, p9, p10)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
