"""Queries: keyword-stuffed and link-list pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.stuffing import spam_pages
from webloom.plans.session import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every page that is mostly keywords, links or tags."""
    return spam_pages(table(spark, folder, "index_docs"), "page_id", "host", "title", "content")


QUERIES = {"p7_found": p7_found}
SQL = {}
