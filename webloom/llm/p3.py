"""Queries: page furniture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.boilerplate import furniture_lines
from webloom.llm.site_lines import without_lines
from webloom.plans.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that is not its page's own text."""
    return furniture_lines(table(spark, folder, "index_docs"), "page_id", "host", "title", "content")


def p3_share(spark: SparkSession, folder: str) -> DataFrame:
    """Number of furniture lines by page."""
    return p3_found(spark, folder).groupBy("page_id").agg(F.count("*").alias("lines"))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's own text, without its furniture."""
    return without_lines(table(spark, folder, "index_docs").select("page_id", "content"), "page_id", "content", p3_found(spark, folder))


QUERIES = {"p3_found": p3_found, "p3_share": p3_share, "p3_text": p3_text}
SQL = {}
