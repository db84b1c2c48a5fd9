"""Queries: garbled lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.charsets import garbled_lines, repaired
from webloom.plans.session import table


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_lines(table(spark, folder, "index_docs"), "page_id", "host", "content", "title", table(spark, folder, "parse_meta"), ("original_char_encoding", "char_encoding_for_conversion"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with letters or signs wrong or lost by a wrong decoding."""
    return _garbled(spark, folder).where("line_no > 0").select("page_id", "line_no")


def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Those lines as first written, and the garbled titles as line 0."""
    return repaired(table(spark, folder, "index_docs"), "page_id", "content", _garbled(spark, folder), "title")


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL = {}
