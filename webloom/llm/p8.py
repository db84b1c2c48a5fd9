"""Queries: texts packed into containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.packing import packed
from webloom.plans.session import table


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of a long one, with its container."""
    return packed(table(spark, folder, "documents"), "doc_id", "text", 2048)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers by how full they are, in steps of a sixteenth."""
    each = p8_packed(spark, folder).where("container is not null").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return each.groupBy(F.floor(F.col("tokens") / 128).alias("sixteenths")).agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill}
SQL = {}
