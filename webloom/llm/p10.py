"""Queries: subject areas of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.subjects import subject_rows
from webloom.plans.session import table


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the subjects that a fifth of its sentences are about."""
    labels = table(spark, folder, "doc_labels").join(F.broadcast(table(spark, folder, "subject_areas").select("subject")), "subject", "left_semi")
    return subject_rows(table(spark, folder, "documents"), "doc_id", "text", labels, "doc_id", "subject")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Number of documents by subject."""
    return p10_found(spark, folder).groupBy("subject").agg(F.count("*").alias("documents"))


QUERIES = {"p10_found": p10_found, "p10_composition": p10_composition}
SQL = {}
