"""Queries that must take in every row of their tables."""

from pyspark.sql import functions as F

from test_queries import FOLDER, pytestmark  # noqa: F401
from webloom.plans.session import table
from webloom.queries.content import bayes_relevance
from webloom.queries.problems import p1_formats


def test_formats_of_both_tables(spark):
    rows = table(spark, FOLDER, "crawl_dump").count() + table(spark, FOLDER, "cc_records").count()
    assert p1_formats(spark, FOLDER).agg(F.sum("texts")).first()[0] == rows


def test_bayes_labels_every_document(spark):
    every = {r[0] for r in table(spark, FOLDER, "documents").where(F.col("text").rlike(r"[\p{L}\p{Nd}]")).select("doc_id").collect()}
    got = [r[0] for r in bayes_relevance(spark, FOLDER).select("doc_id").collect()]
    assert len(got) == len(every) and set(got) == every
