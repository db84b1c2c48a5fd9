"""Queries of the data problems that are of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.url import host_of
from webloom.operators.timestamps import format_name, instants, with_source_zone
from webloom.plans.session import table

_TEXTS = (("crawl_dump", "modified_time"), ("cc_records", "timestamp_raw"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = None
    for name, column in _TEXTS:
        t = table(spark, folder, name).select(F.lit(name).alias("src_table"), "rec_id", F.col(column).alias("text"), "node")
        rows = t if rows is None else rows.unionByName(t)
    return rows


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of both tables whose time text means an instant, with that instant."""
    zoned = with_source_zone(_texts(spark, folder), table(spark, folder, "crawl_nodes"))
    return instants(zoned, "text", "tz_name", "date_order", "abbreviations", only_instants=True).select("src_table", "rec_id", "utc_ms")


def p1_formats(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts of both tables each pattern of the cascade takes."""
    t = _texts(spark, folder).select(F.coalesce(format_name(F.col("text")), F.lit("none")).alias("format"))
    return t.groupBy("format").agg(F.count("*").alias("texts"))


QUERIES = {"p1_found": p1_found, "p1_formats": p1_formats}
SQL = {}
