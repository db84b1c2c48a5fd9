"""Queries: near-duplicate pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.near import expanded, similar_pairs
from webloom.plans.session import table


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of pages whose sets of three-word runs have a similarity of at least 0.7."""
    classes, links = similar_pairs(table(spark, folder, "index_docs"), "page_id", "content", k=3, least=0.7)
    return expanded(classes, links).select(F.col("a").alias("page_a"), F.col("b").alias("page_b"))


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page: its class of equal texts and the number of other classes similar to that."""
    classes, links = similar_pairs(table(spark, folder, "index_docs"), "page_id", "content", k=3, least=0.7)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return classes.join(degree, "rep", "left").select(F.col("ident").alias("page_id"), F.col("rep").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p6_found": p6_found, "p6_classes": p6_classes}
SQL = {
    "p6_found": r"""
with w as (select page_id, content, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') as w from index_docs where content is not null),
g as (select distinct page_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) > 2),
n as (select page_id, count(*) as n from g group by page_id),
c as (select a.page_id as a, b.page_id as b, count(*) as m from g a join g b on a.g = b.g and a.page_id < b.page_id group by 1, 2),
near as (select a, b from c join n x on x.page_id = a join n y on y.page_id = b where m >= 0.7 * (x.n + y.n - m) - 1e-9)
select a as page_a, b as page_b from near union select x.page_id, y.page_id from w x join w y on x.content = y.content and x.page_id < y.page_id
"""
}
