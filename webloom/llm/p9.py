"""Queries: evaluation passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.leaks import leaks
from webloom.plans.session import table


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and item that share at least twelve consecutive words."""
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", 12)


def p9_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Each leaked item with its number of documents."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


QUERIES = {"p9_found": p9_found, "p9_leaked_items": p9_leaked_items}
_SHARED = r"""
with d as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as w from documents),
i as (select item_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as w from eval_items),
dg as (select doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from d where len(w) >= 12),
ig as (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as g from i where len(w) >= 12),
f as (select distinct doc_id, item_id from dg join ig using (g))
"""
SQL = {"p9_found": _SHARED + "select doc_id, item_id from f", "p9_leaked_items": _SHARED + "select item_id, count(*) as documents from f group by item_id"}
