"""Queries: the best URLs of every host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.url import host_of
from webloom.llm.topn import top_n
from webloom.plans.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Places 1 to 5 of every host's URLs by score."""
    dump = table(spark, folder, "crawl_dump").select("url", "score")
    return top_n(dump, host_of(F.col("url")), F.col("score"), F.col("url"), 5, ("host", "place", "url", "score")).select("host", "place", "url")


QUERIES = {"p4_found": p4_found}
SQL = {
    "p4_found": r"""
with s as (
  select lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1)) as host, url, max(score) as score
  from crawl_dump where score is not null and not isnan(score) and url is not null group by 1, 2),
r as (select host, url, row_number() over (partition by host order by score desc, url) as place from s where host <> '')
select host, cast(place as integer) as place, url from r where place <= 5
"""
}
