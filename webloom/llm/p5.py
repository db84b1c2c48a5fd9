"""Queries: lines repeated across one site's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.site_lines import repeated_lines, without_lines
from webloom.plans.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that stands in at least five pages of its host."""
    return repeated_lines(table(spark, folder, "index_docs"), "page_id", "host", "content", 5)


def p5_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's text without the repeated lines."""
    pages = table(spark, folder, "index_docs").select("page_id", "host", "content")
    return without_lines(pages, "page_id", "content", repeated_lines(pages, "page_id", "host", "content", 5)).select("page_id", "content")


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Length of every page's text without the repeated lines."""
    return p5_text(spark, folder).select("page_id", F.length("content").alias("chars_left"))


def p5_published(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that stands in at least five different texts of its host, first taken on at least two days: republished articles are no boilerplate."""
    return repeated_lines(table(spark, folder, "index_docs"), "page_id", "host", "content", 5, min_clusters=5, date="tstamp", min_dates=2)


_LINES = r"""
with l as (
  select page_id, host, u.line as raw, u.n as line_no,
    trim(regexp_replace(regexp_replace(lower(u.line), '[ \t\x{00A0}]+', ' ', 'g'), '[0-9]+', '0', 'g')) as line
  from index_docs, lateral (select unnest(string_split(content, chr(10))) as line, unnest(range(1, len(string_split(content, chr(10))) + 1)) as n) u),
o as (select host, line from l where line <> '' group by host, line having count(distinct page_id) >= 5)
"""
_PUBLISHED = _LINES.replace("o as (select host, line from l where line <> '' group by host, line having count(distinct page_id) >= 5)", """d as (select host, content, min(page_id) as rep, count(distinct page_id) as pages, min(tstamp::date) as day from index_docs group by host, content),
k as (select distinct d.host, d.rep, d.pages, d.day, l.line from d join l on l.page_id = d.rep where l.line <> ''),
o as (select host, line from k group by host, line having sum(pages) >= 5 and count(*) >= 5 and count(distinct day) >= 2)""")
QUERIES = {"p5_found": p5_found, "p5_cleaned": p5_cleaned, "p5_text": p5_text, "p5_published": p5_published}
SQL = {
    "p5_found": _LINES + "select page_id, cast(line_no as integer) as line_no from l join o using (host, line)",
    "p5_published": _PUBLISHED + "select page_id, cast(line_no as integer) as line_no from l join o using (host, line)",
    "p5_text": _LINES + "select page_id, coalesce(string_agg(case when o.line is null then raw end, chr(10) order by line_no), '') as content from l left join o using (host, line) group by page_id",
    "p5_cleaned": _LINES + "select page_id, cast(coalesce(length(string_agg(case when o.line is null then raw end, chr(10) order by line_no)), 0) as integer) as chars_left from l left join o using (host, line) group by page_id",
}
