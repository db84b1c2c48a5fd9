"""Queries on parsed content, and the streaming form of the crawl statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.url import host_of
from webloom.operators.ranks import positions
from webloom.plans.session import table
from webloom.queries.crawldb import db, dump
from webloom.sources.html import parsed
from webloom.streaming.rounds import latest_state


def parse_html(spark, folder):
    """Pages built from index documents, parsed back: text length, title, number of links."""
    d = table(spark, folder, "index_docs").select("page_id", "url", F.concat(F.lit("<html><head><title>"), F.regexp_replace(F.coalesce("title", F.lit("")), "[<>&]", ""), F.lit("</title><script>x='</p>'</script></head><body><p>"), F.regexp_replace("content", "[<>&]", ""), F.lit("</p><a href='/a?b=1'>more</a><a rel=nofollow href='/n'>n</a></body></html>")).alias("html"))
    return parsed(d, "url", "html").select("page_id", "title", F.size("outlinks").alias("links"), F.get("outlinks", F.lit(0))["to_url"].alias("first"))


def outlinks_in_text(spark, folder):
    """URLs that stand in the texts of documents."""
    d = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[A-Za-z0-9./?=&_-]+[A-Za-z0-9/])"))).alias("url"))
    return d.distinct()


def rounds_latest(spark, folder):
    """State after all rounds: of each URL the row fetched last."""
    return latest_state(dump(spark, folder).select("url", "status_code", "fetch_time", "rec_id"), "url", "fetch_time", "rec_id")


def politeness_schedule(spark, folder):
    """When each unfetched URL of a host is due if its host is asked once a second, in order of URL."""
    d = db(spark, folder).where("status_code = 1").select("url", host_of(F.col("url")).alias("host"))
    return positions(d, "host", ["url"], "second").withColumn("second", F.col("second").cast("int"))


QUERIES = {f.__name__: f for f in (parse_html, outlinks_in_text, rounds_latest, politeness_schedule)}
_DB = "with db as (select * from (select *, row_number() over (partition by url order by fetch_time desc, rec_id desc) as rn_ from crawl_dump) where rn_ = 1)"
_H = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1))"
SQL = {
    "outlinks_in_text": "select distinct doc_id, unnest(regexp_extract_all(text, '(https?://[A-Za-z0-9./?=&_-]+[A-Za-z0-9/])')) as url from documents",
    "rounds_latest": f"{_DB} select url, status_code, fetch_time, rec_id from db",
    "politeness_schedule": f"{_DB} select url, {_H} as host, cast(row_number() over (partition by {_H} order by url) - 1 as integer) as second from db where status_code = 1",
}
