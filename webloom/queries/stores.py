"""Queries on dumps, lookups, document filters and URL functions that need no table of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import url as U
from webloom.operators import crawldb as C
from webloom.operators import documents as D
from webloom.operators import links as L
from webloom.operators import stores as S
from webloom.plans.session import table
from webloom.queries.crawldb import _HOST, _HOSTDB, db, dump


def dump_csv(spark, folder):
    return S.csv_lines(dump(spark, folder).withColumn("score", F.round("score", 4)))


def dump_json(spark, folder):
    return S.json_lines(dump(spark, folder).withColumn("score", F.lit(None).cast("double")))


def dump_text(spark, folder):
    return S.text_lines(dump(spark, folder).withColumn("score", F.lit(None).cast("double")))


def dump_links(spark, folder):
    return S.link_lines(L.inverted(table(spark, folder, "inlinks"), False), "https?://www\\..*")


def dump_hosts(spark, folder):
    return S.host_lines(C.host_table(db(spark, folder)))


def dump_nodes(spark, folder):
    return S.node_lines(L.nodes(L.edges(table(spark, folder, "inlinks"))), "num_inlinks", "=")


def sitemap_merge(spark, folder):
    """Every second record's URL comes again in a sitemap, with URLs that nobody knows."""
    d = db(spark, folder).select("url", "status_code", F.nanvl("score", F.lit(None).cast("double")).alias("score"), F.col("retry_interval_seconds").alias("interval"), F.lit(None).cast("timestamp").alias("modified_time"))
    e = table(spark, folder, "cc_records").select("url", (F.col("response_status") / 100).alias("score"), F.lit(3600).alias("interval"), F.col("imported").cast("timestamp").alias("modified_time"))
    more = table(spark, folder, "inlinks").select(F.col("from_url").alias("url"), F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("interval"), F.lit(None).cast("timestamp").alias("modified_time"))
    return S.merged_sitemap(d, e.unionByName(more), overwrite=True).select("url", "status_code", F.round("score", 4).alias("score"), "interval")


def index_types(spark, folder):
    return table(spark, folder, "parse_meta").where(D.accepted_types(F.col("content_type"), ["text/", "application/xhtml"])).select("meta_id")


def index_types_blocked(spark, folder):
    return table(spark, folder, "parse_meta").where(D.accepted_types(F.col("content_type"), ["text/html"], accept=False)).select("meta_id")


def index_expression(spark, folder):
    return table(spark, folder, "index_docs").where(F.expr(C.translated("boost >= 1 && !(host =~ 'www.*' || segment == '0')"))).select("page_id")


def content_truncated(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", D.truncated(F.col("text"), F.col("n_chars").cast("string")).alias("truncated"))


def url_partition(spark, folder):
    return db(spark, folder).select("url", U.partition_key(F.col("url"), "domain").alias("key"))


def links_within_domain(spark, folder):
    return table(spark, folder, "inlinks").where(U.same_domain(F.col("url"), F.col("from_url"))).select("url", "from_url").distinct()


def interval_text(spark, folder):
    return dump(spark, folder).select("rec_id", U.duration(F.col("retry_interval_seconds")).alias("wait"))


QUERIES = {f.__name__: f for f in (dump_csv, dump_json, dump_text, dump_links, dump_hosts, dump_nodes, sitemap_merge, index_types, index_types_blocked, index_expression, content_truncated, url_partition, links_within_domain, interval_text)}

_NAME = "case status_code " + " ".join(f"when {k} then '{v}'" for k, v in C.STATUS.items()) + " else 'unknown' end"
_T = "coalesce(%s::varchar, '')"
_Q = "'\"' || replace(coalesce(%s::varchar, ''), '\"', '\"\"') || '\"'"
_TIME = "replace(coalesce(strftime(fetch_time, '%Y-%m-%d %H:%M:%S'), ''), 'T', ' ')"
_INTERVAL = "cast(retry_interval_seconds as bigint)"
_DOMAIN = "regexp_extract({h}, '([^.]+\\.)?[^.]+$')"
_FROM = _HOST.replace("(url,", "(from_url,")
_NODES = f"e as (select from_url as src, min(url) as dst from inlinks where from_url <> url and {_HOST} <> {_FROM} group by from_url, regexp_replace(lower(url), '\\?.*$', '')), nd as (select url, sum(i)::bigint as n from (select src as url, 0 as i from e union all select dst, 1 from e) group by url)"
SQL = {
    "dump_text": f"select url, 'Status: ' || status_code || ' (' || {_NAME} || ')' || chr(10) || 'Fetch time: ' || {_TIME} || chr(10) || 'Modified time: ' || coalesce(modified_time, '') || chr(10) || 'Retries since fetch: ' || {_T % 'retries_since_fetch'} || chr(10) || 'Retry interval: ' || {_T % _INTERVAL} || ' seconds (' || coalesce((cast(floor(retry_interval_seconds / 86400) as bigint))::varchar, '') || ' days)' || chr(10) || 'Score: ' || chr(10) || 'Signature: ' || coalesce(signature, '') || chr(10) || 'Metadata: ' || coalesce(metadata, '') as text from crawl_dump",
    "dump_links": f"select url, ' fromUrl: ' || from_url || ' anchor: ' || anchor as line from (select distinct url, from_url, substr(coalesce(anchor, ''), 1, 100) as anchor from inlinks) where regexp_full_match(url, 'https?://www\\..*')",
    "dump_hosts": f"{_HOSTDB} select concat_ws(chr(9), host, unfetched, fetched, gone, redir_temp, redir_perm, not_modified, num_records, 0, connection_failures, connection_failures, 0, '', '', '') as line from h",
    "dump_nodes": f"with {_NODES} select url || '=' || n as line from nd",
    "index_types": "select meta_id from parse_meta where starts_with(lower(trim(string_split(content_type, ';')[1])), 'text/') or starts_with(lower(trim(string_split(content_type, ';')[1])), 'application/xhtml')",
    "index_types_blocked": "select meta_id from parse_meta where not coalesce(starts_with(lower(trim(string_split(content_type, ';')[1])), 'text/html'), false)",
    "index_expression": "select page_id from index_docs where boost >= 1 and not (regexp_full_match(host, 'www.*') or segment = '0')",
    "content_truncated": "select doc_id, coalesce(octet_length(encode(text)) < n_chars, false) as truncated from documents",
    "url_partition": f"with db as (select distinct url, {_HOST} as h from crawl_dump) select url, {_DOMAIN.format(h='h')} as key from db",
    "links_within_domain": f"select distinct url, from_url from inlinks where {_DOMAIN.format(h=_HOST)} = {_DOMAIN.format(h=_FROM)}",
    "interval_text": f"select rec_id, case when {_INTERVAL} >= 86400 then ({_INTERVAL} // 86400) || ' days, ' else '' end || lpad((({_INTERVAL} % 86400) // 3600)::varchar, 2, '0') || ':' || lpad((({_INTERVAL} % 3600) // 60)::varchar, 2, '0') || ':' || lpad(({_INTERVAL} % 60)::varchar, 2, '0') as wait from crawl_dump where {_INTERVAL} >= 0 union all select rec_id, null from crawl_dump where {_INTERVAL} is null or {_INTERVAL} < 0",
    "sitemap_merge": """with db as (select * from (select *, row_number() over (partition by url order by fetch_time desc, rec_id desc) as rn_ from crawl_dump) where rn_ = 1),
e as (select url, max(case when s > 0 then s end) as es, min(i) as ei from (select url, response_status / 100 as s, 3600.0 as i from cc_records union all select from_url, 0.0, null from inlinks) where url is not null group by url)
select coalesce(db.url, e.url) as url, case when db.url is null then 1 else status_code end as status_code, round(case when db.url is null then coalesce(es, 1.0) else coalesce(es, case when not isnan(score) then score end) end, 4) as score,
case when db.url is null then coalesce(ei, 2592000.0) else coalesce(ei, retry_interval_seconds) end as interval from db full join e on db.url = e.url""",
}
