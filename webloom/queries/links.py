"""Queries on links: inlinks, and the graph it spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.url import host_of
from webloom.operators import links as L
from webloom.plans.session import table
from webloom.queries.crawldb import DB, db


def _links(spark, folder):
    return table(spark, folder, "inlinks")


def links_inverted(spark, folder):
    return L.inverted(_links(spark, folder))


def links_internal(spark, folder):
    return L.inverted(_links(spark, folder), ignore_internal=False, ignore_external=True)


def links_merged(spark, folder):
    d = _links(spark, folder).withColumn("anchor", F.coalesce("anchor", F.lit("")))
    return L.merged(d.where(F.length("from_url") % 2 == 0), d.where(F.length("from_url") % 3 != 1))


def links_by_target(spark, folder):
    """Inlink sets: number of links and of anchors by target."""
    return L.inverted(_links(spark, folder), False).groupBy("url").agg(F.count("*").alias("links"), F.count_if(F.col("anchor") != "").alias("anchors"))


def link_anchors(spark, folder):
    return L.anchors(_links(spark, folder))


def first_anchor(spark, folder):
    """One anchor for each target: the first by source that isn't empty."""
    d = _links(spark, folder).where("anchor is not null and anchor <> ''")
    return d.groupBy("url").agg(F.min_by("anchor", F.struct("from_url", "anchor")).alias("anchor"))


def graph_edges(spark, folder):
    return L.edges(_links(spark, folder))


def graph_inlinks(spark, folder):
    return L.edges(_links(spark, folder)).select(F.col("dst").alias("url"), F.col("src").alias("from_url"))


def graph_edges_domain(spark, folder):
    return L.edges(_links(spark, folder), ignore_domain=True).groupBy(host_of(F.col("src")).alias("host")).agg(F.count("*").alias("links"))


def graph_nodes(spark, folder):
    return L.nodes(L.edges(_links(spark, folder)))


def graph_without_gone(spark, folder):
    """Edges whose source isn't gone or redirected."""
    bad = db(spark, folder).where("status_code in (3, 4, 5)").select(F.col("url").alias("src"))
    return L.edges(_links(spark, folder)).join(bad, "src", "left_anti")


def link_rank(spark, folder):
    return L.link_rank(L.edges(_links(spark, folder))).select("url", "num_inlinks", "num_outlinks", F.round("score", 6).alias("score"))


def rank_update(spark, folder):
    ranks = L.link_rank(L.edges(_links(spark, folder)), 2)
    return L.updated_scores(db(spark, folder), ranks).select("url", F.round("score", 6).alias("score"))


def node_top(spark, folder):
    return L.nodes(L.edges(_links(spark, folder))).orderBy(F.desc("num_inlinks"), "url").limit(100)


def node_groups(spark, folder):
    n = L.nodes(L.edges(_links(spark, folder)))
    return n.groupBy(host_of(F.col("url")).alias("host")).agg(F.sum("num_inlinks").alias("sum_inlinks"), F.max("num_inlinks").alias("max_inlinks"), F.sum("num_outlinks").alias("sum_outlinks"))


def best_inlinks(spark, folder):
    e = L.edges(_links(spark, folder))
    n = L.nodes(e).withColumn("score", F.col("num_inlinks").cast("double"))
    return L.best_inlinks(e, n, 3).select("dst", F.col("place").cast("int").alias("place"), "src", "score")


def order_graph_degrees(spark, folder):
    """Degrees of the bipartite graph of customers and suppliers."""
    o, li = table(spark, folder, "orders").select("o_orderkey", "o_custkey"), table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    e = o.join(li, o.o_orderkey == li.l_orderkey).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    return L.nodes(e)


QUERIES = {f.__name__: f for f in (
    links_inverted, links_internal, links_merged, links_by_target, link_anchors, first_anchor, graph_edges, graph_inlinks, graph_edges_domain, graph_nodes, graph_without_gone, link_rank, rank_update, node_top, node_groups,
    best_inlinks, order_graph_degrees,
)}


def _host(c: str) -> str:
    return f"lower(regexp_extract({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1))"


_E = f"e as (select from_url as src, min(url) as dst from inlinks where from_url <> url and {_host('url')} <> {_host('from_url')} group by from_url, regexp_replace(lower(url), '\\?.*$', ''))"
_N = f"{_E}, nd as (select url, sum(i)::bigint as num_inlinks, sum(o)::bigint as num_outlinks from (select src as url, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by url)"


def _rank(n: int) -> str:
    s = "s0 as (select url, 1.0::double as score from nd)"
    for k in range(n):
        s += f", s{k + 1} as (select nd.url, 0.15 + 0.85 * (1.0::double / (select count(*) from nd) + coalesce(g.got, 0)) as score from nd left join (select e.dst as url, sum(s.score / o.num_outlinks) as got from e join s{k} s on s.url = e.src join nd o on o.url = e.src group by e.dst) g on g.url = nd.url)"
    return s.replace(" as (", " as materialized (")


SQL = {
    "links_inverted": f"select distinct url, from_url, substr(coalesce(anchor, ''), 1, 100) as anchor from inlinks where {_host('url')} <> {_host('from_url')}",
    "links_internal": f"select distinct url, from_url, substr(coalesce(anchor, ''), 1, 100) as anchor from inlinks where {_host('url')} = {_host('from_url')}",
    "links_merged": "select distinct url, from_url, coalesce(anchor, '') as anchor from inlinks where length(from_url) % 2 = 0 or length(from_url) % 3 <> 1",
    "links_by_target": "select url, count(*) as links, count(*) filter (anchor <> '') as anchors from (select distinct url, from_url, substr(coalesce(anchor, ''), 1, 100) as anchor from inlinks) group by url",
    "link_anchors": f"select distinct url, {_host('from_url')} as from_host, anchor from inlinks where anchor <> ''",
    "first_anchor": "select url, anchor from (select *, row_number() over (partition by url order by from_url, anchor) as k from inlinks where anchor <> '') where k = 1",
    "graph_edges": f"with {_E} select src, dst from e",
    "graph_inlinks": f"with {_E} select dst as url, src as from_url from e",
    "graph_edges_domain": f"with d as (select from_url as src, min(url) as dst from inlinks where from_url <> url and {_host('url')} <> {_host('from_url')} and regexp_extract({_host('url')}, '([^.]+\\.)?[^.]+$') <> regexp_extract({_host('from_url')}, '([^.]+\\.)?[^.]+$') group by from_url, regexp_replace(lower(url), '\\?.*$', '')) select {_host('src')} as host, count(*) as links from d group by 1",
    "graph_nodes": f"with {_N} select * from nd",
    "graph_without_gone": f"{DB}, {_E} select src, dst from e where src not in (select url from db where status_code in (3, 4, 5))",
    "link_rank": f"with {_N}, {_rank(10)} select nd.*, round(score, 6) as score from nd join s10 using (url)",
    "rank_update": f"{DB}, {_N}, {_rank(2)} select db.url, round(coalesce(s2.score, 0.0), 6) as score from db left join s2 using (url)",
    "node_top": f"with {_N} select * from nd order by num_inlinks desc, url limit 100",
    "node_groups": f"with {_N} select {_host('url')} as host, sum(num_inlinks)::bigint as sum_inlinks, max(num_inlinks) as max_inlinks, sum(num_outlinks)::bigint as sum_outlinks from nd group by 1",
    "best_inlinks": f"with {_N}, r as (select e.dst, e.src, nd.num_inlinks::double as score, row_number() over (partition by e.dst order by nd.num_inlinks desc, e.src) as place from e join nd on nd.url = e.src) select dst, cast(place as integer) as place, src, score from r where place <= 3",
    "order_graph_degrees": "with e as (select distinct 'c' || o_custkey as src, 's' || l_suppkey as dst from orders join lineitem on o_orderkey = l_orderkey) select url, sum(i)::bigint as num_inlinks, sum(o)::bigint as num_outlinks from (select src as url, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by url",
}
