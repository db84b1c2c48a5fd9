"""Operators on links and the web graph.

Links are rows (url, from_url, anchor).  Repeated rows count once, null and empty anchors as no anchor, self-links as the operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.url import domain_of, host_of
from webloom.plans.workspace import staged


def inverted(df: DataFrame, ignore_internal: bool = True, ignore_external: bool = False, anchor_length: int = 100) -> DataFrame:
    """Distinct links by target, anchors cut to ``anchor_length``; links within a host (or, if those stay, between hosts) can be left out."""
    d = df.select("url", "from_url", F.substring(F.coalesce("anchor", F.lit("")), 1, anchor_length).alias("anchor"))
    same = host_of(F.col("url")).eqNullSafe(host_of(F.col("from_url")))
    d = d.where(~same) if ignore_internal else d.where(same) if ignore_external else d
    return d.distinct()


def merged(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """Union of two link sets; with ``most``, of a target's links no more than that, in order of source and anchor."""
    both = a.unionByName(b).distinct()
    if most is None:
        return both
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("url").orderBy("from_url", "anchor"))).where(F.col("rn") <= most).drop("rn")


def anchors(df: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Distinct non-empty anchors of each target, one per source host."""
    a = F.lower("anchor") if ignore_case else F.col("anchor")
    return df.where(F.col("anchor").isNotNull() & (F.col("anchor") != "")).select("url", host_of(F.col("from_url")).alias("from_host"), a.alias("anchor")).distinct()


def edges(df: DataFrame, ignore_host: bool = True, ignore_domain: bool = False) -> DataFrame:
    """Outlinks (src, dst) of the web graph: distinct, without links inside a host or a domain, one per source and target page (case and query ignored)."""
    d = df.select(F.col("from_url").alias("src"), F.col("url").alias("dst")).where("src is not null and dst is not null and src <> dst")
    hs, hd = host_of(F.col("src")), host_of(F.col("dst"))
    if ignore_host:
        d = d.where(~hs.eqNullSafe(hd))
    if ignore_domain:
        d = d.where(~domain_of(hs).eqNullSafe(domain_of(hd)))
    page = F.regexp_replace(F.lower("dst"), r"\?.*$", "")
    return d.groupBy("src", page.alias("page")).agg(F.min("dst").alias("dst")).select("src", "dst")


def nodes(e: DataFrame) -> DataFrame:
    """Degrees of every URL of the graph."""
    both = e.select(F.col("src").alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("url").agg(F.sum("i").alias("num_inlinks"), F.sum("o").alias("num_outlinks"))


def link_rank(e: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """Rank of every node: score = (1-d) + d*(1/N + sum of score/outlinks over the inlinks), from 1.0, ``iterations`` times.

    Edges and degrees are stored once, each iteration's scores are written to the shared folder, which cuts the lineage.
    Contributions are summed before the shuffle, so a page with very many inlinks is no hot key.
    """
    n = staged(nodes(e), "nodes")
    links = staged(e.join(n.select(F.col("url").alias("src"), "num_outlinks"), "src").select("src", "dst", "num_outlinks"), "edges")
    count = max(n.count(), 1)
    scores = n.select("url", F.lit(1.0).alias("score"))
    for _ in range(iterations):
        got = links.join(scores.withColumnRenamed("url", "src"), "src").groupBy(F.col("dst").alias("url")).agg(F.sum(F.col("score") / F.col("num_outlinks")).alias("got"))
        scores = staged(n.select("url").join(got, "url", "left").select("url", ((1 - damping) + damping * (1.0 / count + F.coalesce("got", F.lit(0.0)))).alias("score")), "scores")
    return n.join(scores, "url")


def updated_scores(records: DataFrame, ranks: DataFrame, clear: float = 0.0) -> DataFrame:
    """Records with the ranks as scores, ``clear`` where a URL has none; URLs only in ranks are left out."""
    return records.drop("score").join(ranks.select("url", "score"), "url", "left").withColumn("score", F.coalesce("score", F.lit(clear)))


def best_inlinks(e: DataFrame, ranks: DataFrame, most: int) -> DataFrame:
    """For each target its ``most`` inlinks with the highest rank, with the source's rank and degree; ties by source."""
    j = e.join(ranks.select(F.col("url").alias("src"), "score", "num_outlinks"), "src")
    return j.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("score"), F.asc("src")))).where(F.col("place") <= most)
