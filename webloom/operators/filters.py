"""URL filters as boolean columns, and rule tables as semi and anti joins.  A null URL passes no filter (the column is false)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.url import domain_of, host_of, path_of, protocol_of, query_of, suffix_of
from webloom.plans.workspace import size_of, staged

BROADCAST_BYTES = 32 << 20


def chain(*tests: Column) -> Column:
    """All filters accept."""
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def regex_rules(url: Column, rules: list[tuple[str, str]], whole: bool = False) -> Column:
    """Ordered rules ("+" or "-", pattern): the first pattern found in the URL (or matching all of it, if ``whole``) decides, none rejects."""
    out = F.lit(False)
    for sign, pattern in reversed(rules):
        out = F.when(url.rlike(f"^(?:{pattern})$" if whole else pattern), F.lit(sign == "+")).otherwise(out)
    return F.coalesce(out, F.lit(False)) & url.isNotNull()


def prefix(url: Column, prefixes: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [url.startswith(p) for p in prefixes], F.lit(False)), F.lit(False))


def suffix(url: Column, suffixes: list[str], accept: bool = False, path_only: bool = False, ignore_case: bool = False) -> Column:
    """Accepts URLs that end in none of the suffixes (``accept``: only those that end in one)."""
    u = path_of(url) if path_only else url
    u, ends = (F.lower(u), [x.lower() for x in suffixes]) if ignore_case else (u, suffixes)
    hit = reduce(lambda a, b: a | b, [u.endswith(x) for x in ends], F.lit(False))
    return F.coalesce(hit if accept else ~hit, F.lit(False))


def valid(url: Column) -> Column:
    """Well-formed: a known scheme, a host of labels with a last one of two letters or more (or a sound IPv4 address), no blank, and no more ".." than path."""
    host, path = host_of(url), F.coalesce(path_of(url), F.lit(""))
    labels = host.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$")
    octets = host.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    ups = F.regexp_count(path, F.lit(r"/\.\.(?=/|$)"))
    level = F.regexp_count(path, F.lit("/")) - ups
    return F.coalesce(protocol_of(url).isin("http", "https", "ftp") & (labels | octets) & ~url.rlike(r"[\s\x00-\x1f]|[^\x00-\x7f]") & ((ups == 0) | (level > ups)) & ~path.rlike("//"), F.lit(False))


def _small(rules: DataFrame) -> DataFrame:
    """The rules, stored, and to be broadcast if their files are small enough."""
    rules = staged(rules, "rules")
    return F.broadcast(rules) if size_of(rules) <= BROADCAST_BYTES else rules


def domain_list(df: DataFrame, names: DataFrame, allow: bool = True, url: str = "url") -> DataFrame:
    """Rows whose suffix, domain or host is in ``names`` (column name), or those of which none is.  An empty list passes everything."""
    if names.isEmpty():
        return df
    rules = _small(names.select(F.lower("name").alias("__name")).distinct())
    host = host_of(F.col("__u"))
    hit = df.select(F.col(url).alias("__u")).distinct().withColumn("__name", F.explode(F.array_compact(F.array(host, domain_of(host), suffix_of(host)))))
    hit = hit.join(rules, "__name", "left_semi").select("__u").distinct()
    return df.join(hit, df[url] == hit["__u"], "left_semi" if allow else "left_anti")


def denied_paths(df: DataFrame, rules: DataFrame, url: str = "url", longest: int | None = None) -> DataFrame:
    """Rows that no rule denies.  rules: name (a host, one of its parent domains, or "." for all), kind ("path" or "query": path with query), pattern (found).

    Each URL is paired with the rules of its parents by an equi-join on the exploded parent names.
    """
    d = df.where(F.length(url) <= longest) if longest else df
    u = d.select(F.col(url).alias("__u")).distinct()
    labels = F.split(host_of(F.col("__u")), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = u.withColumn("name", F.explode(F.concat(parents, F.array(F.lit(".")))))
    text = F.when(F.col("kind") == "path", path_of(F.col("__u"))).otherwise(F.concat(path_of(F.col("__u")), F.coalesce(F.concat(F.lit("?"), query_of(F.col("__u"))), F.lit(""))))
    bad = keyed.join(_small(rules), "name").where(F.regexp_like(text, F.col("pattern"))).select("__u").distinct()
    return d.join(bad, d[url] == bad["__u"], "left_anti")


def outlinks_in_scope(df: DataFrame, most: int | None = None, longest: int | None = None, external: bool = True, internal: bool = True, exempt: list[str] | None = None) -> DataFrame:
    """Links (from_url, url) without self-links, too long ones and those out of scope; links to URLs in which an ``exempt`` pattern is found stay; the first ``most`` of a page by URL (None: all)."""
    from pyspark.sql import Window

    same = host_of(F.col("from_url")).eqNullSafe(host_of(F.col("url")))
    d = df.where(F.col("url") != F.col("from_url"))
    d = d.where(F.length("url") <= longest) if longest else d
    if not external:
        free = reduce(lambda a, b: a | b, [F.col("url").rlike(p) for p in exempt or []], F.lit(False))
        d = d.where(same | free)
    if not internal:
        d = d.where(~same)
    d = d.select("from_url", "url").distinct()
    return d if most is None else d.withColumn("pos", F.row_number().over(Window.partitionBy("from_url").orderBy("url"))).where(F.col("pos") <= most).drop("pos")
