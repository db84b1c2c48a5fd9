"""Seed lists, archive files, sitemaps and feeds as DataFrames."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds of the change frequencies of sitemaps.
FREQUENCY = {"always": 60, "hourly": 3600, "daily": 86_400, "weekly": 604_800, "monthly": 2_592_000, "yearly": 31_536_000, "never": 3_153_600_000}


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """url, score, interval, metadata of a seed list: a URL a line, then tab-separated key=value (``seed.score`` and ``seed.fetchInterval`` have columns of their own); blank lines and lines beginning with # are skipped.  Of repeated URLs one line is kept, the last in byte order."""
    t = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    parts = F.split("v", "\t")
    md = F.map_from_entries(F.transform(F.filter(F.slice(parts, 2, 10_000), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", ""))))
    one = t.groupBy(F.get(parts, F.lit(0)).alias("url")).agg(F.max("v").alias("v")).withColumn("metadata", md)
    return one.select("url", F.expr("try_cast(try_element_at(metadata, 'seed.score') as double)").alias("score"), F.expr("try_cast(try_element_at(metadata, 'seed.fetchInterval') as int)").alias("interval"), F.map_filter("metadata", lambda k, v: ~k.startswith("seed.")).alias("metadata"))


def archive(spark: SparkSession, path: str) -> DataFrame:
    """url, ip, date, type, content of ARC files (gzipped or not); file descriptions are skipped, a cut record ends its file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for raw in b["content"]:
                data, at = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw, 0
                while at < len(data):
                    end = data.find(b"\n", at)
                    if end < 0:
                        break
                    head = data[at:end].decode("utf-8", "replace").split()
                    at = end + 1
                    if len(head) != 5 or not head[4].isdigit():
                        continue
                    size = int(head[4])
                    if not head[0].startswith("filedesc:"):
                        out.append((head[0], head[1], head[2], head[3], data[at : at + size]))
                    at += size
            yield pd.DataFrame(out, columns=["url", "ip", "date", "type", "content"])

    return files.mapInPandas(run, "url string, ip string, date string, type string, content binary")


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def sitemap(text: str | None) -> list[dict]:
    """Entries of one sitemap: url, score (priority, if above 0), interval, lastmod; nested sitemaps come with kind "sitemap".  Bad XML gives none."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    out = []
    for e in root:
        d = {_name(x.tag): (x.text or "").strip() for x in e}
        if d.get("loc"):
            p = d.get("priority", "")
            score = float(p) if re.fullmatch(r"\d*\.?\d+", p) and float(p) > 0 else None
            out.append({"kind": _name(e.tag), "url": d["loc"], "score": score, "interval": FREQUENCY.get(d.get("changefreq", "").lower()), "lastmod": d.get("lastmod") or None})
    return out


def feed(text: str | None) -> list[dict]:
    """Entries of one RSS or Atom feed: url, title, author, published, tags.  Bad XML gives none."""
    try:
        root = ET.fromstring(text or "")
    except ET.ParseError:
        return []
    out = []
    for e in root.iter():
        if _name(e.tag) in ("item", "entry"):
            d: dict = {"url": None, "title": None, "author": None, "published": None, "tags": []}
            for x in e:
                n, t = _name(x.tag), (x.text or "").strip()
                if n == "link":
                    d["url"] = d["url"] or x.get("href") or t
                elif n == "title":
                    d["title"] = t
                elif n in ("author", "creator"):
                    d["author"] = t or " ".join(y.text or "" for y in x).strip()
                elif n in ("pubDate", "published", "updated"):
                    d["published"] = d["published"] or t
                elif n == "category":
                    d["tags"].append(x.get("term") or t)
            out.append(d)
    return out


def robots_allowed(rules: str | None, agent: str, url: str) -> tuple[bool, float | None, list[str]]:
    """Whether robots.txt lets the agent fetch the URL, its crawl delay, and the sitemaps it names; no file allows all."""
    from urllib.robotparser import RobotFileParser

    p = RobotFileParser()
    p.parse((rules or "").splitlines())
    delay = p.crawl_delay(agent)
    return p.can_fetch(agent, url), float(delay) if delay is not None else None, list(p.site_maps() or [])
