"""HTML pages as rows: text, title, base, links, robots and refresh directives, meta tags and headings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

SKIPPED = {"script", "style", "noscript", "template"}
# Elements with links, and the attribute that holds the target.
LINKS = {"a": "href", "area": "href", "form": "action", "frame": "src", "iframe": "src", "script": "src", "link": "href", "img": "src", "source": "src"}


class _Page(HTMLParser):
    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.text, self.links, self.meta, self.heads = url, None, [], [], {}, []
        self.skip, self.in_title, self.in_body, self.head, self.open = 0, False, False, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "body":
            self.in_body = True
        if tag == "base" and not self.in_body and a.get("href"):
            self.base = urljoin(self.base, a["href"])
        if tag == "title" and not self.in_body and self.title is None:
            self.in_title, self.title = True, ""
        if tag == "meta" and (name := a.get("name") or a.get("http-equiv") or a.get("property")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        if tag in LINKS and a.get(LINKS[tag]) and "nofollow" not in a.get("rel", "").lower() and a.get("method", "").lower() != "post":
            self.links.append([a[LINKS[tag]], a.get("alt", "")])
            if tag == "a":
                self.open = self.links[-1]
        elif tag == "img" and self.open is not None and not self.open[1]:
            self.open[1] = a.get("alt", "")
        if tag in SKIPPED:
            self.skip += 1
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.head = ""

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag == "title":
            self.in_title = False
        if tag == "a":
            self.open = None
        if self.head is not None and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.heads.append(" ".join(self.head.split()))
            self.head = None

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.text.append(data)
            if self.head is not None:
                self.head += data
            if self.open is not None:
                self.open[1] += data


def parse(url: str, html: str | None) -> dict:
    """One page's fields.  Robots "noindex" empties text and title, "nofollow" the links; an empty or null page gives empty fields."""
    p = _Page(url or "")
    p.feed(html or "")
    p.close()
    robots = p.meta.get("robots", "").lower()
    none = "none" in robots
    links = [] if none or "nofollow" in robots else [(urljoin(p.base, u.strip()), " ".join(t.split())) for u, t in p.links]
    hidden = none or "noindex" in robots
    return {"title": "" if hidden else " ".join((p.title or "").split()), "text": "" if hidden else " ".join("".join(f"{x} " for x in p.text).split()), "outlinks": [{"to_url": u, "anchor": t} for u, t in links], "meta": p.meta, "headings": p.heads, "refresh": p.meta.get("refresh")}


def parsed(df: DataFrame, url: str, html: str) -> DataFrame:
    """df without its html column, with title, text, outlinks, meta, headings and refresh (columns of those names are replaced); rows with bad markup keep what could be read."""
    new = ("title", "text", "outlinks", "meta", "headings", "refresh")
    keep = [c for c in df.columns if c not in (html, *new)]
    source = df.select(*keep, df[html].alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__html") + ", title string, text string, outlinks array<struct<to_url:string,anchor:string>>, meta map<string,string>, headings array<string>, refresh string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse(u, h) for u, h in zip(b[url].tolist(), b["__html"].tolist())]
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame({k: pd.Series([r[k] for r in rows], dtype=object) for k in new})], axis=1)

    return source.mapInPandas(run, schema)
