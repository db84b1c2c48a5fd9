"""URL normalisers, as columns except for the basic one (percent-decoding needs bytes), which is a vectorised UDF."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.url import host_of

# Default ports by scheme.
PORTS = {"http": "80", "https": "443", "ftp": "21"}
# The default rewrite rules: session ids, anchors, index pages, doubled and trailing separators.
REWRITES = [
    (r"(?i)([;_]?((\bjsessionid|\bphpsessid|\bsid|\bsessionid)=)[0-9a-z]+)(?=[?&#]|$)", ""),
    (r"#.*$", ""), (r"(?i)/(?:index|default)\.(?:jsp|aspx?|html?|php)(?=$|\?)", "/"), (r"\?&", "?"), (r"&{2,}", "&"), (r"[?&.]$", ""), (r"(?<!:)/{2,}", "/"),
]

_PARTS = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", re.S)
_HEX = re.compile(r"%([0-9a-fA-F]{2})")


def _escaped(text: str) -> str:
    """Unreserved characters plain, everything that may not stand in a URL as upper-case %XX of its UTF-8 bytes."""
    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if c.isascii() and (c.isalnum() or c in "-._~") else "%" + m[1].upper()

    text = _HEX.sub(one, text)
    return "".join(c if "!" <= c <= "~" and c not in '"<>[]\\^`{|}' else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for k, p in enumerate(parts):
        if p == ".." or p == ".":
            if p == ".." and len(out) > 1:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


def basic(url: str | None) -> str | None:
    """Trimmed; scheme and host in lower case; default port and fragment dropped; empty path as "/"; escapes made canonical; dot segments resolved.  Texts that are no hierarchical URL come back trimmed, null and empty ones as null."""
    if url is None or not url.strip():
        return None
    url = url.strip()
    m = _PARTS.match(url)
    if not m:
        return url
    scheme, authority, path, query = m[1].lower(), m[2], m[3] or "/", m[4] or ""
    user, at, place = authority.rpartition("@")
    name, colon, port = place.partition(":") if not place.startswith("[") else (place, "", "")
    name = unquote_to_bytes(name.lower()).decode("utf-8", "replace")
    if not name.isascii():
        try:
            name = name.encode("idna").decode()
        except UnicodeError:
            return None
    keep = f":{port}" if port and port != PORTS.get(scheme) else ""
    return f"{scheme}://{user}{at}{name}{keep}{_escaped(_dots(path if path.startswith('/') else '/' + path))}{_escaped(query)}"


@F.pandas_udf(T.StringType())
def normalized(urls: pd.Series) -> pd.Series:
    return urls.map(basic)


def rewritten(url: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    return reduce(lambda u, r: F.regexp_replace(u, r[0], r[1]), REWRITES if rules is None else rules, url)


def sorted_query(url: Column) -> Column:
    """The parameters of the query in order."""
    q = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(q == "", url).otherwise(F.concat(F.regexp_extract(url, r"^([^?]*)\?", 1), F.lit("?"), F.array_join(F.array_sort(F.split(q, "&")), "&"), F.regexp_extract(url, r"(#.*)$", 1)))


def slashed(url: Column, add: bool = True) -> Column:
    """A slash at the end of paths without extension and query added, or taken away."""
    bare = ~url.rlike(r"[?#]") & ~url.rlike(r"\.[A-Za-z0-9]{1,5}$")
    return F.when(bare & ~url.endswith("/"), F.concat(url, F.lit("/"))).otherwise(url) if add else F.when(url.rlike(r"^[^?#]+://[^/?#]+/[^?#]+/$"), F.regexp_replace(url, "/$", "")).otherwise(url)


def mapped_host(url: Column, names: dict[str, str]) -> Column:
    """Host names replaced, exact ones first, then ``*.parent``; for a mapping that fits in the plan."""
    host = host_of(url)
    out = F.lit(None).cast("string")
    for k, v in reversed([*((k, v) for k, v in names.items() if not k.startswith("*.")), *((k, v) for k, v in names.items() if k.startswith("*."))]):
        out = F.when((host == k) if not k.startswith("*.") else host.endswith(k[1:]) | (host == k[2:]), F.lit(v)).otherwise(out)
    return F.when(out.isNull(), url).otherwise(F.regexp_replace(url, F.lit(r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^:/?#]+"), F.concat(F.lit("$1"), out)))


def mapped_protocol(url: Column, protocols: dict[str, str]) -> Column:
    """Scheme by host or domain suffix, unless the URL names a port."""
    host = host_of(url)
    out = F.lit(None).cast("string")
    for k, v in reversed(list(protocols.items())):
        out = F.when((host == k) | host.endswith("." + k), F.lit(v)).otherwise(out)
    return F.when(out.isNull() | url.rlike(r"^[a-zA-Z]+://[^/?#]*:\d+"), url).otherwise(F.regexp_replace(url, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.concat(out, F.lit("://"))))


def ajax(url: Column, escape: bool = True) -> Column:
    """``#!state`` as ``_escaped_fragment_=state``, or back."""
    if not escape:
        return F.regexp_replace(url, r"[?&]_escaped_fragment_=(.*)$", "#!$1")
    state = F.regexp_extract(url, r"#!(.*)$", 1)
    base = F.regexp_extract(url, r"^([^#]*)#!", 1)
    return F.when(url.contains("#!"), F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit("_escaped_fragment_="), F.url_encode(state))).otherwise(url)
