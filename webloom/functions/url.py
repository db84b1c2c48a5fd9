"""URL functions as columns; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels, the common ones; every other last label counts as a suffix of its own.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "net.uk", "ltd.uk", "plc.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "net.nz",
    "ac.nz", "govt.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "co.kr", "or.kr", "ac.kr", "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "com.br",
    "net.br", "org.br", "gov.br", "com.mx", "org.mx", "com.ar", "com.tr", "com.pl", "net.pl", "org.pl", "co.in", "net.in", "org.in", "ac.in", "co.za", "org.za",
    "ac.za", "com.sg", "com.hk", "com.tw", "org.tw", "co.il", "org.il", "ac.il", "com.ua", "com.ru", "co.id", "com.my", "com.ph", "com.vn", "co.th", "com.eg",
)

HOST_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#\[\]]*)"


def _found(url: Column, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(url, pattern, group)
    return F.when(got != "", got)


def host_of(url: Column) -> Column:
    """Lower-cased host name, or null where there is none."""
    return F.lower(_found(F.trim(url), HOST_RE))


def protocol_of(url: Column) -> Column:
    return F.lower(_found(F.trim(url), r"^([a-zA-Z][a-zA-Z0-9+.-]*):"))


def path_of(url: Column) -> Column:
    return _found(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)")


def query_of(url: Column) -> Column:
    return _found(url, r"^[^?#]*\?([^#]*)")


def page_of(url: Column) -> Column:
    """The URL in lower case without its query."""
    return F.regexp_replace(F.lower(url), r"\?.*$", "")


def is_ipv4(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def host_segments(host: Column) -> Column:
    """Labels of a host name; an address of four numbers stays whole."""
    return F.when(is_ipv4(host), F.array(host)).otherwise(F.split(host, r"\."))


def suffix_of(host: Column) -> Column:
    """Public suffix by the two-label list, else the last label; null for addresses and for names of one label."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.isNull() | is_ipv4(host) | ~host.contains("."), None).when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Public suffix and one label more; an address, a name of one label and a suffix itself stay as they are."""
    h = F.regexp_replace(host, r"\.$", "")
    two = F.substring_index(h, ".", -2)
    return F.when(is_ipv4(h), h).when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(h, ".", -3)).otherwise(two)


def tld_of(host: Column) -> Column:
    return F.when(~is_ipv4(host), F.substring_index(F.regexp_replace(host, r"\.$", ""), ".", -1))


def reverse_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def reverse_url(url: Column) -> Column:
    """``http://bar.foo.com:8983/x?y`` as ``com.foo.bar:http:8983/x?y``; null for texts without a host."""
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1)
    port = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    return F.concat(reverse_host(host_of(url)), F.lit(":"), protocol_of(url), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), rest)


def unreverse_url(key: Column) -> Column:
    """The inverse of reverse_url."""
    pat = r"^([^:/?#]+):([a-zA-Z][a-zA-Z0-9+.-]*)(:\d+)?(.*)$"
    part = lambda i: F.regexp_extract(key, pat, i)
    return F.when(key.rlike(pat), F.concat(part(2), F.lit("://"), reverse_host(part(1)), part(3), part(4)))


def same_domain(a: Column, b: Column) -> Column:
    """Whether two URLs have the same registered domain; null if one has no host."""
    return F.lower(domain_of(host_of(a))) == F.lower(domain_of(host_of(b)))


def home_page_of(url: Column, host: Column) -> Column:
    """Whether a URL is the root page of a host, whatever its scheme."""
    return F.coalesce((host_of(url) == F.lower(host)) & F.coalesce(path_of(url), F.lit("/")).isin("", "/") & query_of(url).isNull(), F.lit(False))


def resolved(base: Column, target: Column) -> Column:
    """A link's absolute URL: absolute targets stay, ``//host``, ``/path``, ``?query`` (kept to the page's path) and relative ones are joined to the base, dot segments taken out; null without either."""
    t = F.trim(target)
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$", 1) == "", F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(page, "[^/]*$", ""))
    whole = (
        F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), t).when(t.startswith("//"), F.concat(scheme, t)).when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(page, t)).when(t.startswith("#"), F.concat(page, t)).when(t == "", base).otherwise(F.concat(folder, t))
    )
    head, path, rest = (F.regexp_extract(whole, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$", i) for i in (1, 2, 3))
    start = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), start, lambda out, x: F.when(x == ".", out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.array_append(out, x)))
    tail = F.when(path.rlike(r"(^|/)\.\.?$") & ~F.array_join(kept, "/").endswith("/"), "/").otherwise("")
    return F.when(path.contains("/.") & (head != ""), F.concat(head, F.array_join(kept, "/"), tail, rest)).otherwise(whole)


def partition_key(url: Column, mode: str = "host") -> Column:
    """What fetch lists are partitioned by: host, registered domain, or the whole URL where there is no host."""
    host = host_of(url)
    return F.coalesce(domain_of(host) if mode == "domain" else host, url)


def duration(seconds: Column) -> Column:
    """Seconds as ``d days, hh:mm:ss``, without the days where there are none; null for null or negative ones."""
    s = seconds.cast("long")
    clock = F.format_string("%02d:%02d:%02d", F.floor(s % 86_400 / 3600), F.floor(s % 3600 / 60), s % 60)
    days = F.floor(s / 86_400)
    return F.when(s >= 0, F.when(days > 0, F.concat(days.cast("string"), F.lit(" days, "), clock)).otherwise(clock))
