import pytest
from pyspark.sql import functions as F

from webloom.functions import normalize as N
from webloom.functions import url as U
from webloom.operators import crawldb as C
from webloom.operators import documents as D
from webloom.operators import filters as X
from webloom.operators import links as L
from webloom.operators import stores as S
from webloom.operators.ranks import exact_quantiles, positions

SCHEMA = "rec_id long, url string, status_code int, status_name string, fetch_time timestamp_ntz, retries_since_fetch int, retry_interval_seconds double, score double, signature string"


@pytest.mark.parametrize(("url", "want"), [
    ("http://a.com/%66oo", "http://a.com/foo"), ("http://a.com/%c0", "http://a.com/%C0"), ("http://a.com/a b", "http://a.com/a%20b"), ("HTTP://A.com:80", "http://a.com/"), ("http://a.com/./a/../f", "http://a.com/f"),
    ("http://a.com/[", "http://a.com/%5B"), ("http://a.com/x#y", "http://a.com/x"), ("https://a.com:8443/?q", "https://a.com:8443/?q"), ("  ", None), (None, None), ("mailto:x", "mailto:x"), ("http://a.com/../../x", "http://a.com/x"),
])
def test_basic_normaliser(url, want):
    assert N.basic(url) == want
    assert want is None or N.basic(want) == want


def test_url_functions(spark):
    df = spark.createDataFrame([("http://Bar.Foo.co.uk:8983/to/x.html?a=b",), ("http://140.211.11.130/x",), ("nothing",), (None,), ("",)], "u string")
    u = F.col("u")
    rows = df.select(U.host_of(u).alias("h"), U.domain_of(U.host_of(u)).alias("d"), U.reverse_url(u).alias("r"), U.unreverse_url(U.reverse_url(u)).alias("b")).collect()
    assert rows[0]["h"] == "bar.foo.co.uk" and rows[0]["d"] == "foo.co.uk" and rows[0]["r"] == "uk.co.foo.bar:http:8983/to/x.html?a=b"
    assert rows[0]["b"] == "http://bar.foo.co.uk:8983/to/x.html?a=b" and rows[1]["d"] == "140.211.11.130"
    assert [r["h"] for r in rows[2:]] == [None] * 3


def test_valid(spark):
    urls = {"http://a.example/x": True, "http://a.example/../x": False, "http://a.example/x/../y": True, "http://1.2.3.256/": False, "http://1.2.3.4/": True, "http://a.b c/": False, "gopher://a.bc/": False, "http://localhost/": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["v"] for r in df.select("u", X.valid(F.col("u")).alias("v")).collect()} == urls


def test_rewrites(spark):
    df = spark.createDataFrame([("http://a.bc/x;jsessionid=0A1?q=1",), ("http://a.bc/d/index.html",), ("http://a.bc/x?&a=1&&b=2&",)], "u string")
    assert [r[0] for r in df.select(N.rewritten(F.col("u"))).collect()] == ["http://a.bc/x?q=1", "http://a.bc/d/", "http://a.bc/x?a=1&b=2"]


def test_profile_signature_ignores_order(spark):
    df = spark.createDataFrame([("Hello World The Quick Brown Fox Jumped Over the Lazy Fox",), ("Fox World The Lazy Quick Fox Brown Jumped Over the Hello",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(D.profile_signature(F.col("t"))).collect()]
    assert got[0] == got[1] != got[2]


def test_inject_modes(spark):
    old = spark.createDataFrame([(1, "u", 2, "db_fetched", None, 0, 5.0, 0.5, None)], SCHEMA)
    seeds = spark.createDataFrame([("u", 2.0, None), ("v", None, None)], "url string, score double, interval int")
    got = {m: {r["url"]: (r["status_code"], r["score"], r["interval"]) for r in C.inject(old, seeds, m).collect()} for m in ("keep", "overwrite", "update")}
    new = (1, 1.0, 2592000.0)
    assert got == {"keep": {"u": (2, 0.5, 5.0), "v": new}, "overwrite": {"u": (1, 2.0, 2592000.0), "v": new}, "update": {"u": (2, 2.0, 5.0), "v": new}}


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    links = spark.createDataFrame([], "url string, from_url string, anchor string")
    assert C.generate(e, F.current_timestamp(), 5, 5).count() == C.deduplicate(e).count() == C.host_table(e).count() == C.top(e, 3).count() == 0
    assert C.score_stats(e).first()["records"] == 0
    assert L.link_rank(L.edges(links), 2).count() == L.inverted(links).count() == 0


def test_per_host_cap(spark):
    rows = [(i, f"http://h{i % 2}.com/{i:03}", 1, "", None, 0, 1.0, float(i), None) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fetch_time", F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")))
    got = C.generate(df, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), 100, 3, 2).groupBy("host", "segment").count().collect()
    assert sorted(tuple(r) for r in got) == [("h0.com", 1, 3), ("h0.com", 2, 3), ("h1.com", 1, 3), ("h1.com", 2, 3)]


def test_expression(spark):
    assert " ".join(C.translated("score > 1 && status =~ 'a.*' || !(retries == 2)").split()) == "nanvl(score, NULL) > 1 AND rlike(status, '^(?:a.*)$') OR NOT (retries = 2)"
    df = spark.createDataFrame([("a!b==c", float("nan")), ("a&&b", 2.0), ("it's", None)], "url string, score double")
    got = lambda e: [r["url"] for r in df.where(F.expr(C.translated(e))).collect()]
    assert got("url =~ 'a!b==c'") == ["a!b==c"] and got('url == "a&&b"') == ["a&&b"] and got("score > 0") == ["a&&b"] and got('url == "it\'s" || score >= 5') == ["it's"]


def test_newest_and_duplicates(spark):
    rows = [("u", 1, None, "x"), ("u", 2, 5, "y"), ("u", 2, 4, "z"), (None, 1, 1, "n"), (None, 3, 1, "m")]
    df = spark.createDataFrame(rows, "k string, a int, b int, v string")
    assert {r["k"]: r["v"] for r in C.newest(df, "k", "a", "b").collect()} == {"u": "y", None: "m"}
    recs = [(1, "http://a.b/long", 2, "", None, 0, 1.0, 1.0, "s"), (2, "http://a.b/x", 2, "", None, 0, 1.0, float("nan"), "s"), (3, "http://c.d/", 2, "", None, 0, 1.0, 1.0, None), (4, "http://c.d/2", 1, "", None, 0, 1.0, 1.0, "s")]
    got = {r["rec_id"]: r["duplicate"] for r in C.deduplicate(spark.createDataFrame(recs, SCHEMA)).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_generate_keeps_urls_without_host(spark):
    rows = [(1, "file:/path/index.html", 1, "", None, 0, 1.0, 1.0, None), (2, "xyz://foobar/path", 1, "", None, 0, 1.0, 1.0, None), (3, None, 1, "", None, 0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("fetch_time", F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")))
    assert [r["url"] for r in C.generate(df, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")), 10, 10).collect()] == ["file:/path/index.html"]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([('http://a.b/"x"', 2, None, "raw", 1, 86400.0, float("nan"), None, "k:v|||"), (None,) * 9], "url string, status_code int, fetch_time timestamp_ntz, modified_time string, retries_since_fetch int, retry_interval_seconds double, score double, signature string, metadata string")
    lines = [r[0] for r in S.csv_lines(df).collect()]
    assert lines[0] == '"http://a.b/""x""",2,"db_fetched",,raw,1,86400.0,1.0,NaN,"null","k:v|||"' and lines[1].startswith('"",,"unknown"')
    assert len(S.RECORD_HEADER.split(",")) == len(next(__import__("csv").reader([lines[0]]))) == 11
    assert '"score"' not in S.json_lines(df).collect()[0][0]
    folder = str(tmp_path / "db")
    assert S.current(spark, folder) is None and S.install(df.select("url"), folder) == 1 and S.install(df.select("url").limit(1), folder) == 2
    assert S.current(spark, folder).count() == 1 and S.current(spark, folder, 1).count() == 2 and S.lookup(df, "url", []).count() == 0
    hosts = spark.createDataFrame([("a.b", 1, "http://a.b/"), ("c.d", 0, None)], "host string, fetched long, homepage string")
    assert [r[0] for r in S.host_lines(hosts, "homepages").collect()] == ["http://a.b/"] and len(S.host_lines(hosts).first()[0].split("\t")) == len(S.HOST_HEADER.split("\t")) == 15


@pytest.mark.parametrize(("base", "target", "want"), [
    ("http://a.b/c/d?q", "e", "http://a.b/c/e"), ("http://a.b/c/d?q", "?r=1", "http://a.b/c/d?r=1"), ("http://a.b/c/d", "../x/./y", "http://a.b/x/y"), ("http://a.b", "x", "http://a.b/x"), ("http://a.b/c", "//d.e/f", "http://d.e/f"),
    ("http://a.b/c", "/x/../../y", "http://a.b/y"), ("http://a.b/c/", "", "http://a.b/c/"), ("http://a.b/c", "mailto:x", "mailto:x"), (None, "x", None), ("http://a.b/c", None, None),
])
def test_resolved(spark, base, target, want):
    df = spark.createDataFrame([(base, target)], "b string, t string")
    assert df.select(U.resolved(F.col("b"), F.col("t"))).first()[0] == want


def test_documents(spark):
    df = spark.createDataFrame([("Text/HTML; charset=x", "abc", "5"), (None, "é", "2"), ("image/png", None, "x")], "t string, c string, n string")
    got = df.select(D.accepted_types(F.col("t"), ["text/"]).alias("a"), D.accepted_types(F.col("t"), ["text/"], False).alias("b"), D.truncated(F.col("c"), F.col("n")).alias("c"), U.duration(F.lit(90_061)).alias("d")).collect()
    assert [(r["a"], r["b"], r["c"]) for r in got] == [(True, False, True), (False, True, False), (False, True, False)] and got[0]["d"] == "1 days, 25:01:01".replace("25", "01")


def test_positions_and_quantiles(spark):
    rows = [(("big" if i % 3 else None) if i % 10 else "b", i, float("nan") if i == 5 else None if i == 6 else float(i * 7 % 101)) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5)
    want = {}
    for g in {r[0] for r in rows}:
        want |= {i: k for k, i in enumerate(sorted(r[1] for r in rows if r[0] == g))}
    got = positions(df, "g", ["i"]).collect()
    assert len(got) == 120 and {r["i"]: r["position"] for r in got} == want
    import numpy as np
    for r in exact_quantiles(df, "g", "v", [0.0, 0.3, 0.5, 1.0, 1.5]).collect():
        own = [v for g, _, v in rows if g == r["g"] and v is not None and v == v]
        assert abs(r["v"] - np.quantile(own, r["quantile"])) < 1e-9
    assert positions(df.limit(0), "g", ["i"]).count() == exact_quantiles(df.limit(0), "g", "v", [0.5]).count() == 0


@pytest.mark.parametrize(("a", "b", "order", "loser"), [
    ("http://a.b/", "http://a.b/", ("url_length",), None), ("http://a.b/", "https://a.b/", ("https", "url_length"), 0), ("http://a.b/", "https://a.b/", ("url_length",), 1),
    ("http://a.b/b%C3%BCcher", "http://a.b/buecher", ("url_length",), 1), ("http://a.b/%YR", "http://a.b/%YR%YR", ("url_length",), 1),
])
def test_duplicate_order(spark, a, b, order, loser):
    rows = [(i, u, 2, "", None, 0, 1.0, 1.0, "s") for i, u in enumerate((a, b))]
    got = [r["rec_id"] for r in C.deduplicate(spark.createDataFrame(rows, SCHEMA), order=order).where("duplicate").collect()]
    assert got == ([] if loser is None else [loser])
