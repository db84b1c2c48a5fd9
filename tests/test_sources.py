import gzip

from pyspark.sql import functions as F

from webloom.sources.html import parse, parsed
from webloom.sources.readers import archive, feed, robots_allowed, seeds, sitemap
from webloom.streaming.rounds import fetch_counts, state_of, upsert_to

HTML = """<html><head><title> A  page </title><base href="/b/"><meta name="Keywords" content="x,y"></head><body><script>var s='</p>';</script><h1>Head</h1><p>One &amp; two</p>
<a href="c?d=1">go <b>on</b></a><a rel="nofollow" href="n">no</a><form method="post" action="p"></form><a href="i"><img src="z.png" alt="pic"></a></body></html>"""


def test_html(spark):
    p = parse("http://h.com/x", HTML)
    assert p["title"] == "A page" and p["text"] == "Head One & two go on no" and p["headings"] == ["Head"] and p["meta"] == {"keywords": "x,y"}
    assert [(o["to_url"], o["anchor"]) for o in p["outlinks"]] == [("http://h.com/b/c?d=1", "go on"), ("http://h.com/b/i", ""), ("http://h.com/b/z.png", "pic")]
    assert parse("http://h.com/", '<meta name="robots" content="noindex,nofollow"><a href=x>t</a>')["outlinks"] == []
    df = spark.createDataFrame([(1, "http://h.com/x", HTML, "old"), (2, None, None, None)], "id int, url string, html string, title string")
    got = parsed(df, "url", "html").orderBy("id").collect()
    assert got[0]["title"] == "A page" and got[1]["text"] == "" and got[0]["meta"] == {"keywords": "x,y"}


def test_seeds_and_archive(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# none\n\nhttp://a.b/\tseed.score=2.5\tk=v=w\nhttp://c.d/\tseed.fetchInterval=x\n")
    got = {r["url"]: (r["score"], r["interval"], r["metadata"]) for r in seeds(spark, str(tmp_path / "seeds.txt")).collect()}
    assert got == {"http://a.b/": (2.5, None, {"k": "v=w"}), "http://c.d/": (None, None, {})}
    body = b"<p>x</p>"
    raw = b"filedesc://f 0.0.0.0 20240101 text/plain 3\nabc\nhttp://a.b/ 1.2.3.4 20240101 text/html %d\n%s\nhttp://c.d/ 1.2.3.4 20240101 text/html 2\nok\n" % (len(body), body)
    (tmp_path / "x.arc.gz").write_bytes(gzip.compress(raw))
    assert [(r["url"], bytes(r["content"])) for r in archive(spark, str(tmp_path / "x.arc.gz")).collect()] == [("http://a.b/", body), ("http://c.d/", b"ok")]


def test_xml_and_robots():
    s = sitemap('<urlset xmlns="http://s"><url><loc>http://a.b/</loc><priority>0.8</priority><changefreq>daily</changefreq></url><url><loc>http://c.d/</loc><priority>0</priority></url></urlset>')
    assert [(e["url"], e["score"], e["interval"]) for e in s] == [("http://a.b/", 0.8, 86400), ("http://c.d/", None, None)]
    assert sitemap("<bad") == [] == feed(None)
    assert feed("<rss><channel><item><title>T</title><link>http://a.b/</link><category>c</category></item></channel></rss>")[0]["tags"] == ["c"]
    assert robots_allowed("User-agent: *\nDisallow: /x\nCrawl-delay: 2\n", "bot", "http://a.b/x") == (False, 2.0, [])


def test_stream(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([("u", k, k), (f"v{k}", 1, 0)], "url string, status_code int, t int").withColumn("time", F.timestamp_seconds(F.col("t") * 7200)).write.parquet(f"{tmp_path}/in/{k}")
    read = lambda: spark.readStream.schema("url string, status_code int, t int, time timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    read().writeStream.foreachBatch(upsert_to(f"{tmp_path}/state", "url", "t")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    state = state_of(spark, f"{tmp_path}/state", read().schema)
    assert {r["url"]: r["t"] for r in state.collect()} == {"u": 1, "v0": 0, "v1": 0}
    fetch_counts(read(), "time").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start().awaitTermination()
    assert spark.table("counts").agg(F.sum("records")).first()[0] == 4
