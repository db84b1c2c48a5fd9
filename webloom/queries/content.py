"""Queries on URLs, filters, normalisers, segments and index documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import normalize as N
from webloom.functions import url as U
from webloom.operators import documents as D
from webloom.operators import filters as X
from webloom.plans.session import table
from webloom.queries.crawldb import DB, db
from webloom.queries.links import _host

RULES = [("-", r"\.(gif|jpg|png)$"), ("-", r"lang=x"), ("+", r"^https?://www\."), ("+", r"/\d{4}/")]
GOLD = "the court upheld the ruling and the plaintiff sued the defendant over the contract"


def _urls(spark, folder):
    return db(spark, folder).select("url")


def _docs(spark, folder):
    return table(spark, folder, "index_docs")


def url_parts(spark, folder):
    u = F.col("url")
    h = U.host_of(u)
    return _urls(spark, folder).select("url", h.alias("host"), U.protocol_of(u).alias("protocol"), U.domain_of(h).alias("domain"), U.tld_of(h).alias("tld"), U.page_of(u).alias("page"), U.reverse_host(h).alias("reversed"))


def url_reversed(spark, folder):
    r = U.reverse_url(F.col("url"))
    return _urls(spark, folder).select("url", r.alias("key"), (U.unreverse_url(r) == F.lower("url")).alias("back"))


def url_segments(spark, folder):
    return _urls(spark, folder).select("url", F.size(U.host_segments(U.host_of(F.col("url")))).alias("labels"))


def filter_regex(spark, folder):
    return _urls(spark, folder).where(X.regex_rules(F.col("url"), RULES))


def filter_automaton(spark, folder):
    return _urls(spark, folder).where(X.regex_rules(F.col("url"), [("-", r".*\.html"), ("+", r"http://.*")], whole=True))


def filter_prefix(spark, folder):
    return _urls(spark, folder).where(X.prefix(F.col("url"), ["https://www.", "http://blog."]))


def filter_suffix(spark, folder):
    return _urls(spark, folder).where(X.suffix(F.col("url"), [".html", ".HTM"], ignore_case=True))


def filter_valid(spark, folder):
    return _urls(spark, folder).where(X.valid(F.col("url")))


def filter_domain(spark, folder):
    names = spark.createDataFrame([("test",), ("tarnwick.example",), ("blog.nowude.example",)], "name string")
    return X.domain_list(_urls(spark, folder), names)


def filter_domain_deny(spark, folder):
    names = spark.createDataFrame([("test",), ("tarnwick.example",), ("blog.nowude.example",)], "name string")
    return X.domain_list(_urls(spark, folder), names, allow=False)


def filter_fast(spark, folder):
    rules = spark.createDataFrame([("tarnwick.example", "path", r"\.html$"), (".", "query", r"lang=x"), ("test", "path", r"^/a/")], "name string, kind string, pattern string")
    return X.denied_paths(_urls(spark, folder), rules, longest=200)


def filter_outlinks(spark, folder):
    return X.outlinks_in_scope(table(spark, folder, "inlinks"), most=2, longest=4096, external=False, exempt=[r"\.htm$"])


def normalize_basic(spark, folder):
    """The test URLs are in normal form already, so each must come back as it is."""
    return _urls(spark, folder).select("url", N.normalized("url").alias("normal"))


def normalize_regex(spark, folder):
    return _urls(spark, folder).select("url", N.rewritten(F.col("url")).alias("normal"))


def normalize_query(spark, folder):
    return _urls(spark, folder).select("url", N.sorted_query(F.col("url")).alias("normal"))


def normalize_slash(spark, folder):
    return _urls(spark, folder).select("url", N.slashed(F.col("url")).alias("normal"))


def normalize_host(spark, folder):
    return _urls(spark, folder).select("url", N.mapped_host(F.col("url"), {"www.tarnwick.example": "tarnwick.example", "*.nowude.example": "nowude.example"}).alias("normal"))


def normalize_protocol(spark, folder):
    return _urls(spark, folder).select("url", N.mapped_protocol(F.col("url"), {"tarnwick.example": "https"}).alias("normal"))


def signature_md5(spark, folder):
    return _docs(spark, folder).select("page_id", D.md5_signature(F.col("content"), F.col("url")).alias("signature"))


def signature_profile(spark, folder):
    return table(spark, folder, "documents").select("doc_id", D.profile_signature(F.col("text")).alias("signature"))


def segment_merge(spark, folder):
    return D.newest_segment(_docs(spark, folder).select("url", "segment", "page_id", "digest")).select("url", "segment", "page_id")


def segment_stats(spark, folder):
    m = table(spark, folder, "parse_meta").groupBy("page_id").agg(F.min("parse_status").alias("parse_status"))
    d = _docs(spark, folder).join(m, "page_id", "left").groupBy(F.substring("segment", 1, 8).alias("day"))
    return d.agg(F.count("*").alias("fetched"), F.min("tstamp").alias("first"), F.max("tstamp").alias("last"), F.count_if(F.col("parse_status") == "success").alias("parsed"), F.count_if(F.col("parse_status").startswith("failed")).alias("parse_errors"))


def segment_slices(spark, folder):
    return D.slices(_docs(spark, folder).select("page_id"), 100, "page_id").groupBy("slice").agg(F.count("*").alias("rows"), F.min("page_id").alias("first"))


def segment_redirect_free(spark, folder):
    """Linked rows of each URL's newest segment."""
    d = _docs(spark, folder).select("url", "segment", "page_id")
    last = d.groupBy("url").agg(F.max("segment").alias("segment"))
    return d.join(last, ["url", "segment"], "left_semi")


def index_actions(spark, folder):
    d = D.newest_segment(_docs(spark, folder).select("url", "segment", "page_id"))
    m = table(spark, folder, "parse_meta").groupBy("page_id").agg(F.min("parse_status").alias("parse"))
    j = d.join(m, "page_id", "left").join(db(spark, folder).select("url", "status_code"), "url", "left")
    status = F.coalesce("status_code", F.lit(2))
    return j.select("url", D.index_action(status, F.coalesce("parse", F.lit("success"))).alias("action"))


def index_basic(spark, folder):
    return D.basic_fields(_docs(spark, folder)).select("id", "host", "title", "content", "boost")


def index_mime(spark, folder):
    m = D.mime_fields(F.col("content_type"))
    return table(spark, folder, "parse_meta").select("meta_id", m["type"].alias("type"), m["primary"].alias("major"), m["sub"].alias("minor"))


def index_clean(spark, folder):
    return db(spark, folder).where("status_code in (3, 7)").select("url")


def index_language(spark, folder):
    lang = F.lower(F.coalesce("lang", F.lit("unknown")))
    return table(spark, folder, "documents").where(lang.isin("en", "unknown")).select("doc_id", lang.alias("lang"))


def index_anchors(spark, folder):
    a = table(spark, folder, "inlinks").where("anchor is not null and anchor <> ''").select("url", F.lower("anchor").alias("anchor")).distinct()
    return _docs(spark, folder).select("url").distinct().join(a, "url").groupBy("url").agg(F.array_join(F.array_sort(F.collect_set("anchor")), "|").alias("anchors"))


def index_links(spark, folder):
    e = table(spark, folder, "inlinks").select(F.col("from_url").alias("url"), U.host_of(F.col("url")).alias("to_host"), U.host_of(F.col("from_url")).alias("own")).where("to_host <> own").distinct()
    return e.groupBy("url").agg(F.count("*").alias("hosts"))


def index_replace(spark, folder):
    t = F.regexp_replace(F.coalesce("title", F.lit("")), r" \| .*$", "")
    return _docs(spark, folder).where(F.col("host").rlike("^www")).select("page_id", t.alias("title"))


def index_static(spark, folder):
    return _docs(spark, folder).select("page_id", F.lit("crawl").alias("source"), F.array(F.lit("a"), F.lit("b")).alias("tags")).select("page_id", "source", F.array_join("tags", "|").alias("tags"))


def index_subcollection(spark, folder):
    black, white = F.col("url").contains("/a/"), F.col("url").contains("tarnwick") | F.col("url").contains("blog")
    return _docs(spark, folder).where(white & ~black).select("page_id", F.lit("sites").alias("subcollection"))


def index_csv(spark, folder):
    cell = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), '"', '""'), F.lit('"'))
    return _docs(spark, folder).select("page_id", F.concat_ws(",", cell(F.col("id")), cell(F.substring("title", 1, 4096)), cell(F.substring("digest", 1, 4096))).alias("line"))


def index_routing(spark, folder):
    to = F.when(F.expr("boost > 1 and host like 'www%'"), "big").when(F.expr("boost > 1"), "boosted").otherwise("default")
    return _docs(spark, folder).groupBy(to.alias("writer")).agg(F.count("*").alias("docs"))


def mime_counts(spark, folder):
    return table(spark, folder, "cc_records").groupBy(F.coalesce("content_type", F.lit("none")).alias("type")).agg(F.count("*").alias("total"), F.count_if(F.col("response_status") == 200).alias("filtered"))


def commoncrawl_records(spark, folder):
    """Records in the nested layout, with the number of inlinks."""
    n = table(spark, folder, "inlinks").groupBy("url").agg(F.countDistinct("from_url").alias("links"))
    j = table(spark, folder, "cc_records").join(n, "url", "left")
    return j.select("rec_id", F.to_json(F.struct("url", F.struct(F.coalesce("response_status", F.lit(0)).alias("status"), F.coalesce("response_hostname", F.lit("")).alias("hostname")).alias("response"), F.col("record_key").alias("key"), F.coalesce("links", F.lit(0)).alias("inLinks"))).alias("json"))


def bayes_relevance(spark, folder):
    """Most probable label of every document, from those with one."""
    d = table(spark, folder, "documents").withColumn("label", F.lower("lang"))
    return D.naive_bayes(d.where("label is not null"), d, "doc_id", "text", "label").select("doc_id", "label")


def similarity_gold(spark, folder):
    return D.cosine(table(spark, folder, "documents"), GOLD, "doc_id", "text").select("doc_id", F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (
    url_parts, url_reversed, url_segments, filter_regex, filter_automaton, filter_prefix, filter_suffix, filter_valid, filter_domain, filter_domain_deny, filter_fast, filter_outlinks, normalize_basic, normalize_regex,
    normalize_query, normalize_slash, normalize_host, normalize_protocol, signature_md5, signature_profile, segment_merge, segment_stats, segment_slices, segment_redirect_free, index_actions, index_basic, index_mime, index_clean,
    index_language, index_anchors, index_links, index_replace, index_static, index_subcollection, index_csv, index_routing, mime_counts, commoncrawl_records, bayes_relevance, similarity_gold,
)}

H = _host("url")
_U = f"{DB}, u as (select url, {H} as h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from db)"
_DOM = "(h = 'test' or h like '%.test' or h = 'tarnwick.example' or h like '%.tarnwick.example' or h = 'blog.nowude.example')"
_WORDS = "w as (select {i}, word, count(*) as n from (select {i}, unnest(string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' ')) as word from {src}) where word <> '' group by 1, 2)"
_NEW = "nd as (select * from (select *, row_number() over (partition by url order by segment desc, page_id desc) as k from index_docs) where k = 1)"
SQL = {
    "url_parts": f"{_U} select url, h as host, lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) as protocol, regexp_extract(h, '([^.]+\\.)?[^.]+$') as domain, regexp_extract(h, '[^.]+$') as tld, regexp_replace(lower(url), '\\?.*$', '') as page, array_to_string(list_reverse(string_split(h, '.')), '.') as reversed from u",
    "url_segments": f"{_U} select url, cast(len(string_split(h, '.')) as integer) as labels from u",
    "filter_regex": f"{_U} select url from u where case when regexp_matches(url, '\\.(gif|jpg|png)$') then false when url like '%lang=x%' then false when regexp_matches(url, '^https?://www\\.') then true when regexp_matches(url, '/[0-9]{{4}}/') then true else false end",
    "filter_automaton": f"{_U} select url from u where url not like '%.html' and url like 'http://%'",
    "filter_prefix": f"{_U} select url from u where starts_with(url, 'https://www.') or starts_with(url, 'http://blog.')",
    "filter_suffix": f"{_U} select url from u where not (lower(url) like '%.html' or lower(url) like '%.htm')",
    "filter_domain": f"{_U} select url from u where {_DOM}",
    "filter_domain_deny": f"{_U} select url from u where not {_DOM}",
    "filter_fast": f"{_U} select url from u where length(url) <= 200 and not (url like '%?%lang=x%') and not ((h = 'tarnwick.example' or h like '%.tarnwick.example') and path like '%.html') and not (h like '%.test' and path like '/a/%')",
    "filter_outlinks": f"with l as (select distinct from_url, url from inlinks where url <> from_url and length(url) <= 4096 and ({_host('url')} = {_host('from_url')} or url like '%.htm')), r as (select *, row_number() over (partition by from_url order by url) as k from l) select from_url, url from r where k <= 2",
    "normalize_query": f"{DB} select url, case when url like '%?%' then regexp_extract(url, '^([^?]*)', 1) || '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&') else url end as normal from db",
    "normalize_slash": f"{DB} select url, case when not regexp_matches(url, '[?#]') and not regexp_matches(url, '\\.[A-Za-z0-9]{{1,5}}$') and url not like '%/' then url || '/' else url end as normal from db",
    "normalize_host": f"{DB} select url, case when {H} = 'www.tarnwick.example' then replace(url, '//www.tarnwick.example', '//tarnwick.example') when {H} like '%.nowude.example' then regexp_replace(url, '//[^/]*', '//nowude.example') else url end as normal from db",
    "normalize_protocol": f"{DB} select url, case when {H} like '%tarnwick.example' then regexp_replace(url, '^http:', 'https:') else url end as normal from db",
    "signature_md5": "select page_id, md5(case when length(content) > 0 then content else url end) as signature from index_docs",
    "segment_merge": f"with {_NEW} select url, segment, page_id from nd",
    "segment_stats": "with m as (select page_id, min(parse_status) as s from parse_meta group by 1) select substr(segment, 1, 8) as day, count(*) as fetched, min(tstamp) as first, max(tstamp) as last, count(*) filter (s = 'success') as parsed, count(*) filter (s like 'failed%') as parse_errors from index_docs left join m using (page_id) group by 1",
    "segment_slices": "select cast(floor(k / 100) as bigint) as slice, count(*) as rows, min(page_id) as first from (select page_id, row_number() over (order by page_id) - 1 as k from index_docs) group by 1",
    "segment_redirect_free": "select url, segment, page_id from (select *, rank() over (partition by url order by segment desc) as k from index_docs) where k = 1",
    "index_actions": f"{DB}, {_NEW}, m as (select page_id, min(parse_status) as p from parse_meta group by 1) select nd.url, case when coalesce(p, 'success') like 'failed%' then 'DELETE' when coalesce(db.status_code, 2) in (3, 4, 5, 7) then 'DELETE' when coalesce(db.status_code, 2) in (2, 6) then 'ADD' end as action from nd left join m using (page_id) left join db on db.url = nd.url",
    "index_basic": f"select url as id, {H} as host, substr(coalesce(title, ''), 1, 100) as title, content, boost from index_docs",
    "index_mime": "select meta_id, lower(trim(string_split(content_type, ';')[1])) as type, string_split(lower(trim(string_split(content_type, ';')[1])), '/')[1] as major, string_split(lower(trim(string_split(content_type, ';')[1])), '/')[-1] as minor from parse_meta",
    "index_clean": f"{DB} select url from db where status_code in (3, 7)",
    "index_language": "select doc_id, lower(coalesce(lang, 'unknown')) as lang from documents where lower(coalesce(lang, 'unknown')) in ('en', 'unknown')",
    "index_anchors": "select url, string_agg(a, '|' order by a) as anchors from (select distinct url, lower(anchor) as a from inlinks where anchor <> '') join (select distinct url from index_docs) using (url) group by url",
    "index_links": f"select from_url as url, count(distinct {H}) as hosts from inlinks where {H} <> {_host('from_url')} group by 1",
    "index_replace": "select page_id, regexp_replace(coalesce(title, ''), ' \\| .*$', '') as title from index_docs where host like 'www%'",
    "index_static": "select page_id, 'crawl' as source, 'a|b' as tags from index_docs",
    "index_subcollection": "select page_id, 'sites' as subcollection from index_docs where (url like '%tarnwick%' or url like '%blog%') and url not like '%/a/%'",
    "index_csv": "select page_id, '\"' || replace(id, '\"', '\"\"') || '\",\"' || replace(coalesce(substr(title, 1, 4096), ''), '\"', '\"\"') || '\",\"' || coalesce(digest, '') || '\"' as line from index_docs",
    "index_routing": "select case when boost > 1 and host like 'www%' then 'big' when boost > 1 then 'boosted' else 'default' end as writer, count(*) as docs from index_docs group by 1",
    "mime_counts": "select coalesce(content_type, 'none') as type, count(*) as total, count(*) filter (response_status = 200) as filtered from cc_records group by 1",
    "commoncrawl_records": "with n as (select url, count(distinct from_url) as links from inlinks group by 1) select rec_id, to_json({'url': c.url, 'response': {'status': coalesce(response_status, 0), 'hostname': coalesce(response_hostname, '')}, 'key': record_key, 'inLinks': coalesce(links, 0)})::varchar as json from cc_records c left join n on n.url = c.url",
    "similarity_gold": f"with {_WORDS.format(i='doc_id', t='text', src='documents')}, g as (select word, count(*) as g from (select unnest(string_split('{GOLD}', ' ')) as word) group by 1) select doc_id, round(sum(n * coalesce(g, 0)) / (sqrt(sum(n * n)) * (select sqrt(sum(g * g)) from g)), 6) as similarity from w left join g using (word) group by doc_id",
    "normalize_basic": f"{DB} select url, url as normal from db",
    "signature_profile": """with w as (select doc_id, word, count(*) as n from (select doc_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'), ' ')) as word from documents) where length(word) > 2 group by 1, 2),
s as (select doc_id, greatest(cast(round(max(n) * 0.01) as bigint), case when max(n) > 1 then 2 else 1 end) as step from w group by 1), q as (select doc_id, word, n // step * step as n, step from w join s using (doc_id))
select d.doc_id, case when d.text is not null then md5(coalesce(string_agg(q.word || ' ' || q.n, chr(10) order by q.n desc, q.word), '')) end as signature from documents d left join q on q.doc_id = d.doc_id and q.n >= q.step group by d.doc_id, d.text""",
    "url_reversed": f"{_U}, p as (select url, h, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as s, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*?(:[0-9]+)(?:[/?#]|$)', 1) as port, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$', 1) as rest from u) select url, array_to_string(list_reverse(string_split(h, '.')), '.') || ':' || s || port || rest as key, (s || '://' || h || port || rest) = lower(url) as back from p",
}
