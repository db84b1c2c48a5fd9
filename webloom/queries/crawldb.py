"""Queries on the crawl database: crawl_dump, one record per URL (the newest) where a query needs it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions.url import domain_of, host_of, suffix_of, tld_of
from webloom.operators import crawldb as C
from webloom.operators.ranks import exact_quantiles
from webloom.plans.session import table

NOW = "2025-03-01 00:00:00"
_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1))"
DB = "with db as (select * from (select *, row_number() over (partition by url order by fetch_time desc, rec_id desc) as rn_ from crawl_dump) where rn_ = 1)"


def dump(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "crawl_dump")


def db(spark: SparkSession, folder: str) -> DataFrame:
    return C.newest(dump(spark, folder), "url", "fetch_time", "rec_id")


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


def crawldb_stats(spark, folder):
    return C.stats(dump(spark, folder))


def crawldb_score_stats(spark, folder):
    return C.score_stats(dump(spark, folder)).select("records", "score_min", "score_max", F.round("score_avg", 6).alias("score_avg"), "score_nan", "minute_min", "minute_max", "minute_avg", "interval_min", "interval_max", F.round("interval_avg", 4).alias("interval_avg"))


def crawldb_score_quantiles(spark, folder):
    return C.quantiles(dump(spark, folder), [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99], exact=True).withColumn("score", F.round("score", 6))


def crawldb_newest(spark, folder):
    return db(spark, folder).select("url", "rec_id", "status_code", "fetch_time")


def crawldb_dump_filtered(spark, folder):
    return C.matching(dump(spark, folder), status="DB_Fetched", least_retries=1, url_pattern="https?://www\\..*", expression='score > 0.3 && retries_since_fetch != 2').select("rec_id", "url", "score")


def crawldb_sample(spark, folder):
    return C.matching(dump(spark, folder), sample=0.1).select("rec_id", "url")


def crawldb_dump_json(spark, folder):
    t = dump(spark, folder)
    return t.select("rec_id", F.to_json(F.struct("url", F.col("status_code").alias("statusCode"), C.status_name(F.col("status_code")).alias("statusName"), F.col("retries_since_fetch").alias("retriesSinceFetch"))).alias("json"))


def crawldb_dump_csv(spark, folder):
    return dump(spark, folder).select("rec_id", F.concat_ws(",", F.concat(F.lit('"'), "url", F.lit('"')), "status_code", F.concat(F.lit('"'), "status_name", F.lit('"')), "retries_since_fetch").alias("line"))


def crawldb_top(spark, folder):
    return C.top(db(spark, folder), 50, 0.1).select("url", "score")


def crawldb_purge(spark, folder):
    return db(spark, folder).where(~F.col("status_code").isin(3, 8)).groupBy("status_name").agg(F.count("*").alias("records"))


def generate_fetch_list(spark, folder):
    return C.generate(db(spark, folder), _now(), 500, 5, 2, 0.05, 90.0 * C.DAY).select("segment", "place", "url", "host", "score")


def generate_rejects(spark, folder):
    r = F.coalesce(C.reject_reason(_now(), 0.05, 30.0 * C.DAY), F.lit("none"))
    return db(spark, folder).groupBy(r.alias("reason")).agg(F.count("*").alias("records"))


def generate_marked(spark, folder):
    d = db(spark, folder)
    made = C.generate(d, _now(), 500, 5, 2, 0.05, 90.0 * C.DAY).select("url", F.lit(True).alias("generated"))
    return d.join(made, "url", "left").select("url", F.coalesce("generated", F.lit(False)).alias("generated"))


def _signed(spark, folder):
    """Fetched pages as records, signed by their content: copies under other URLs have the same signature."""
    d = C.newest(table(spark, folder, "index_docs"), "url", "segment", "page_id")
    return d.select("url", F.lit(2).alias("status_code"), F.col("boost").alias("score"), F.col("tstamp").alias("fetch_time"), F.md5("content").alias("signature"))


def dedup_signature(spark, folder):
    return C.deduplicate(_signed(spark, folder)).where("duplicate").select("url", "signature")


def dedup_signature_host(spark, folder):
    return C.deduplicate(_signed(spark, folder), "host").where("duplicate").select("url", "signature")


def dedup_signature_domain(spark, folder):
    """Duplicates within a registered domain: https first, then the newer fetch."""
    return C.deduplicate(_signed(spark, folder), "domain", ("https", "fetch_time", "score")).where("duplicate").select("url", "signature")


def _seeds(spark, folder):
    t = table(spark, folder, "cc_records")
    n = F.min("rec_id")
    return t.groupBy("url").agg(n.alias("n")).select("url", F.when(F.col("n") % 3 == 0, 2.5).alias("score"), F.when(F.col("n") % 4 == 0, 171717).alias("interval"))


def _inject(mode):
    def q(spark, folder):
        return C.inject(db(spark, folder), _seeds(spark, folder), mode)

    q.__doc__ = f"Seeds merged into the records, mode {mode}."
    return q


def update_round(spark, folder):
    cc = table(spark, folder, "cc_records")
    s = F.col("response_status")
    status = F.when(s == 200, 33).when(s == 301, 36).when(s == 302, 35).when(s == 304, 38).when(s.isin(404, 410), 37).when(s.isNull(), 69).otherwise(34)
    got = C.newest(cc.select("url", status.alias("fetch_status"), F.col("imported").alias("fetched_at"), F.col("record_key").alias("new_signature"), "rec_id"), "url", "rec_id").drop("rec_id")
    links = table(spark, folder, "inlinks").groupBy("url").agg(F.countDistinct("from_url").cast("double").alias("link_score"))
    return C.update(db(spark, folder), got, links)


def schedule_adaptive(spark, folder):
    state = F.when(F.col("status_code") == 6, "notmodified").when(F.col("status_code") == 2, "modified").otherwise("unknown")
    return db(spark, folder).select("url", F.round(C.adaptive_interval(F.col("retry_interval_seconds"), state), 3).alias("interval"))


def crawldb_merge(spark, folder):
    d = dump(spark, folder)
    return C.merged(d.where("node < 'fetch-10'"), d.where("node >= 'fetch-10'")).select("url", "rec_id", "status_code")


def host_update(spark, folder):
    return C.host_table(db(spark, folder))


def host_filter(spark, folder):
    return C.host_table(db(spark, folder)).where("fetched + not_modified > 2 and connection_failures >= 1").select("host", "num_records")


def host_score_stats(spark, folder):
    d = db(spark, folder).where(F.col("status_code").isin(2, 6) & F.col("score").isNotNull() & ~F.isnan("score")).withColumn("host", host_of(F.col("url")))
    return d.groupBy("host").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(F.avg("score"), 6).alias("mean")).where("n >= 3")


def host_failures(spark, folder):
    n = C.host_table(db(spark, folder)).where("connection_failures > 0").select(C.failure_label(F.col("connection_failures")).alias("label"))
    return n.groupBy("label").agg(F.count("*").alias("hosts"))


def host_overdue(spark, folder):
    d = db(spark, folder).withColumn("host", host_of(F.col("url")))
    return d.groupBy("host").agg(F.count_if((F.col("status_code") == 1) & (F.col("fetch_time") < F.to_timestamp_ntz(F.lit("2025-02-27 00:00:00")))).alias("overdue"))


def _domains(mode):
    key = {"host": lambda h: h, "domain": domain_of, "suffix": suffix_of, "tld": tld_of}[mode]

    def q(spark, folder):
        d = db(spark, folder).where(F.col("status_code").isin(2, 6))
        return d.groupBy(key(host_of(F.col("url"))).alias("name")).agg(F.count("*").alias("pages"))

    q.__doc__ = f"Fetched pages by {mode}."
    return q


def crawl_completion(spark, folder):
    d = db(spark, folder)
    return d.groupBy(host_of(F.col("url")).alias("host"), F.when(F.col("status_code") == 1, "UNFETCHED").otherwise("FETCHED").alias("state")).agg(F.count("*").alias("pages"))


def protocol_status(spark, folder):
    code = F.coalesce(F.col("response_status").cast("string"), F.lit("UNFETCHED"))
    return table(spark, folder, "cc_records").groupBy(code.alias("code")).agg(F.count("*").alias("records"))


def fetch_order(spark, folder):
    """Due URLs in an order in which hosts interleave."""
    return db(spark, folder).where("status_code = 1").select("url", F.md5(F.reverse("url")).alias("sort_key"))


def latency_digest(spark, folder):
    t = table(spark, folder, "events").select("event_type", "value")
    points = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    q = exact_quantiles(t, "event_type", "value", list(points)).groupBy("event_type").agg(*[F.round(F.max(F.when(F.col("quantile") == p, F.col("value"))), 4).alias(n) for p, n in points.items()])
    return t.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).join(q, "event_type", "left")


def score_orphans(spark, folder):
    """Records whose last link is long ago: gone after 30 days, orphan after 40."""
    d = db(spark, folder)
    linked = table(spark, folder, "inlinks").select("url").distinct().withColumn("has", F.lit(True))
    age = F.date_diff(F.to_date(F.lit(NOW)), F.to_date("fetch_time"))
    state = F.when(F.col("has"), F.col("status_code")).when(age > 40, 8).when(age > 30, 3).otherwise(F.col("status_code"))
    return d.join(linked, "url", "left").select("url", state.alias("status_code"))


def score_opic(spark, folder):
    """Scores after each page has shared its score evenly among its links."""
    links = table(spark, folder, "inlinks").select("url", "from_url").where("url <> from_url").distinct()
    out = links.groupBy("from_url").agg(F.count("*").alias("n"))
    d = db(spark, folder).select("url", F.when(~F.isnan("score"), F.col("score")).otherwise(0.0).alias("score"))
    share = out.join(d.withColumnRenamed("url", "from_url"), "from_url").select("from_url", (F.coalesce("score", F.lit(0.0)) / F.col("n")).alias("share"))
    got = links.join(share, "from_url").groupBy("url").agg(F.sum("share").alias("got"))
    return d.join(got, "url", "left").select("url", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("got", F.lit(0.0)), 6).alias("score"))


QUERIES = {f.__name__: f for f in (
    crawldb_stats, crawldb_score_stats, crawldb_score_quantiles, crawldb_newest, crawldb_dump_filtered, crawldb_sample, crawldb_dump_json, crawldb_dump_csv, crawldb_top, crawldb_purge,
    generate_fetch_list, generate_rejects, generate_marked, dedup_signature, dedup_signature_host, dedup_signature_domain, update_round, schedule_adaptive, crawldb_merge, host_update, host_filter, host_score_stats,
    host_failures, host_overdue, crawl_completion, protocol_status, fetch_order, latency_digest, score_orphans, score_opic,
)} | {f"inject_{m}": _inject(m) for m in ("keep", "overwrite", "update")} | {f"domain_stats_{m}": _domains(m) for m in ("host", "domain", "suffix", "tld")}

_OK = "score is not null and not isnan(score)"
_REASON = f"case when status_code in (3, 7, 8) then 'status' when fetch_time > timestamp '{NOW}' then 'schedule' when not ({_OK}) or score < 0.05 then 'score' when retry_interval_seconds > %s then 'interval' end"
_GEN = f"""{DB}, due as (select url, {_HOST} as host, score from db where ({_REASON % '90.0 * 86400'}) is null),
r as (select *, row_number() over (partition by host order by score desc, url) as rn from due where host <> ''),
g as (select *, cast(ceil(rn / 5.0) as integer) as segment from r where rn <= 10),
f as (select *, row_number() over (partition by segment order by score desc, url) as place from g)"""
_HOSTDB = f"""{DB}, hd as (select {_HOST} as host, count(*) filter (status_code = 1) as unfetched, count(*) filter (status_code = 2) as fetched, count(*) filter (status_code = 6) as not_modified,
count(*) filter (status_code = 4) as redir_temp, count(*) filter (status_code = 5) as redir_perm, count(*) filter (status_code = 3) as gone, count(*) filter (retries_since_fetch <> 0) as connection_failures from db where {_HOST} <> '' group by 1),
h as (select *, unfetched + fetched + not_modified + redir_temp + redir_perm + gone as num_records from hd)"""
_DEDUP = f"""with n as (select * from (select *, row_number() over (partition by url order by segment desc, page_id desc) as k from index_docs) where k = 1),
d as (select url, tstamp as fetch_time, md5(content) as signature, coalesce(case when not isnan(boost) then boost end, 0.0) as s, %s as g from n where content is not null),
r as (select *, rank() over (partition by signature, g order by s desc, fetch_time desc, length(url)) as k from d) select url, signature from r where k > 1"""
_SEEDS = "seeds as (select url, case when min(rec_id) % 3 = 0 then 2.5 else 1.0 end as s, case when min(rec_id) % 4 = 0 then 171717.0 else 2592000.0 end as i from cc_records group by url)"
_INJ = f"""{DB}, {_SEEDS} select coalesce(d.url, seeds.url) as url,
case when {{fresh}} then 1 else d.status_code end as status_code, case when {{fresh}} or ({{upd}} and s <> 1.0) then s when isnan(d.score) then null else d.score end as score,
case when {{fresh}} or ({{upd}} and i <> 2592000.0) then i else d.retry_interval_seconds end as interval from db d full join seeds on d.url = seeds.url"""
_TWO = "regexp_matches({h}, '\\.(co|org|ac|com|net)\\.(uk|au|nz|jp)$')"
SQL = {
    "crawldb_stats": f"""with b as (select status_code as status, retries_since_fetch as retries, {_HOST} as host from crawl_dump)
select case grouping(status, retries, host) when 7 then 'all' when 3 then 'status' when 5 then 'retries' else 'status_host' end as kind, status, retries, host, count(*) as records from b group by grouping sets ((), (status), (retries), (status, host))""",
    "crawldb_score_stats": f"""select count(*) as records, min(s) as score_min, max(s) as score_max, round(sum(s) / count(*), 6) as score_avg, count(*) filter (isnan(score)) as score_nan, min(m) as minute_min, max(m) as minute_max,
cast(floor(sum(m) / count(m)) as bigint) as minute_avg, min(retry_interval_seconds) as interval_min, max(retry_interval_seconds) as interval_max, round(avg(retry_interval_seconds), 4) as interval_avg
from (select *, case when not isnan(score) then score end as s, cast(floor(epoch(fetch_time) / 60) as bigint) as m from crawl_dump)""",
    "crawldb_score_quantiles": "select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as quantile, unnest(list_transform(quantile_cont(score, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]), lambda x: round(x, 6))) as score from crawl_dump where not isnan(score)",
    "crawldb_newest": f"{DB} select url, rec_id, status_code, fetch_time from db",
    "crawldb_dump_filtered": "select rec_id, url, score from crawl_dump where lower(status_name) = 'db_fetched' and retries_since_fetch >= 1 and regexp_full_match(url, 'https?://www\\..*') and not isnan(score) and score > 0.3 and retries_since_fetch <> 2",
    "crawldb_dump_json": "select rec_id, to_json({'url': url, 'statusCode': status_code, 'statusName': status_name, 'retriesSinceFetch': retries_since_fetch})::varchar as json from crawl_dump",
    "crawldb_dump_csv": "select rec_id, concat_ws(',', '\"' || url || '\"', status_code, '\"' || status_name || '\"', retries_since_fetch) as line from crawl_dump",
    "crawldb_top": f"{DB} select url, score from db where {_OK} and score >= 0.1 order by score desc, url limit 50",
    "crawldb_purge": f"{DB} select status_name, count(*) as records from db where status_code not in (3, 8) group by 1",
    "generate_fetch_list": f"{_GEN} select segment, cast(place as integer) as place, url, host, score from f where place <= 500",
    "generate_rejects": f"{DB} select coalesce({_REASON % '30.0 * 86400'}, 'none') as reason, count(*) as records from db group by 1",
    "generate_marked": f"{_GEN} select db.url, f.url is not null as generated from db left join (select url from f where place <= 500) f on db.url = f.url",
    "dedup_signature": _DEDUP % "''",
    "dedup_signature_host": _DEDUP % _HOST,
    "dedup_signature_domain": (_DEDUP % f"regexp_extract({_HOST}, '([^.]+\\.)?[^.]+$')").replace("s desc, fetch_time desc, length(url)", "starts_with(url, 'https:') desc, fetch_time desc, s desc"),
    "update_round": f"""{DB}, cc as (select url, case when response_status = 200 then 33 when response_status = 301 then 36 when response_status = 302 then 35 when response_status = 304 then 38 when response_status in (404, 410) then 37 when response_status is null then 69 else 34 end as fs,
imported as fetched_at, record_key as nsig from (select *, row_number() over (partition by url order by rec_id desc) as k from cc_records) where k = 1),
li as (select url, cast(count(distinct from_url) as double) as ls from inlinks group by url),
j as (select coalesce(db.url, cc.url, li.url) as url, status_code as os, coalesce(retries_since_fetch, 0) as r, coalesce(retry_interval_seconds, 2592000.0) as i, fetch_time as ot, score as osc, signature as osig, fs, fetched_at, nsig, ls
from db full join cc on db.url = cc.url full join li on coalesce(db.url, cc.url) = li.url),
k as (select *, coalesce(fs = 34 and r + 1 >= 3, false) as up, case when i * 1.5 < 7776000 then i * 1.5 else 6998400.0 end as longer from j),
m as (select *, case when fs in (37, 69) or up then longer else i end as ni from k)
select url, case when fs is null then coalesce(os, 1) when fs = 33 then 2 when fs = 35 then 4 when fs = 36 then 5 when fs = 38 then 6 when fs = 69 then 9 when fs = 37 then 3 when up then 3 else 1 end as status_code,
case when fs = 34 then r + 1 when fs is null then r else 0 end as retries, ni as interval,
case when fs is null then ot else fetched_at + to_seconds(cast(case when fs = 34 then (case when up then longer else 86400 end) else ni end as bigint)) end as fetch_time,
coalesce(osc, ls, 0.0) as score, case when fs in (33, 35, 36) then nsig else osig end as signature from m""",
    "schedule_adaptive": f"{DB} select url, round(greatest(60.0, least(31536000.0, case status_code when 6 then retry_interval_seconds * 1.2 when 2 then retry_interval_seconds * 0.8 else retry_interval_seconds end)), 3) as interval from db",
    "crawldb_merge": "select url, rec_id, status_code from (select *, row_number() over (partition by url order by case when status_code = 1 then 0 else epoch(fetch_time)::bigint - retry_interval_seconds end desc nulls last, fetch_time desc nulls last, rec_id desc) as k from crawl_dump where node is not null) where k = 1",
    "host_update": f"{_HOSTDB} select * from h",
    "host_filter": f"{_HOSTDB} select host, num_records from h where fetched + not_modified > 2 and connection_failures >= 1",
    "host_score_stats": f"{DB} select {_HOST} as host, count(*) as n, min(score) as least, max(score) as most, round(avg(score), 6) as mean from db where status_code in (2, 6) and {_OK} group by 1 having count(*) >= 3",
    "host_failures": f"{_HOSTDB} select case when connection_failures <= 3 then connection_failures || '_times_failed' when connection_failures <= 10 then '4-10_times_failed' else '>10_times_failed' end as label, count(*) as hosts from h where connection_failures > 0 group by 1",
    "host_overdue": f"{DB} select {_HOST} as host, count(*) filter (status_code = 1 and fetch_time < timestamp '2025-02-27') as overdue from db group by 1",
    "crawl_completion": f"{DB} select {_HOST} as host, case when status_code = 1 then 'UNFETCHED' else 'FETCHED' end as state, count(*) as pages from db group by 1, 2",
    "protocol_status": "select coalesce(response_status::varchar, 'UNFETCHED') as code, count(*) as records from cc_records group by 1",
    "fetch_order": f"{DB} select url, md5(reverse(url)) as sort_key from db where status_code = 1",
    "latency_digest": "select event_type, count(*) as n, round(sum(value), 2) as total, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, round(quantile_cont(value, 0.99), 4) as p99 from events group by 1",
    "score_orphans": f"{DB}, l as (select distinct url from inlinks) select db.url, case when l.url is not null then status_code when date_diff('day', fetch_time::date, date '2025-03-01') > 40 then 8 when date_diff('day', fetch_time::date, date '2025-03-01') > 30 then 3 else status_code end as status_code from db left join l on db.url = l.url",
    "score_opic": f"""{DB}, l as (select distinct url, from_url from inlinks where url <> from_url), o as (select from_url, count(*) as n from l group by 1),
d as (select url, coalesce(case when not isnan(score) then score else 0.0 end, 0.0) as score from db), g as (select l.url, sum(d.score / o.n) as got from l join o using (from_url) join d on d.url = l.from_url group by 1)
select d.url, round(d.score + coalesce(got, 0.0), 6) as score from d left join g on d.url = g.url""",
    "domain_stats_host": f"{DB} select {_HOST} as name, count(*) as pages from db where status_code in (2, 6) group by 1",
    "domain_stats_domain": f"{DB} select regexp_extract({_HOST}, '([^.]+\\.)?[^.]+$') as name, count(*) as pages from db where status_code in (2, 6) group by 1",
    "domain_stats_suffix": f"{DB} select regexp_extract({_HOST}, '[^.]+$') as name, count(*) as pages from db where status_code in (2, 6) group by 1",
    "domain_stats_tld": f"{DB} select regexp_extract({_HOST}, '[^.]+$') as name, count(*) as pages from db where status_code in (2, 6) group by 1",
} | {f"inject_{m}": _INJ.format(fresh=f, upd=u) for m, f, u in (("keep", "d.url is null", "false"), ("overwrite", "seeds.url is not null", "false"), ("update", "d.url is null", "seeds.url is not null"))}
