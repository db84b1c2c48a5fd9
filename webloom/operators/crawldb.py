"""Operators on the table of URL records (crawl database).

Records have url, status, fetch_time, retries, interval (seconds), score, signature and modified_time under the column names of
``FIELDS``; further columns ride along.  Null scores and NaN count as no score; null statuses match no predicate.  All operators
accept empty tables and repeated rows; each docstring says what repeated rows mean.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.url import domain_of, host_of
from webloom.operators.ranks import exact_quantiles

# Status codes and names of URL records.
STATUS = {
    1: "db_unfetched", 2: "db_fetched", 3: "db_gone", 4: "db_redir_temp", 5: "db_redir_perm", 6: "db_notmodified", 7: "db_duplicate", 8: "db_orphan",
    9: "db_parse_failed", 33: "fetch_success", 34: "fetch_retry", 35: "fetch_redir_temp", 36: "fetch_redir_perm", 37: "fetch_gone", 38: "fetch_notmodified",
    65: "signature", 66: "injected", 67: "linked", 68: "parse_metadata", 69: "parse_failed",
}
CODE = {v: k for k, v in STATUS.items()}
DAY = 86_400


def status_name(code: Column) -> Column:
    """Name of a status code; "unknown" for others."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), code.cast("int")), F.lit("unknown"))


def newest(df: DataFrame, key: str, *by: str) -> DataFrame:
    """One row per key: that with the largest values of ``by``, in order (nulls least; equal rows: any one); null keys form one group.

    A rank in a window, of which Spark keeps the first row before the shuffle (group limit), so that a hot key is cut down early and
    columns nobody asks for are pruned down to the scan.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in by])))
    return ranked.where("__rank = 1").drop("__rank")


def stats(df: DataFrame) -> DataFrame:
    """Counts of records in all, by status, by retries and by status and host, in one pass of grouping sets; columns kind, status, retries, host, records."""
    base = df.select(F.col("status_code").alias("status"), F.col("retries_since_fetch").alias("retries"), host_of(F.col("url")).alias("host"))
    out = base.groupingSets([[], ["status"], ["retries"], ["status", "host"]], "status", "retries", "host").agg(F.grouping_id().alias("g"), F.count("*").alias("records"))
    kind = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "status").when(F.col("g") == 5, "retries").otherwise("status_host")
    return out.select(kind.alias("kind"), "status", "retries", "host", "records")


def score_stats(df: DataFrame) -> DataFrame:
    """Least, largest and mean score (the mean over all records, those without a score as 0), number of NaN scores, fetch times in whole minutes, intervals."""
    s = F.when(~F.isnan("score"), F.col("score"))
    minute = F.floor(F.unix_timestamp(F.col("fetch_time").cast("timestamp")) / 60)
    iv = F.col("retry_interval_seconds")
    return df.agg(
        F.count("*").alias("records"), F.min(s).alias("score_min"), F.max(s).alias("score_max"), F.try_divide(F.coalesce(F.sum(s), F.lit(0.0)), F.count("*")).alias("score_avg"), F.count_if(F.isnan("score")).alias("score_nan"),
        F.min(minute).alias("minute_min"), F.max(minute).alias("minute_max"), F.floor(F.try_divide(F.sum(minute), F.count(minute))).alias("minute_avg"), F.min(iv).alias("interval_min"), F.max(iv).alias("interval_max"), F.avg(iv).alias("interval_avg"),
    )


def quantiles(df: DataFrame, points: list[float], exact: bool = False) -> DataFrame:
    """Score quantiles: columns quantile, score.  By a mergeable sketch unless ``exact``, which sorts over all partitions; points outside 0 to 1 are skipped."""
    points = [p for p in points if 0 <= p <= 1]
    if exact:
        return exact_quantiles(df.select(F.lit(0).alias("all"), "score"), "all", "score", points).drop("all")
    s = F.when(~F.isnan("score"), F.col("score"))
    return df.agg(F.percentile_approx(s, points, 10_000).alias("q")).select(F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in points]).alias("quantile"), F.col("q").alias("score"))).alias("x")).select("x.*")


def matching(df: DataFrame, status: str | None = None, least_retries: int | None = None, url_pattern: str | None = None, expression: str | None = None, sample: float | None = None) -> DataFrame:
    """Dump predicates: status by name in any case, retries of at least, whole-URL regular expression, SQL expression, share of URLs (by hash, so repeatable)."""
    tests = []
    if status is not None:
        tests.append(F.lower("status_name") == status.lower())
    if least_retries is not None:
        tests.append(F.col("retries_since_fetch") >= least_retries)
    if url_pattern is not None:
        tests.append(F.col("url").rlike(f"^(?:{url_pattern})$"))
    if expression is not None:
        tests.append(F.expr(translated(expression)))
    if sample is not None:
        tests.append(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(sample * 1_000_000))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


_TOKEN = re.compile(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(=~|&&|\|\||==|!=|!|\b(?:score|null)\b)|([^'"=&|!\w]+|\w+|.)""", re.S)
_SQL = {"&&": " AND ", "||": " OR ", "==": "=", "!=": "<>", "!": " NOT ", "score": "nanvl(score, NULL)", "null": "NULL"}


def translated(expression: str) -> str:
    """A record expression with &&, ||, !, == and =~ (whole match) as SQL; quoted text stays as it is, and a NaN score passes no test."""
    out: list[str] = []
    match = False
    for quoted, sign, rest in _TOKEN.findall(expression):
        if quoted:
            text = "'" + quoted[1:-1].replace("\\" + quoted[0], quoted[0]).replace("'", "\\'") + "'"
            if match:
                left = out.pop()
                text, match = f"rlike({left}, '^(?:{text[1:-1]})$')", False
            out.append(text)
        elif sign == "=~":
            match = True
            while out and not out[-1].strip():
                out.pop()
        elif sign:
            out.append(_SQL[sign])
        elif not (match and not rest.strip()):
            out.append(rest)
    return "".join(out)


def top(df: DataFrame, n: int, least: float = 0.0) -> DataFrame:
    """The n records with the highest scores of at least ``least``; equal scores by URL."""
    return df.where(~F.isnan("score") & (F.col("score") >= least)).orderBy(F.desc("score"), F.asc("url")).limit(n)


def reject_reason(now: Column, least_score: float = 0.0, most_interval: float | None = None) -> Column:
    """First reason for which a record isn't due, null if it is: status, schedule, score, interval."""
    out = F.when(F.col("status_code").isin(3, 7, 8), "status").when(F.col("fetch_time") > now, "schedule").when(F.col("score").isNull() | F.isnan("score") | (F.col("score") < least_score), "score")
    return out.when(F.col("retry_interval_seconds") > most_interval, "interval") if most_interval is not None else out


def generate(df: DataFrame, now: Column, n: int, per_host: int, segments: int = 1, least_score: float = 0.0, most_interval: float | None = None) -> DataFrame:
    """Fetch lists: due records, best score first, at most ``per_host`` of a host in a segment and ``n`` in all in a segment.

    A host fills segment 1 first, then 2 and so on; what is over is left.  Equal scores rank by URL.  Records whose URL has no host name
    (``file:/path``) count as one host, with host null; a null URL or one without a scheme is left out.
    The per-host rank is a window over hosts, in which Spark keeps only the rows that can still count (group limit), so a
    host of a third of all records is cut down before its rows are shuffled.
    """
    due = df.where(reject_reason(now, least_score, most_interval).isNull()).where(F.col("url").rlike("^(https?|ftp|file):")).withColumn("host", host_of(F.col("url")))
    by = [F.desc("score"), F.asc("url")]
    ranked = due.withColumn("rn", F.row_number().over(Window.partitionBy("host").orderBy(*by))).where(F.col("rn") <= per_host * segments)
    ranked = ranked.withColumn("segment", F.ceil(F.col("rn") / per_host).cast("int")).drop("rn")
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("segment").orderBy(*by))).where(F.col("place") <= n)


def deduplicate(df: DataFrame, group: str = "none", order: tuple[str, ...] = ("score", "fetch_time", "url_length")) -> DataFrame:
    """Records with the same signature (and host or registered domain, if group is "host" or "domain"), all but the best marked duplicate: column ``duplicate``.

    Only fetched and unmodified records with a signature take part.  Best is, by the criteria of ``order``, one after the other: the higher
    "score", the newer "fetch_time", the shorter "url_length" (percent escapes decoded where they can be), "https" before other
    schemes; records equal in all of them are all kept.  Best values are found by aggregation, so a signature that a third of all records
    have is no hot window.
    """
    part = F.col("status_code").isin(2, 6) & F.col("signature").isNotNull() & (F.col("signature") != "null")
    criteria = {
        "score": F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0)), "fetch_time": F.col("fetch_time"),
        "url_length": -F.length(F.coalesce(F.try_url_decode("url"), F.col("url"))), "https": F.lower("url").startswith("https:"),
    }
    key = {"none": F.lit(""), "host": host_of(F.col("url")), "domain": domain_of(host_of(F.col("url")))}[group]
    d = df.withColumn("__rank", F.struct(*[criteria[c].alias(c) for c in order])).withColumn("__g", F.coalesce(key, F.lit("")))
    best = d.where(part).groupBy("signature", "__g").agg(F.max("__rank").alias("__best"))
    part = F.coalesce(part, F.lit(False))
    # records that take no part, such as all those without a signature, don't go through the join
    seen = d.where(part).join(best, ["signature", "__g"]).withColumn("duplicate", F.col("__rank") != F.col("__best")).drop("__rank", "__g", "__best")
    return seen.select(*df.columns, "duplicate").unionByName(df.where(~part).withColumn("duplicate", F.lit(False)))


def inject(df: DataFrame, seeds: DataFrame, mode: str = "keep", score: float = 1.0, interval: int = 30 * DAY) -> DataFrame:
    """Records merged with seeds (url, score, interval; null for the default): columns url, status_code, score, interval.

    New URLs come in as unfetched.  Known ones stay ("keep"), are replaced ("overwrite"), or take those seed values that differ from the
    defaults ("update").  df and seeds have one row per URL; a NaN score comes out as null.
    """
    new = seeds.select("url", F.coalesce("score", F.lit(score)).alias("s"), F.coalesce("interval", F.lit(interval)).cast("double").alias("i"), F.lit(True).alias("seeded"))
    j = df.select("url", "status_code", "score", F.col("retry_interval_seconds").alias("interval"), F.lit(True).alias("known")).join(new, "url", "full")
    fresh = F.col("known").isNull() | (F.lit(mode == "overwrite") & F.col("seeded").isNotNull())
    update = F.lit(mode == "update") & F.col("seeded").isNotNull()
    return j.select(
        "url", F.when(fresh, 1).otherwise(F.col("status_code")).alias("status_code"),
        F.when(fresh | (update & (F.col("s") != score)), F.col("s")).otherwise(F.nanvl("score", F.lit(None).cast("double"))).alias("score"),
        F.when(fresh | (update & (F.col("i") != interval)), F.col("i")).otherwise(F.col("interval")).alias("interval"),
    )


def update(df: DataFrame, fetched: DataFrame, linked: DataFrame, most_retries: int = 3, most_interval: float = 90.0 * DAY, additions: bool = True) -> DataFrame:
    """Records after a round: the state machine over known records, fetch results and links.

    fetched: url, fetch_status, fetched_at, new_signature, one row per URL; linked: url, link_score, one row per URL.
    Columns url, status_code, retries, interval, fetch_time, score, signature.  Success keeps the old state's schedule, gone and failed
    parses wait half as long again (nine tenths of the longest wait beyond that), a retry waits a day until ``most_retries`` turn it to gone.
    """
    old = df.select("url", F.col("status_code").alias("os"), F.col("retries_since_fetch").alias("orr"), F.col("retry_interval_seconds").alias("oi"), F.col("fetch_time").alias("ot"), F.col("score").alias("osc"), F.col("signature").alias("osig"))
    j = old.join(fetched, "url", "full").join(linked, "url", "full")
    if not additions:
        j = j.where("os is not null")
    fs, interval = F.col("fetch_status"), F.coalesce("oi", F.lit(30.0 * DAY))
    retries = F.coalesce("orr", F.lit(0))
    given_up = (fs == 34) & (retries + 1 >= most_retries)
    gone = fs.isin(37, 69) | given_up
    longer = F.when(interval * 1.5 < most_interval, interval * 1.5).otherwise(0.9 * most_interval)
    status = F.when(fs.isNull(), F.coalesce("os", F.lit(1)))
    for code, to in ((33, 2), (35, 4), (36, 5), (38, 6), (69, 9), (37, 3)):
        status = status.when(fs == code, to)
    new_interval = F.when(gone, longer).otherwise(interval)
    wait = F.when(fs == 34, F.when(given_up, longer).otherwise(float(DAY))).otherwise(new_interval)
    return j.select(
        "url", status.when(given_up, 3).otherwise(1).alias("status_code"),
        F.when(fs == 34, retries + 1).when(fs.isNull(), retries).otherwise(0).alias("retries"), new_interval.alias("interval"),
        F.when(fs.isNull(), F.col("ot")).otherwise(F.timestamp_add("SECOND", wait.cast("int"), F.col("fetched_at"))).alias("fetch_time"),
        F.coalesce("osc", "link_score", F.lit(0.0)).alias("score"), F.when(fs.isin(33, 35, 36), F.col("new_signature")).otherwise(F.col("osig")).alias("signature"),
    )


def adaptive_interval(interval: Column, state: Column, up: float = 0.2, down: float = 0.2, least: float = 60.0, most: float = 365.0 * DAY) -> Column:
    """Next wait: shorter by ``down`` after a change ("modified"), longer by ``up`` without one ("notmodified"), within bounds."""
    i = F.when(state == "modified", interval * (1 - down)).when(state == "notmodified", interval * (1 + up)).otherwise(interval)
    return F.greatest(F.lit(least), F.least(F.lit(most), i))


def merged(*dbs: DataFrame) -> DataFrame:
    """Several databases as one: of each URL the record fetched last, then due last, wins."""
    all_ = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dbs)
    last = F.when(F.col("status_code") == 1, F.lit(0)).otherwise(F.unix_timestamp(F.col("fetch_time").cast("timestamp")) - F.col("retry_interval_seconds"))
    return newest(all_.withColumn("__last", last), "url", "__last", "fetch_time", "rec_id").drop("__last")


def host_table(df: DataFrame) -> DataFrame:
    """Per host: records by status, rows that failed to connect, records in all."""
    n = lambda *codes: F.count_if(F.col("status_code").isin(*codes))
    return (
        df.withColumn("host", host_of(F.col("url"))).where("host is not null").groupBy("host")
        .agg(n(1).alias("unfetched"), n(2).alias("fetched"), n(6).alias("not_modified"), n(4).alias("redir_temp"), n(5).alias("redir_perm"), n(3).alias("gone"), F.count_if(F.col("retries_since_fetch") != 0).alias("connection_failures"))
        .withColumn("num_records", F.expr("unfetched + fetched + not_modified + redir_temp + redir_perm + gone"))
    )


def failure_label(failures: Column) -> Column:
    return F.when(failures <= 3, F.concat(failures.cast("string"), F.lit("_times_failed"))).when(failures <= 10, "4-10_times_failed").otherwise(">10_times_failed")
