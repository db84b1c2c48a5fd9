"""Databases as files: dumps as lines, versions that are installed whole, and lookups by key.

The line functions give one text per row (or group) and leave the writing to ``df.write.text``; nothing here sorts or collects a table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.crawldb import DAY, status_name

# Header lines of the dumps.
RECORD_HEADER = "Url,Status code,Status name,Fetch Time,Modified Time,Retries since fetch,Retry interval seconds,Retry interval days,Score,Signature,Metadata"
HOST_HEADER = "hostname\tunfetched\tfetched\tgone\tredirTemp\tredirPerm\tnotModified\tnumRecords\tdnsFail\tcnxFail\tsumFail\tscore\tlastCheck\thomepage\tmetadata"


def _text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(_text(c), '"', '""'), F.lit('"'))


def csv_lines(df: DataFrame) -> DataFrame:
    """Column line: a record as comma-separated values in the order of RECORD_HEADER, texts quoted, quotes in them doubled; null values are empty, a null signature is the text null."""
    days = F.col("retry_interval_seconds") / DAY
    parts = [_quoted("url"), _text("status_code"), _quoted(status_name(F.col("status_code"))), _text("fetch_time"), _text("modified_time"), _text("retries_since_fetch"), _text("retry_interval_seconds"), _text(F.round(days, 6)), _text("score"), _quoted(F.coalesce("signature", F.lit("null"))), _quoted("metadata")]
    return df.select(F.concat_ws(",", *parts).alias("line"))


def json_lines(df: DataFrame) -> DataFrame:
    """Column line: a record as one JSON object; null fields are left out."""
    return df.select(F.to_json(F.struct(
        "url", F.col("status_code").alias("statusCode"), status_name(F.col("status_code")).alias("statusName"), F.col("fetch_time").cast("string").alias("fetchTime"), F.col("modified_time").alias("modifiedTime"),
        F.col("retries_since_fetch").alias("retriesSinceFetch"), F.col("retry_interval_seconds").cast("long").alias("retryIntervalSeconds"), F.floor(F.col("retry_interval_seconds") / DAY).alias("retryIntervalDays"),
        F.nanvl("score", F.lit(None).cast("double")).alias("score"), "signature", "metadata",
    )).alias("line"))


def text_lines(df: DataFrame) -> DataFrame:
    """Columns url and text: a record as a block of labelled lines."""
    label = lambda name, c: F.concat(F.lit(f"{name}: "), _text(c))
    block = F.concat_ws("\n", F.concat(F.lit("Status: "), _text("status_code"), F.lit(" ("), status_name(F.col("status_code")), F.lit(")")), label("Fetch time", F.date_format("fetch_time", "yyyy-MM-dd HH:mm:ss")), label("Modified time", "modified_time"), label("Retries since fetch", "retries_since_fetch"), F.concat(F.lit("Retry interval: "), _text(F.col("retry_interval_seconds").cast("long")), F.lit(" seconds ("), _text(F.floor(F.col("retry_interval_seconds") / DAY)), F.lit(" days)")), label("Score", "score"), label("Signature", "signature"), label("Metadata", "metadata"))
    return df.select("url", block.alias("text"))


def link_lines(links: DataFrame, pattern: str | None = None) -> DataFrame:
    """Columns url and line: every link of a target as a line of its own, targets that match the whole-URL pattern only; one row a link, so that a target with very many has no row of its own size."""
    d = links.where(F.col("url").rlike(f"^(?:{pattern})$")) if pattern else links
    return d.select("url", F.concat(F.lit(" fromUrl: "), _text("from_url"), F.lit(" anchor: "), _text("anchor")).alias("line"))


def host_lines(hosts: DataFrame, only: str | None = None) -> DataFrame:
    """Column line: a host as tab-separated values in the order of HOST_HEADER; only: "hostnames" or "homepages" (hosts without one are left out)."""
    have = set(hosts.columns)
    if only == "homepages":
        return hosts.where("homepage is not null and homepage <> ''").select(F.col("homepage").alias("line"))
    if only == "hostnames":
        return hosts.select(F.col("host").alias("line"))
    number = lambda c: _text(c) if c in have else F.lit("0")
    dns, cnx = (F.col(c) if c in have else F.lit(0) for c in ("dns_failures", "connection_failures"))
    parts = [_text("host"), *map(number, ("unfetched", "fetched", "gone", "redir_temp", "redir_perm", "not_modified", "num_records")), _text(dns), _text(cnx), _text(dns + cnx), number("score"), *[_text(c) if c in have else F.lit("") for c in ("last_check", "homepage", "metadata")]]
    return hosts.select(F.concat_ws("\t", *parts).alias("line"))


def node_lines(nodes: DataFrame, value: str, separator: str = "\t") -> DataFrame:
    """Column line: URL and one value of a node, parted by a tab or, for ranking files, by "="."""
    return nodes.select(F.concat(_text("url"), F.lit(separator), _text(value)).alias("line"))


def merged_sitemap(records: DataFrame, entries: DataFrame, overwrite: bool = False, score: float = 1.0, interval: int = 30 * DAY) -> DataFrame:
    """Records (url, status_code, score, interval, modified_time) with sitemap entries (url, score, interval, modified_time): new URLs come in as unfetched, known ones stay, or with ``overwrite`` take what the entry says.

    Repeated entries count once (the largest score); null or non-positive scores and null intervals are the defaults for new URLs and no news for known ones.
    """
    e = entries.where("url is not null").groupBy("url").agg(F.max(F.when(F.col("score") > 0, F.col("score"))).alias("es"), F.min("interval").cast("double").alias("ei"), F.max("modified_time").alias("em"))
    d = records.select("url", "status_code", "score", F.col("interval").cast("double").alias("interval"), "modified_time", F.lit(True).alias("known"))
    new = F.col("known").isNull()
    pick = lambda old, got, default: F.when(new, F.coalesce(got, F.lit(default))).otherwise(F.coalesce(got, old) if overwrite else F.col(old))
    return d.join(e, "url", "full").select("url", F.when(new, 1).otherwise(F.col("status_code")).alias("status_code"), pick("score", "es", score).alias("score"), pick("interval", "ei", float(interval)).alias("interval"), pick("modified_time", "em", None).alias("modified_time"))


def lookup(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows with one of the keys; the test is pushed down to the scan.  No keys give no rows."""
    return df.where(F.col(key).isin(*values)) if values else df.limit(0)


def install(df: DataFrame, folder: str) -> int:
    """Write a database as the next version under ``folder`` and mark it complete; readers (current) see the old one until then.  Gives the version."""
    spark = df.sparkSession
    version = (installed(spark, folder) or 0) + 1
    df.write.mode("overwrite").parquet(f"{folder}/data/version={version}")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("overwrite").json(f"{folder}/complete/mark={version}")
    return version


def installed(spark: SparkSession, folder: str) -> int | None:
    """The newest complete version, or None."""
    try:
        return spark.read.schema("version long").json(f"{folder}/complete").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None


def current(spark: SparkSession, folder: str, back: int = 0) -> DataFrame | None:
    """The newest complete version of a database (``back`` versions earlier), or None."""
    version = installed(spark, folder)
    return None if version is None or version <= back else spark.read.parquet(f"{folder}/data/version={version - back}")
