"""Lines repeated across one site's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.plans.workspace import staged


def line_form(text: Column) -> Column:
    """Text in the form in which lines are compared: lower case, runs of blanks, tabs and no-break spaces as one blank, runs of digits as one sign, line by line."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[ \t\u00a0]+", " "), "[0-9]+", "0")


def line_keys(text: Column, source: Column) -> Column:
    """Array with a 96-bit key of (source, line) for each line of text, null for blank lines."""
    return F.transform(
        F.transform(F.split(line_form(text), "\n"), lambda x: F.trim(x)),
        lambda x: F.when(x != "", F.struct(F.xxhash64(source, x).alias("a"), F.hash(x, source).alias("b"))),
    )


def collapsed(df: DataFrame, ident: str, source: str, text: str, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Line keys of every document, with hashes of its source (null for a null one) and text; and the documents with the same text in one source, as clusters with one ident (rep), their number of idents and first day."""
    base = df.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(
        F.col(ident).alias("ident"), F.when(F.col(source).isNotNull(), F.xxhash64(source)).alias("src"), F.xxhash64(text).alias("sig_a"), F.hash(text).alias("sig_b"),
        (F.to_date(date) if date else F.lit(None).cast("date")).alias("day"), line_keys(F.col(text), F.col(source)).alias("keys"),
    )
    base = staged(base, "lines")
    clusters = base.groupBy("src", "sig_a", "sig_b", "ident").agg(F.min("day").alias("day")).groupBy("src", "sig_a", "sig_b").agg(F.min("ident").alias("rep"), F.count("*").alias("n"), F.min("day").alias("day"))
    return base, clusters


def lone_lines(base: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct line keys of each cluster, with its number of idents and first day; clusters without a source have none."""
    lone = base.select("ident", "src", "sig_a", "sig_b", "keys").join(
        clusters.withColumnRenamed("day", "first_day"), (F.col("ident") == F.col("rep")) & (base.src == clusters.src) & (base.sig_a == clusters.sig_a) & (base.sig_b == clusters.sig_b)
    )
    return lone.select("n", "first_day", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")


def key_counts(lines: DataFrame) -> DataFrame:
    """Number of idents (n) and of clusters (c) by line key."""
    return lines.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("c"))


def counted_lines(df: DataFrame, ident: str, source: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Line keys and clusters (of collapsed) and key counts, stored, for those who ask more than once."""
    base, clusters = collapsed(df, ident, source, text)
    clusters = staged(clusters, "texts")
    return base, clusters, staged(key_counts(lone_lines(base, clusters)), "line-counts")


def places_of(base: DataFrame, often: DataFrame, ident: str) -> DataFrame:
    """Columns ident and line_no of every line whose key is in often."""
    places = base.where("src is not null").select("ident", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    return places.join(often.select("key"), "key").select(F.col("ident").alias(ident), (F.col("pos") + 1).cast("int").alias("line_no"))


def places_counted(base: DataFrame, often: DataFrame) -> DataFrame:
    """Of every ident with a line whose key is in often: ident and places, the positions (from 0) of those lines with their number of clusters."""
    at = base.where("src is not null").select("ident", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    found = at.join(often.select("key", F.col("c").cast("int").alias("c")), "key")
    return found.groupBy("ident").agg(F.collect_list(F.struct("pos", "c")).alias("places"))


def repeated_lines(df: DataFrame, ident: str, source: str, text: str, min_documents: int = 5, min_clusters: int = 1, date: str | None = None, min_dates: int = 1) -> DataFrame:
    """Lines that occur in at least ``min_documents`` documents of their source: columns ident, line_no (from 1, blank lines counted).

    Documents with the same text in one source are collapsed first; a line is then counted over those clusters, each with its number
    of distinct idents.  ``min_clusters`` and ``min_dates`` (over the days of column ``date``, a cluster's first one counting) ask for
    that many distinct clusters and days, so that a republished article is no boilerplate.  Lines are equal in the form of
    line_form, trimmed.  Blank lines, null texts and rows with a null source or ident never count; repeated rows count once.  An
    empty table gives no rows.

    Text is read once; what is shuffled are 12-byte keys.  Counts are pre-aggregated before the shuffle, so a line that stands on a
    third of all pages is no hot spot there; the join that finds its places is split by adaptive execution where one key is hot.
    """
    base, clusters = collapsed(df, ident, source, text, date)
    lines = lone_lines(base, clusters)
    if min_dates > 1:
        lines = lines.groupBy("key", "first_day").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
        counts = lines.groupBy("key").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.count("first_day").alias("d")).where(F.col("d") >= min_dates)
    else:
        counts = key_counts(lines)
    return places_of(base, counts.where((F.col("n") >= min_documents) & (F.col("c") >= min_clusters)), ident)


def without_lines(df: DataFrame, ident: str, text: str, lines: DataFrame) -> DataFrame:
    """df with the lines (ident, line_no) cut from its text; texts without such lines, null ones too, stay as they are."""
    gone = lines.groupBy(ident).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("__gone", i + 1))
    return df.join(gone, ident, "left").withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__gone")
