"""Operators on fetched content and index documents: signatures, segments, index actions and fields, relevance."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.url import host_of
from webloom.operators.crawldb import newest

MOST_LABELS = 1000


def md5_signature(text: Column, url: Column) -> Column:
    """MD5 of the text, of the URL where there is none."""
    return F.md5(F.when(F.coalesce(F.length(text), F.lit(0)) > 0, text).otherwise(url))


def profile_signature(text: Column, rate: float = 0.01, shortest: int = 2) -> Column:
    """MD5 of the text's word profile: words of more than ``shortest`` letters with their numbers, rounded down to a step and sorted.

    The step is ``rate`` of the largest number, but at least 2 (1 if no word recurs); words under the step are left out.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " "), lambda w: F.length(w) > shortest)
    got = F.sort_array(words)

    def counted(ws: Column) -> Column:
        # where each word begins among the sorted ones; its number is the distance to the next
        begin = F.filter(F.transform(ws, lambda w, i: F.when((i == 0) | (F.get(ws, i - 1) != w), i)), lambda i: i.isNotNull())
        runs = lambda at: F.transform(at, lambda i, k: F.struct((F.coalesce(F.get(at, k + 1), F.size(ws)) - i).alias("n"), F.get(ws, i).alias("w")))
        return F.get(F.transform(F.array(begin), runs), F.lit(0))

    def profile(c: Column) -> Column:
        most = F.coalesce(F.array_max(F.transform(c, lambda x: x["n"])), F.lit(0))
        step = F.greatest(F.round(most * rate).cast("int"), F.when(most > 1, 2).otherwise(1))
        kept = F.filter(F.transform(c, lambda x: F.struct((-F.floor(x["n"] / step) * step).cast("int").alias("n"), x["w"].alias("w"))), lambda x: -x["n"] >= step)
        return F.md5(F.array_join(F.transform(F.sort_array(kept), lambda x: F.concat_ws(" ", x["w"], (-x["n"]).cast("string"))), "\n"))

    return F.get(F.transform(F.transform(F.array(got), counted), profile), F.lit(0))


def newest_segment(df: DataFrame, key: str = "url", segment: str = "segment", tie: str = "page_id") -> DataFrame:
    """Segments merged: of each key the row of the last segment (by name), of several there the one with the largest ``tie``."""
    return newest(df, key, segment, tie)


def slices(df: DataFrame, size: int, order: str) -> DataFrame:
    """Rows numbered in order and cut into slices of ``size`` (column slice, from 0), by prefix sums over range partitions and not in one task."""
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id())
    from webloom.plans.workspace import staged

    d = staged(ranged, "ranged").withColumn("__part", F.shiftright("__id", 33))
    from pyspark.sql import Window

    per = d.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("__part", "__first", before.alias("__before"))
    return d.join(F.broadcast(per), "__part").withColumn("slice", F.floor((F.col("__before") + F.col("__id") - F.col("__first")) / size)).drop("__part", "__id", "__first", "__before")


def index_action(status: Column, parse: Column, delete: bool = True, skip_unmodified: bool = False) -> Column:
    """What the indexer does with a page: ADD, DELETE, or null for nothing; the first rule that fits decides."""
    off = F.lit("DELETE") if delete else F.lit(None).cast("string")
    out = F.when(parse.startswith("failed"), off).when(status.isin(3), off).when(status.isin(4, 5), off).when(status == 7, off)
    if skip_unmodified:
        out = out.when(status == 6, F.lit(None).cast("string"))
    return out.when(status.isin(2, 6), "ADD")


def basic_fields(df: DataFrame, most_content: int | None = None, most_title: int = 100) -> DataFrame:
    """id, url, host, title (cut), content (cut), tstamp, digest, boost of index documents."""
    c = F.coalesce("content", F.lit(""))
    return df.select(F.col("url").alias("id"), "url", host_of(F.col("url")).alias("host"), F.substring(F.coalesce("title", F.lit("")), 1, most_title).alias("title"), (F.substring(c, 1, most_content) if most_content else c).alias("content"), "tstamp", "digest", "boost")


def mime_fields(content_type: Column) -> Column:
    """type, primary and sub type of a content type without its parameters."""
    t = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    return F.struct(t.alias("type"), F.substring_index(t, "/", 1).alias("primary"), F.substring_index(t, "/", -1).alias("sub"))


def words(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, word, n): word numbers per row."""
    w = F.explode(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " ")).alias("word")
    return df.where(F.col(text).isNotNull()).select(ident, w).where("word <> ''").groupBy(ident, "word").agg(F.count("*").alias("n"))


def naive_bayes(train: DataFrame, test: DataFrame, ident: str, text: str, label: str) -> DataFrame:
    """Most probable label of each test row by a word model with add-one smoothing: columns ident, label, log_score.  Rows without words get none."""
    tw = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(label, F.explode(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "), " ")).alias("word")).where("word <> ''")
    counts = tw.groupBy(label, "word").agg(F.count("*").alias("c"))
    size = counts.select("word").distinct().count()
    docs = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("docs"))
    classes = docs.join(counts.groupBy(label).agg(F.sum("c").alias("total")), label, "left").limit(MOST_LABELS + 1).collect()
    if len(classes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    n = sum(r["docs"] for r in classes)
    if not n:
        return test.select(ident).limit(0).withColumn(label, F.lit(None).cast("string")).withColumn("log_score", F.lit(None).cast("double"))
    start = F.array(*[F.struct(F.lit(r[label]).alias(label), F.lit(math.log(r["docs"] / n)).alias("p"), F.lit(math.log((r["total"] or 0) + size)).alias("base")) for r in classes])
    seen = words(test, ident, text)
    lengths = seen.groupBy(ident).agg(F.sum("n").alias("len")).select(ident, "len", F.inline(start))
    # a word the label never had adds log(0 + 1) = 0, so only words in common are joined
    hits = seen.join(counts, "word").groupBy(ident, label).agg(F.sum(F.col("n") * F.log(F.col("c") + 1.0)).alias("s"))
    scored = lengths.join(hits, [ident, label], "left").select(ident, label, (F.coalesce("s", F.lit(0.0)) - F.col("len") * F.col("base") + F.col("p")).alias("log_score"))
    return scored.groupBy(ident).agg(F.max_by(F.struct(label, "log_score"), F.struct("log_score")).alias("b")).select(ident, "b.*")


def cosine(df: DataFrame, gold: str, ident: str, text: str) -> DataFrame:
    """Cosine of each row's word numbers with those of the ``gold`` text: columns ident, similarity.  Null texts and texts without words have no row."""
    own = Counter(re.findall(r"[^\W_]+", gold.lower()))
    norm = math.sqrt(sum(n * n for n in own.values())) or 1.0
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), "word"), F.lit(0)) if own else F.lit(0)
    got = words(df, ident, text).groupBy(ident).agg(F.sum(F.col("n") * weight).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("dn"))
    return got.select(ident, (F.col("dot") / (F.col("dn") * norm)).alias("similarity"))


def accepted_types(content_type: Column, prefixes: list[str], accept: bool = True) -> Column:
    """Whether a document's type (without parameters) begins with one of the prefixes; with ``accept`` off, whether it begins with none.  A null type passes only then."""
    t = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    hit = F.coalesce(F.array_contains(F.transform(F.array(*[F.lit(p.lower()) for p in prefixes]), lambda p: F.startswith(t, p)), True), F.lit(False)) if prefixes else F.lit(False)
    return hit if accept else ~hit


def truncated(content: Column, declared: Column) -> Column:
    """Whether fewer bytes are there than the header declares; a missing or senseless header tells nothing (false)."""
    return F.coalesce(F.octet_length(content) < declared.try_cast("long"), F.lit(False))
