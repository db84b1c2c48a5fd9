"""Crawl rounds as a stream: state by key, upserted per micro-batch, and windowed fetch counts with a watermark."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.crawldb import newest


def latest_state(df: DataFrame, key: str, *by: str) -> DataFrame:
    """Of each key the row with the largest ``by``; the same for a batch and for one micro-batch with the state before it."""
    return newest(df, key, *by)


def state_of(spark: SparkSession, folder: str, schema) -> DataFrame | None:
    """The latest complete state under ``folder``, or None.  Versions are values of the partition column ``version``; the marks of complete ones lie beside them."""
    try:
        last = spark.read.schema("version long").json(f"{folder}/complete").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    return None if last is None else spark.read.schema(schema).parquet(f"{folder}/state/version={last}")


def upsert_to(folder: str, key: str, *by: str):
    """A foreachBatch function that keeps the latest state under ``folder``: each batch writes a version of its own, then marks it complete; a batch that is repeated writes its version again from the one before."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.schema("version long").json(f"{folder}/complete").where(F.col("version") < number).agg(F.max("version")).first()[0]
        except AnalysisException:
            done = None
        old = None if done is None else spark.read.schema(batch.schema).parquet(f"{folder}/state/version={done}")
        state = latest_state(old.unionByName(batch) if old is not None else batch, key, *by)
        state.write.mode("overwrite").parquet(f"{folder}/state/version={number}")
        spark.range(1).select(F.lit(number).cast("long").alias("version")).coalesce(1).write.mode("overwrite").json(f"{folder}/complete/batch={number}")

    return write


def fetch_counts(stream: DataFrame, time: str, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Records by window of time and status; rows later than ``late`` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "status_code").agg(F.count("*").alias("records"))
