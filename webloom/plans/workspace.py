"""Where intermediate tables live, and how lineage is cut.

Intermediate results go to the folder named by ``spark.checkpoint.dir``, which all executors share, so that a lost executor costs
a re-read and not the result.  Only where the session names none (tests, a laptop) is a temporary folder used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def _forget() -> None:
    for d in _own:
        shutil.rmtree(d, ignore_errors=True)


atexit.register(_forget)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; a local one is made only if the session sets none."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="webloom-"))
        d = _own[0]
    return d.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as compressed columns into the shared folder and return the table read back.

    Cheaper than ``checkpoint()``: columns not asked for later aren't read again, and the files are compressed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Bytes of a staged table's files, by the optimizer's statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
