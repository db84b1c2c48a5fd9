"""Positions and exact quantiles within groups of any size, by range partitions and prefix sums: no group is bound to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.plans.workspace import staged


def positions(df: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """df with each row's position (from 0) within its group in the given order; nulls come first and null groups are a group; equal rows have positions of their own.

    Rows are sorted over range partitions and stored with running numbers; a group's rows per partition, prefix-summed, turn those into
    positions.  That last step sees one row per group and partition.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("__id", F.monotonically_increasing_id())
    rows = staged(ranged, "ranged").withColumn("__part", F.shiftright("__id", 33))
    per = rows.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__group").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("__group", "__p", "__first", before.alias("__before"))
    joined = rows.join(per, rows[group].eqNullSafe(per["__group"]) & (rows["__part"] == per["__p"]))
    return joined.withColumn(name, F.col("__before") + F.col("__id") - F.col("__first")).select(*df.columns, name)


def exact_quantiles(df: DataFrame, group: str, value: str, points: list[float]) -> DataFrame:
    """Columns group, quantile and value: the quantiles at ``points`` (0 to 1) of each group's values, between two values in proportion.  Nulls and NaN don't count; an empty table gives no rows."""
    d = df.select(group, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    at = F.col("quantile") * (F.col("__n") - 1)
    wanted = d.groupBy(group).agg(F.count("*").alias("__n")).select(F.col(group).alias("__g"), "__n", F.explode(F.array(*[F.lit(float(p)) for p in points if 0 <= p <= 1])).alias("quantile"))
    wanted = wanted.select("__g", "quantile", at.alias("__at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("__k"))
    placed = positions(d, group, ["__v"], "__k")
    near = placed.join(wanted, placed[group].eqNullSafe(wanted["__g"]) & (placed["__k"] == wanted["__k"])).select(placed[group], "quantile", "__v", "__at", placed["__k"])
    ends = near.groupBy(group, "quantile").agg(F.min_by("__v", "__k").alias("a"), F.max_by("__v", "__k").alias("b"), F.min("__at").alias("__at"))
    return ends.select(group, "quantile", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("__at") - F.floor("__at"))).alias(value))
