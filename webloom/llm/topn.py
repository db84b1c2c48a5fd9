"""Top N items of every group by one global range-partitioned sort."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: Column, score: Column, ident: Column, n: int, names: tuple[str, str, str, str] = ("group", "place", "ident", "score")) -> DataFrame:
    """The n best idents of every group: columns group, place (1 is best), ident, score, named by ``names``.

    An ident counts once per group, with its highest score; equal scores rank by ident ascending (byte order).  Rows whose
    group, ident or score is null, or whose score is NaN, don't count.  An empty table gives no rows.

    Rows are range-partitioned on (group, score, ident), so a group of any size spreads over as many partitions as it needs.
    Each sorted partition yields, per group, its row count and its first n rows; a group's counts, prefix-summed over
    the partitions, turn local into exact positions.  That last step sees at most one row per group and partition.
    """
    g, i, s = "__g", "__i", "__s"
    best = df.select(group.alias(g), ident.alias(i), score.cast("double").alias(s)).where(F.col(g).isNotNull() & F.col(i).isNotNull() & F.col(s).isNotNull() & ~F.isnan(s))
    best = best.groupBy(g, i).agg((F.max(s) + F.lit(0.0)).alias(s))
    by = [F.col(g).asc(), F.col(s).desc(), F.col(i).asc()]
    ordered = best.repartitionByRange(*by).sortWithinPartitions(*by)
    idtype, gtype = ordered.schema[i].dataType.simpleString(), ordered.schema[g].dataType.simpleString()

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        open_group, count, items = None, 0, []
        for b in batches:
            if b.empty:
                continue
            out = []
            starts = [0, *((b[g].values[1:] != b[g].values[:-1]).nonzero()[0] + 1).tolist(), len(b)]
            for lo, hi in zip(starts, starts[1:]):
                name = b[g].iat[lo]
                if name != open_group:
                    if count:
                        out.append((open_group, part, count, items))
                    open_group, count, items = name, 0, []
                if count < n:
                    part_of = b.iloc[lo : min(hi, lo + n - count)]
                    items = items + [{"i": a, "s": c} for a, c in zip(part_of[i].tolist(), part_of[s].tolist())]
                count += hi - lo
            if out:
                yield pd.DataFrame(out, columns=["g", "part", "cnt", "items"])
        if count:
            yield pd.DataFrame([(open_group, part, count, items)], columns=["g", "part", "cnt", "items"])

    local = ordered.mapInPandas(heads, f"g {gtype}, part int, cnt long, items array<struct<i:{idtype},s:double>>")
    before = F.coalesce(F.sum("cnt").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = local.withColumn("before", before).where(F.col("before") < n)
    rows = placed.select("g", "before", F.posexplode("items").alias("pos", "item")).withColumn("place", (F.col("before") + F.col("pos") + 1).cast("int"))
    return rows.where(F.col("place") <= n).select(F.col("g").alias(names[0]), F.col("place").alias(names[1]), F.col("item.i").alias(names[2]), F.col("item.s").alias(names[3]))
