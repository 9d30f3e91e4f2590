"""Prefix sums and order statistics over ordered values, without a window or buffer that holds a group.

Rows are dealt to partitions by ranges of (group, value).  A partition adds up its own stretch of a group,
the stretches' totals are summed over partitions (a handful of rows a group), and both together give every
row its cumulative weight.  So one group of any size is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.operators.grams import group_hash
from rejoinder.session import cut


def running_totals(df: DataFrame, *, by: Sequence[str], order: str, weight: str, out: str = "upto") -> DataFrame:
    """``df`` with the sum of ``weight`` over all rows of its ``by`` group up to its ``order`` value (which is unique in the group).

    The dealt rows are written once: which partition holds a row must not change between its two uses.
    """
    dealt = df.repartitionByRange(*by, order).withColumns({"__part": F.spark_partition_id(), "__key": group_hash(by)})
    dealt = cut(dealt, "ranges")
    parts = dealt.groupBy("__key", "__part").agg(F.sum(weight).alias("__total"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)   # a row a partition
    parts = parts.select("__key", "__part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__before"))
    own = Window.partitionBy("__key", "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dealt.withColumn("__own", F.sum(weight).over(own)).join(parts, ["__key", "__part"])
                 .withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__key", "__own", "__before"))


def order_statistics(df: DataFrame, *, group_cols: Sequence[str], value_col: str, shares: Sequence[float]) -> DataFrame:
    """(*g, count, mean, std, min, max, q: array) per group: moments, and the exact quantiles at ``shares`` (linear interpolation).

    Equal values are one row with their count.  Nulls are skipped; a group of nulls only has count 0 and nulls.
    """
    g = list(group_cols)
    counts = df.groupBy(*g, F.col(value_col).alias("__v")).agg(F.count(value_col).alias("__c"))
    held = running_totals(counts, by=g, order="__v", weight="__c", out="__upto").withColumn("__g", group_hash(g))
    v, c, n = F.col("__v"), F.col("__c"), F.col("__n")
    whole = held.groupBy("__g").agg(F.sum(c).alias("__n"), F.try_divide(F.sum(v * c).cast("double"), F.sum(c)).alias("__mean"))
    held = held.join(whole, "__g")

    def at(rank):
        return F.max(F.when((F.col("__upto") - c <= rank) & (rank < F.col("__upto")), v))

    places = [(n - 1) * s for s in shares]
    out = held.groupBy(*g).agg(
        F.max(n).alias("count"), F.max("__mean").alias("mean"),
        F.sqrt(F.try_divide(F.sum(c * (v - F.col("__mean")) * (v - F.col("__mean"))), F.max(n) - 1)).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.array(*[F.struct(at(F.floor(h)).cast("double").alias("a"), at(F.ceil(h)).cast("double").alias("b"),
                           F.max(h - F.floor(h)).alias("f")) for h in places]).alias("__q"))
    return out.withColumn("q", F.transform("__q", lambda x: x["a"] + (x["b"] - x["a"]) * x["f"])).drop("__q")
