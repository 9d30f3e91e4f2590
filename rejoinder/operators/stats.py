"""Descriptive statistics over long score tables ``(category, subject, model, score)``.

Wide inputs are unpivoted once; every statistic of every column then comes from the counts of its
values (``ranges``), with no per-column passes and no buffer that holds a group's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.operators.ranges import order_statistics

R = 6


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], *, var: str = "category",
            val: str = "score") -> DataFrame:
    return df.unpivot(list(ids), list(cols), var, val)


def describe_scores(long: DataFrame, *, group_cols: Sequence[str] = ("category", "model"),
                    value_col: str = "score") -> DataFrame:
    """mean, median, sample std, min, max, non-null count (nulls skipped)."""
    g = list(group_cols)
    x = order_statistics(long, group_cols=g, value_col=value_col, shares=[0.5])
    return x.select(*g, F.round("mean", R).alias("mean"), F.round(F.col("q")[0], R).alias("median"),
                    F.round("std", R).alias("std"), "min", "max", "count")


def mean_median(long: DataFrame, *, group_cols: Sequence[str] = ("category", "model"),
                value_col: str = "score") -> DataFrame:
    return describe_scores(long, group_cols=group_cols, value_col=value_col).select(*group_cols, "mean", "median")


def value_counts(long: DataFrame, *, group_cols: Sequence[str] = ("model", "column"),
                 value_col: str = "value") -> DataFrame:
    """Counts per group and value; missing values dropped."""
    g = list(group_cols)
    return long.where(F.col(value_col).isNotNull()).groupBy(*g, value_col).agg(F.count(F.lit(1)).alias("cnt"))


def pivot_scores(long: DataFrame, models: Sequence[str], *, index: Sequence[str] = ("category", "subject"), model_col: str = "model",
                 value_col: str = "score") -> DataFrame:
    """Long -> wide with a fixed model list (no extra pass to discover values).

    A model that stands twice under one index raises an error, as a pivot has one cell for it.
    """
    own = {m: F.col(model_col) == F.lit(m) for m in models}
    cells = [F.when(F.count_if(is_m) > 1, F.raise_error(F.lit(f"pivot: {m} stands more than once under one index")))
             .otherwise(F.max(F.when(is_m, F.col(value_col)))).alias(m) for m, is_m in own.items()]
    return long.groupBy(*index).agg(*cells)


def describe_columns(long: DataFrame, *, group_cols: Sequence[str] = ("pair",), value_col: str = "value"
                     ) -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation), max — like a describe() per column."""
    g = list(group_cols)
    x = order_statistics(long, group_cols=g, value_col=value_col, shares=[0.25, 0.5, 0.75])
    return x.select(*g, "count", *[F.round(F.col(c), R).alias(c) for c in ["mean", "std", "min"]],
                    *[F.round(F.col("q")[i], R).alias(c) for i, c in enumerate(["p25", "p50", "p75"])], F.round("max", R).alias("max"))
