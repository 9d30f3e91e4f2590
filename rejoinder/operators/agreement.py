"""Krippendorff's alpha (nominal / ordinal) for any number of raters, from a long table.

Input ``(category, unit, rater, value)`` with missing values null.  Values are
pairable when their unit has at least two.  With n_uc the count of value c in unit
u, m_u its values, n_c and n their totals, the disagreements have closed forms that
need no pairs of values:

* nominal: observed sum_uc n_uc (m_u - n_uc) / (m_u - 1), expected n^2 - sum_c n_c^2
* ordinal: the distance of two values is the difference of r_c = (n_g summed up to c) - n_c / 2,
  so observed 2 sum_u (m_u sum_c n_uc r_c^2 - (sum_c n_uc r_c)^2) / (m_u - 1) and
  expected 2 (n sum_c n_c r_c^2 - (sum_c n_c r_c)^2)

    alpha = 1 - (n - 1) * observed / expected

Categories whose value domain has fewer than two values are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rejoinder.operators.ranges import running_totals

R = 6


def alpha(long: DataFrame, *, level: str = "nominal", category: str = "category", unit: str = "unit",
          value: str = "value", missing: str = "ignore") -> DataFrame:
    """(category, alpha, n_values, values): ``values`` lists the distinct values of the category as text, in order of the text,
    commas between.  ``missing='ignore'`` drops missing values (default); ``missing='category'`` scores a missing
    nominal value as the explicit category 'nan' (parity with string-cast rating matrices)."""
    if level not in ("nominal", "ordinal"):
        raise ValueError(f"Unknown level of measurement {level}")
    if missing not in ("ignore", "category"):
        raise ValueError(f"Unknown missing-value rule {missing}")
    if missing == "category":
        if level != "nominal":
            raise ValueError("missing='category' applies to nominal data only")
        long = long.withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("nan")))
    own = F.col(value).cast("double") if level == "ordinal" else F.col(value)
    v = long.select(category, unit, own.alias("v")).where(F.col("v").isNotNull())
    # distinct first: a list holds a value domain, never ratings
    domain = v.select(category, "v").distinct().groupBy(category).agg(
        F.count("v").alias("n_values"), F.array_join(F.array_sort(F.collect_set(F.col("v").cast("string"))), ",").alias("values"))
    nuc = (v.groupBy(category, unit, "v").agg(F.count(F.lit(1)).alias("n_uc"))
           .withColumn("m_u", F.sum("n_uc").over(Window.partitionBy(category, unit))).where(F.col("m_u") >= 2))   # values of one unit
    nc = nuc.groupBy(category, "v").agg(F.sum("n_uc").alias("n_c"))
    if level == "nominal":
        observed = nuc.groupBy(category).agg(
            F.sum(F.col("n_uc") * (F.col("m_u") - F.col("n_uc")) / (F.col("m_u") - 1)).alias("do"))
        expected = nc.groupBy(category).agg(F.sum("n_c").alias("n"), F.sum(F.col("n_c") * F.col("n_c")).alias("sq")) \
            .select(category, "n", (F.col("n") * F.col("n") - F.col("sq")).alias("de"))
    else:
        nc = running_totals(nc, by=[category], order="v", weight="n_c").withColumn("r", F.col("upto") - F.col("n_c") / 2.0)
        by_unit = nuc.join(nc.select(category, "v", "r"), [category, "v"]).groupBy(category, unit, "m_u").agg(
            F.sum(F.col("n_uc") * F.col("r")).alias("s1"), F.sum(F.col("n_uc") * F.col("r") * F.col("r")).alias("s2"))
        observed = by_unit.groupBy(category).agg(
            F.sum(2 * (F.col("m_u") * F.col("s2") - F.col("s1") * F.col("s1")) / (F.col("m_u") - 1)).alias("do"))
        expected = nc.groupBy(category).agg(
            F.sum("n_c").alias("n"), F.sum(F.col("n_c") * F.col("r")).alias("s1"),
            F.sum(F.col("n_c") * F.col("r") * F.col("r")).alias("s2")) \
            .select(category, "n", (2 * (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1"))).alias("de"))
    res = observed.join(expected, category).select(
        category, (1 - (F.col("n") - 1) * F.try_divide(F.col("do"), F.col("de"))).alias("alpha"))
    return (domain.where(F.col("n_values") >= 2).join(res, category, "left")
            .select(category, F.round("alpha", R).alias("alpha"), "n_values", "values"))


def value_domain(long: DataFrame, *, category: str = "category", value: str = "value") -> DataFrame:
    """(category, value, cnt): the values of each category, one a row."""
    return long.where(F.col(value).isNotNull()).groupBy(category, value).agg(F.count(F.lit(1)).alias("cnt"))
