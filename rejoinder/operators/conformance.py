"""Output-format conformance of model outputs: one report row per model plus an 'all' row.

All per-model metrics are conditional aggregates in a single ``rollup('model')``
(grouping sets ((model), ())), so the table is scanned once for the whole report.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.constants import (COL_COUNTER_SPEECH, COL_COUNTER_SPEECH_CORRECTED, COL_OUTPUT,
                                 COL_STRATEGY_CORRECTED, OUTPUT_SEPARATOR, REAL_STRATEGY_COLS, STRATEGY_COLS,
                                 TOP_K, TRIM_CHARS)
from rejoinder.functions.normalize import empty_to_null, sign
from rejoinder.functions.text import strip_ws, trim_chars

ALL = "all"
R = 6


def load_outputs(df: DataFrame) -> DataFrame:
    """Trim ``' "'`` from the four text columns; empty strategy flags -> null."""
    cols = {c: trim_chars(c, TRIM_CHARS) for c in
            [COL_COUNTER_SPEECH, COL_COUNTER_SPEECH_CORRECTED, COL_STRATEGY_CORRECTED, COL_OUTPUT] if c in df.columns}
    cols.update({c: empty_to_null(F.col(c).cast("string")).cast("int") for c in STRATEGY_COLS if c in df.columns})
    return df.withColumns(cols)


def _pct(num, den):
    return F.round(F.try_divide(F.lit(100.0) * num, den.cast("double")), R)


def _label(model_col: str = "model"):
    """Model name, or 'all' on the grand-total row (``_g`` = grouping(model) computed in the aggregate)."""
    return F.when(F.col("_g") == 1, F.lit(ALL)).otherwise(F.col(model_col)).alias(model_col)


def schema_report(df: DataFrame, *, separator: str = OUTPUT_SEPARATOR) -> DataFrame:
    out = load_outputs(df)
    cs, csc = F.col(COL_COUNTER_SPEECH), F.col(COL_COUNTER_SPEECH_CORRECTED)
    strat = F.col(COL_STRATEGY_CORRECTED)
    filt = strat.isNotNull() & (F.length(strat) > 0)       # trimmed of ' "' at load
    diff = F.coalesce(F.length(cs), F.lit(0)) - F.coalesce(F.length(csc), F.lit(0))
    complete = None
    for c in STRATEGY_COLS:
        complete = F.col(c).isNotNull() if complete is None else complete & F.col(c).isNotNull()
    agree = None
    for s, r in zip(STRATEGY_COLS, REAL_STRATEGY_COLS):
        e = F.col(s).cast("double") == sign(r)
        agree = e if agree is None else agree & e
    g = out.rollup("model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        _pct(F.count_if(F.coalesce(F.length(strip_ws(strat)) > 0, F.lit(False))), F.count(F.lit(1)))
        .alias("strategies_specified_pct"),
        _pct(F.count_if(F.coalesce(F.col(COL_OUTPUT).contains(separator), F.lit(False))), F.count(F.lit(1)))
        .alias("separator_present_pct"),
        F.bround(F.avg(F.length(cs)), 2).alias("mean_raw_counterspeech_length"),
        F.bround(F.avg(F.length(csc)), 2).alias("mean_counterspeech_length"),
        F.bround(F.avg(F.when(filt, diff)), 2).alias("mean_diff_counter_speech_length"),
        F.bround(F.stddev_samp(F.when(filt, diff)), 2).alias("std_diff_counter_speech_length"),
        _pct(F.count_if(filt & (F.coalesce(cs, F.lit("")) == F.coalesce(csc, F.lit("")))), F.count_if(filt))
        .alias("counterspeech_correctly_separated_pct"),
        _pct(F.count_if(F.col("step_2") == 1), F.count("step_2")).alias("step_2_specified_pct"),
        _pct(F.count_if(complete & agree), F.count_if(complete)).alias("strategies_applied_pct"),
        F.grouping("model").alias("_g"),
    )
    return g.select(
        _label(), "n_rows", "strategies_specified_pct", "separator_present_pct",
        "mean_raw_counterspeech_length", "mean_counterspeech_length", "mean_diff_counter_speech_length",
        "std_diff_counter_speech_length", "counterspeech_correctly_separated_pct", "step_2_specified_pct",
        "strategies_applied_pct",
        F.round(F.try_divide(F.lit(100.0) * F.col("mean_counterspeech_length"),
                             F.col("mean_raw_counterspeech_length")), R).alias("corrected_vs_reported_length"))


def strategy_counts(df: DataFrame) -> DataFrame:
    """Per model (and 'all') and strategy flag: applied / not applied / unknown counts, applied share."""
    out = load_outputs(df)
    aggs = []
    for c in STRATEGY_COLS:
        aggs += [F.count_if(F.col(c) == 1).alias(f"{c}__a"), F.count_if(F.col(c) == -1).alias(f"{c}__n"),
                 F.count_if(F.col(c).isNull()).alias(f"{c}__u")]
    g = out.rollup("model").agg(*aggs, F.grouping("model").alias("_g")) \
        .select(_label(), *[f"{c}__{k}" for c in STRATEGY_COLS for k in "anu"])
    stack = ", ".join(f"'{c}', `{c}__a`, `{c}__n`, `{c}__u`" for c in STRATEGY_COLS)
    long = g.select("model", F.expr(f"stack({len(STRATEGY_COLS)}, {stack}) AS (strategy, applied, not_applied, unknown)"))
    return long.withColumn("applied_rel_pct",
                           F.bround(F.try_divide(F.lit(100.0) * F.col("applied"),
                                                 (F.col("applied") + F.col("not_applied")).cast("double")), 2))


def top_strategy_combos(df: DataFrame, *, k: int = TOP_K) -> DataFrame:
    """Most frequent 4-flag combinations (rows with any null flag dropped), per model and 'all'."""
    from pyspark.sql import Window
    out = load_outputs(df).na.drop(subset=STRATEGY_COLS)
    combo = F.concat_ws(",", *[F.col(c).cast("string") for c in STRATEGY_COLS]).alias("combination")
    counts = (out.select("model", combo)
              .groupingSets([["model", "combination"], ["combination"]], "model", "combination")
              .agg(F.count(F.lit(1)).alias("cnt"), F.grouping("model").alias("_gm")))
    counts = counts.select(F.when(F.col("_gm") == 1, F.lit(ALL)).otherwise(F.col("model")).alias("model"),
                           "combination", "cnt")
    w = Window.partitionBy("model").orderBy(F.col("cnt").desc(), F.col("combination").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("model", "rank", "combination", "cnt")


def strategy_agreement_rows(df: DataFrame) -> DataFrame:
    """Per row with complete flags: the 4 model flags and the 4 annotated signs, and whether they agree."""
    out = load_outputs(df).na.drop(subset=STRATEGY_COLS)
    cols = [F.col(s).cast("double").alias(s) for s in STRATEGY_COLS] + \
           [sign(r).alias(f"{r}_sign") for r in REAL_STRATEGY_COLS]
    agree = None
    for s, r in zip(STRATEGY_COLS, REAL_STRATEGY_COLS):
        e = F.col(s).cast("double") == sign(r)
        agree = e if agree is None else agree & e
    return out.select("row_id", "model", *cols, agree.alias("agrees"))


def notnull_share(df: DataFrame, cols: Sequence[str], *, group_cols: Sequence[str] = ()) -> DataFrame:
    """Non-null count and percentage per column, long form (column, n_notnull, n_rows, pct_notnull)."""
    g = list(group_cols)
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(F.col(c)).alias(f"{c}__nn") for c in cols]
    a = (df.groupBy(*g) if g else df.groupBy()).agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__nn`" for c in cols)
    long = a.select(*g, "_n", F.expr(f"stack({len(cols)}, {stack}) AS (column, n_notnull)"))
    return long.select(*g, "column", "n_notnull", F.col("_n").alias("n_rows"),
                       F.round(F.try_divide(F.lit(100.0) * F.col("n_notnull"), F.col("_n").cast("double")), R)
                       .alias("pct_notnull"))
