"""Shaping: projections, renames, model-output union, tagged-output parsing,
overlay merge of annotation files, and the guards around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.constants import COL_COUNTER_SPEECH, COL_STRATEGY
from rejoinder.functions.normalize import parse_tagged, split_compound


class GuardError(ValueError):
    """A data guard failed (overlapping keys, lost rows, incomplete split)."""


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; names not present are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present)


def rename_first_containing(df: DataFrame, needle: str, new: str) -> DataFrame:
    hits = [c for c in df.columns if needle in c]
    if not hits:
        raise GuardError(f"no column contains {needle!r}")
    return df.withColumnRenamed(hits[0], new)


def union_models(frames: Mapping[str, DataFrame], *, needle: str = "counter_speech",
                 out_col: str = "model_output") -> DataFrame:
    """Union per-model output tables by name: tag each with its model, rename its output column."""
    out = None
    for model, df in frames.items():
        t = rename_first_containing(df, needle, out_col).withColumn("model", F.lit(model))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise GuardError("no frames to union")
    return out


def parse_tagged_output(df: DataFrame, *, col: str = "model_output") -> DataFrame:
    cs, rest = parse_tagged(col)
    return df.withColumns({COL_COUNTER_SPEECH: cs, COL_STRATEGY: rest})


def add_empty_columns(df: DataFrame, cols: Sequence[str], dtype: str = "string") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(dtype) for c in cols})


def split_compound_label(df: DataFrame, col: str, *, default: str = "0-0") -> DataFrame:
    m, r = split_compound(col, default)
    return df.withColumns({f"{col}_message": m, f"{col}_response": r})


def overlay_merge(base: DataFrame, overlays: Sequence[DataFrame], *, key: str = "row_id") -> DataFrame:
    """Left-merge ``overlays`` onto ``base`` by ``key``; later overlays win where non-null.

    One pass instead of k joins: overlays are unioned with a priority, every
    column keeps the value of the highest-priority non-null row per key
    (``max_by`` is a partial aggregate, so no key is ever gathered whole), then
    a single left join onto the base.  Columns only in overlays are added.
    """
    if not overlays:
        return base
    cols: list[str] = []
    for o in overlays:
        for c in o.columns:
            if c != key and c not in cols:
                cols.append(c)
    tagged = None
    for prio, o in enumerate(overlays):
        t = o.select(key, *[F.col(c) if c in o.columns else F.lit(None).alias(c) for c in cols]) \
             .withColumn("_prio", F.lit(prio))
        tagged = t if tagged is None else tagged.unionByName(t, allowMissingColumns=True)
    best = tagged.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_prio"))).alias(f"_ov_{c}") for c in cols])
    j = base.join(best, key, "left")
    out = []
    for c in base.columns:
        if c in cols:
            out.append(F.coalesce(F.col(f"_ov_{c}"), base[c]).alias(c))
        else:
            out.append(base[c])
    for c in cols:
        if c not in base.columns:
            out.append(F.col(f"_ov_{c}").alias(c))
    return j.select(*out)


def overlapping_keys(a: DataFrame, b: DataFrame, *, key: str = "row_id") -> DataFrame:
    """Keys present in both tables (a semi join); empty means disjoint."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def check_disjoint(a: DataFrame, b: DataFrame, *, key: str = "row_id") -> None:
    if not overlapping_keys(a, b, key=key).isEmpty():
        raise GuardError(f"values in {key!r} overlap between the two tables")


def coverage(whole: DataFrame, parts: Sequence[DataFrame], *, key: str = "row_id") -> DataFrame:
    """One row: total keys, keys covered by the union of parts, keys in no part, extra keys."""
    u = None
    for p in parts:
        k = p.select(key)
        u = k if u is None else u.unionByName(k)
    w = whole.select(key).distinct().withColumn("_w", F.lit(1))
    c = u.distinct().withColumn("_p", F.lit(1))
    j = w.join(c, key, "full")
    return j.agg(F.count_if(F.col("_w").isNotNull()).alias("n_total"),
                 F.count_if(F.col("_w").isNotNull() & F.col("_p").isNotNull()).alias("n_covered"),
                 F.count_if(F.col("_p").isNull()).alias("n_missing"),
                 F.count_if(F.col("_w").isNull()).alias("n_extra"))


def check_coverage(whole: DataFrame, parts: Sequence[DataFrame], *, key: str = "row_id") -> None:
    r = coverage(whole, parts, key=key).first()
    if r["n_missing"] or r["n_extra"]:
        raise GuardError(f"split does not cover the table: {r.asDict()}")
