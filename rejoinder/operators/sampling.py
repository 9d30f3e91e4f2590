"""Seeded sampling and splitting with an md5 order key (same rows in any SQL engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.constants import SAMPLE_SIZE, SEED
from rejoinder.operators.corpus import seeded_key


def sample_n(df: DataFrame, n: int = SAMPLE_SIZE, *, seed: int = SEED, id_col: str = "row_id") -> DataFrame:
    """Fixed-size sample without replacement: the n smallest md5 keys (TakeOrdered, no full sort)."""
    return df.orderBy(seeded_key(id_col, seed), F.col(id_col)).limit(n)


def hash_half(id_col: str = "row_id", seed: int = SEED):
    """Predicate for the first half of a seeded 50/50 split (first hex digit of md5 < 8)."""
    return F.substring(seeded_key(id_col, seed), 1, 1) < F.lit("8")


def split_for_annotation(df: DataFrame, *, n_sample: int = SAMPLE_SIZE, seed: int = SEED,
                         id_col: str = "row_id") -> DataFrame:
    """Label every row 'sample', 'part_1' or 'part_2'.

    The sample is the n smallest keys, joined to the table as a list of at most
    ``n_sample`` ids; the rest is split in two by a hash threshold in the same projection, so
    both halves are made without a sort and are disjoint and covering by construction.
    """
    # at most n_sample rows: the bound of the broadcast
    s = F.broadcast(sample_n(df.select(id_col), n_sample, seed=seed, id_col=id_col).withColumn("_sampled", F.lit(True)))
    part = F.when(F.col("_sampled"), "sample").when(hash_half(id_col, seed), "part_1").otherwise("part_2")
    return df.join(s, id_col, "left").withColumn("part", part).drop("_sampled")


def _half_cutoff(keyed: DataFrame, frac: float) -> DataFrame:
    """One row (one, cutoff): the k-th smallest key ``_h`` of ``keyed`` with k = round(frac * n); null if k is 0.

    No global sort: counts by the key's first 4 hex digits (at most 65,536) locate the digits of the
    k-th key; only the keys with those (about n / 65,536) are ordered.
    """
    hist = keyed.groupBy(F.substring("_h", 1, 4).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    row = hist.agg(F.sort_array(F.collect_list(F.struct("b", "c"))).alias("h"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    row = row.withColumn("k", F.bround(F.col("n") * F.lit(frac)).cast("long"))     # halves to even
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("r"))

    def step(acc, x):
        here = acc["b"].isNull() & (acc["seen"] + x["c"] >= F.col("k")) & (F.col("k") > 0)
        return F.struct((acc["seen"] + x["c"]).alias("seen"), F.when(here, x["b"]).otherwise(acc["b"]).alias("b"),
                        F.when(here, F.col("k") - acc["seen"]).otherwise(acc["r"]).alias("r"))

    at = row.select(F.aggregate("h", start, step).alias("x")).select("x.b", "x.r")
    inside = keyed.join(F.broadcast(at), F.substring("_h", 1, 4) == F.col("b"))    # one row
    return inside.groupBy("r").agg(F.sort_array(F.collect_list("_h")).alias("own")).agg(
        F.max(F.get("own", (F.col("r") - 1).cast("int"))).alias("cutoff")).withColumn("one", F.lit(0))


def split_for_annotation_exact(df: DataFrame, *, n_sample: int = SAMPLE_SIZE, seed: int = SEED,
                               id_col: str = "row_id", frac: float = 0.5) -> DataFrame:
    """Like ``split_for_annotation`` but part_1 has exactly round(n_rest * frac) rows (md5 order).

    The cut-off key is a one-row table within the plan; nothing runs while the plan is built.
    """
    # at most n_sample rows: the bound of the broadcast
    s = F.broadcast(sample_n(df.select(id_col), n_sample, seed=seed, id_col=id_col).withColumn("_sampled", F.lit(True)))
    keyed = df.join(s, id_col, "left").withColumn("_h", seeded_key(id_col, seed))
    cutoff = _half_cutoff(keyed.where(F.col("_sampled").isNull()).select("_h"), frac)
    part = F.when(F.col("_sampled"), "sample").when(F.col("_h") <= F.col("cutoff"), "part_1").otherwise("part_2")
    return (keyed.withColumn("one", F.lit(0)).join(F.broadcast(cutoff), "one", "left")
                 .withColumn("part", part).drop("_sampled", "_h", "one", "cutoff"))
