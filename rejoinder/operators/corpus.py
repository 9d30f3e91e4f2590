"""Corpus construction: responses per group key, plus the seeded ``random`` pseudo-model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.constants import RANDOM_MODEL, SEED, TRIM_CHARS
from rejoinder.functions.text import trim_chars


def seeded_key(id_col: str = "row_id", seed: int = SEED):
    """Deterministic pseudo-random order key: md5('<seed>:<id>') — identical in DuckDB."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def extract_corpus(df: DataFrame, *, text_col: str = "response", model=None, theme=None,
                   trim: bool = True) -> DataFrame:
    """Equality filters on model / theme (a falsy value means no filter), trim ``' "'``, drop null text."""
    out = df
    if theme:
        out = out.where(F.col("theme") == F.lit(theme))
    if model:
        out = out.where(F.col("model") == F.lit(model))
    if trim:
        out = out.withColumn(text_col, trim_chars(text_col, TRIM_CHARS))
    return out.where(F.col(text_col).isNotNull())


def random_corpus(df: DataFrame, *, by: Sequence[str] = (), text_col: str = "response",
                  seed: int = SEED, message_col: str = "message_id") -> DataFrame:
    """One seeded random response per message (within ``by`` keys, e.g. theme).

    ``min_by`` over an md5 key is a partial aggregate: no group is ever
    collected, so a message with very many responses costs nothing extra.
    """
    keys = [*by, message_col]
    picked = (df.where(F.col(message_col).isNotNull())
              .groupBy(*keys)
              .agg(F.min_by(F.struct("row_id", text_col), seeded_key("row_id", seed)).alias("p")))
    return picked.select(*by, F.col(message_col), F.lit(RANDOM_MODEL).alias("model"),
                         F.col("p.row_id").alias("row_id"), F.col(f"p.{text_col}").alias(text_col))


def corpora(df: DataFrame, *, group_cols: Sequence[str] = ("theme", "model"), text_col: str = "response",
            with_random: bool = True, seed: int = SEED) -> DataFrame:
    """Long corpus table ``(*group_cols, row_id, text)``.

    Text is trimmed of ``' "'``.  Null texts and rows with a null group key are
    dropped for every branch, including the random one: a key selects by equality.
    """
    group_cols = list(group_cols)
    base = extract_corpus(df, text_col=text_col).dropna(subset=group_cols)
    out = base.select(*group_cols, "row_id", F.col(text_col).alias("text"))
    if with_random:
        by = [c for c in group_cols if c != "model"]
        rnd = random_corpus(base, by=by, text_col=text_col, seed=seed)
        out = out.unionByName(rnd.select(*group_cols, "row_id", F.col(text_col).alias("text")))
    return out
