"""Emoji, hashtag and URL extraction per corpus group (row-local regex, then one aggregate)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.functions.text import emojis, hashtags, urls


def _stats(corpus: DataFrame, g: list[str], extractor, name: str) -> DataFrame:
    """Items are extracted and exploded once; counts by (group, item) give all three numbers."""
    x = corpus.select(*g, F.posexplode_outer(extractor("text")).alias("pos", "item"))
    by_item = x.groupBy(*g, "item").agg(F.count("item").alias("cnt"), F.count_if(F.col("pos") == 0).alias("firsts"))
    return by_item.groupBy(*g).agg(F.sum("firsts").alias(f"texts_with_{name}"), F.sum("cnt").alias(f"n_{name}"),
                                   F.count("item").alias(f"n_distinct_{name}"))


def emoji_stats(corpus: DataFrame, *, group_cols: Sequence[str] = ("theme", "model")) -> DataFrame:
    """Texts with an emoji, emoji count and distinct emojis (flags count as two code points)."""
    return _stats(corpus, list(group_cols), emojis, "emojis")


def hashtag_stats(corpus: DataFrame, *, group_cols: Sequence[str] = ("theme", "model")) -> DataFrame:
    return _stats(corpus, list(group_cols), hashtags, "hashtags")


def url_stats(corpus: DataFrame, *, group_cols: Sequence[str] = ("theme", "model")) -> DataFrame:
    return _stats(corpus, list(group_cols), urls, "urls")


def item_bag(corpus: DataFrame, extractor, *, group_cols: Sequence[str] = ("theme", "model")) -> DataFrame:
    """Every extracted item with its multiplicity per group (the list with repetitions, as counts)."""
    g = list(group_cols)
    return (corpus.select(*g, F.explode(extractor("text")).alias("item"))
            .groupBy(*g, "item").agg(F.count(F.lit(1)).alias("cnt")))
