"""Connected components of links held in tables (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.common import cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star (``both``): a node's larger neighbours go to its smallest; small star: its smaller ones do."""
    near = edges.union(edges.select("b", "a")) if both else edges
    least = near.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = near.join(least, "a")
    if both:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b) that is not the smallest of its component.

    Each round rewrites the links towards the smallest node and is written to the
    shared folder; it ends when a round changes nothing.  Nothing is collected but
    the number and the checksum of the links.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before, edges = mark, cut(_star(_star(edges, True), False), "links")
