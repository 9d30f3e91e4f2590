"""Driver tables (one Parquet file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


#: Where a session sets this, scans are dealt out to so many partitions.
SCAN_PARTITIONS = "spark.rejoinder.scan.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan over as many partitions as ``SCAN_PARTITIONS`` says; unset, the scan stays as it is.

    For small files only: one written as a single row group is a single input split, so everything
    fused into the scan stage would run in one task.  Large tables have splits enough and need no such
    setting.  Column pruning and filters still reach the Parquet reader below the exchange.
    """
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spread(spark.read.parquet(table_path(sf_dir, name)))
