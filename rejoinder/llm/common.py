"""Helpers shared by the operators: table scans, shared folders, worker-side state."""

from __future__ import annotations

import functools
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but space and the five ASCII control spaces.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan of one driver table, pruned to ``columns``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="rejoinder-shared-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder ``spark.checkpoint.dir`` names.

    The cluster sets it to storage that every executor and the driver reach.
    Where it is unset, a local session (one process, as in tests) gets a folder
    of its own; on a cluster the operator refuses to guess.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes that a writer of intermediate files gathers before it writes them out.
ROW_GROUP = 16 << 20

#: The list that takes note of what ``cut`` writes, where someone asks for it.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Within it, ``cut`` adds the paths it writes to ``paths``."""
    token = _noted.set(paths)
    try:
        yield
    finally:
        _noted.reset(token)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete what ``cut`` wrote at ``paths``, once nothing reads it any more; empties the list."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later stages reread the files if an executor is lost.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if (paths := _noted.get()) is not None:
        paths.append(path)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions.  Named in a repartition, it keeps large ones from being merged for a sort."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def settled(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of ``df`` that meet ``condition``, tested after its columns are made.

    Spark moves an ordinary filter below the projections and writes the columns'
    definitions out in it, once per use; array columns that are indexed inside
    lambdas would then be made anew for every element.  A filter is not moved
    below a column that counts rows.
    """
    return df.withColumn("__at", F.monotonically_increasing_id()).where((F.col("__at") >= 0) & condition).drop("__at")


def worker_state(key: str, make: Callable[[], Any]) -> Any:
    """One object per Python worker process, kept between tasks (a cache or a loaded model)."""
    store = sys.modules.setdefault("_rejoinder_worker_state", types.ModuleType("_rejoinder_worker_state"))
    if not hasattr(store, key):
        setattr(store, key, make())
    return getattr(store, key)


def words(text: Column) -> Column:
    """Words of a text as an array; none for a null or blank text."""
    gap = F.lit(WORD_GAP)
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(rf"^{WORD_GAP}|{WORD_GAP}\z"), F.lit(""))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
