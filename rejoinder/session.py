"""Spark session defaults and the shared folder."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job wants regardless of cluster size.  Shuffle partitions are
# left to the cluster (or the caller) except in local mode.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "rejoinder", shuffle_partitions: int | None = None,
                scan_partitions: int | None = None) -> SparkSession:
    """Return the active session or build one with the defaults above.  ``scan_partitions``: see ``sources.tables``."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if scan_partitions:
        b = b.config("spark.rejoinder.scan.partitions", str(scan_partitions))
    if memory := os.environ.get("REJOINDER_DRIVER_MEMORY"):
        b = b.config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session (one process, as in tests) gets a
    folder of its own; on a cluster this raises, because executors and driver do not
    share local folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder all executors share")
        d = _own_folder()
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # noqa: BLE001  (no SparkContext, e.g. a Spark Connect session)
        pass
    return d


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """On leaving, what ``cut`` wrote within is deleted; results have to be written or collected by then."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: With it, a query's shuffle files go when the query has ended, not when the driver's garbage happens to be collected.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back: later stages reread the files if an executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (paths := _scratch.get()) is not None:
        paths.append(path)
    spark.conf.set(_RELEASE, "true")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="rejoinder-ckpt-")
