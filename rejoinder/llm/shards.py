"""Deterministic key-range shards, and file access inside tasks.

The range of an integer key is cut into cells of a power of two of keys; bytes are summed by cell
(one aggregate; its rows reach the driver).  Cells that hold more than a shard and more than one key are cut finer, all together in
a further aggregate over their rows alone, until each fits or holds one key.  Neighbouring cells form shards of
about the wanted size.  An outlying key costs a few such rounds, never a shard of everything else.  The same input
gives the same shards whatever the partitioning.  Null keys belong to shard 0.  Keys may span the whole 64-bit range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rejoinder.llm.common import cut

#: Bound on the cells of a round (so on the rows that reach the driver); shards are at most twice as many.
GRID = 1 << 16


def _cells(rows: DataFrame, shift: int) -> list[tuple[int, int, bool]]:
    """(cell, bytes, whether it holds several keys) of rows (k, bytes)."""
    held = rows.groupBy(F.shiftright("k", shift).alias("cell")).agg(F.sum("bytes").alias("bytes"), (F.min("k") < F.max("k")).alias("several"))
    return [(r["cell"], r["bytes"] or 0, r["several"]) for r in held.collect()]


def plan(df: DataFrame, key: str, size: Column, target: int) -> tuple[Callable[[DataFrame], DataFrame], int]:
    """(function that adds the column ``shard`` to any table with ``key``, number of shards)."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("k"), size.alias("bytes")).where("k is not null")
    lo, hi, total = rows.agg(F.min("k"), F.max("k"), F.sum("bytes")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    target = max(target, -(-(total or 0) // GRID))
    shift = 0
    while (hi >> shift) - (lo >> shift) >= GRID:
        shift += 1
    leaves, levels, full = [], [], None                 # (first key, bytes, level, cell) of the cells that are not cut finer
    while True:
        if full:
            if len(levels) == 1:
                rows = cut(rows, "key-sizes")           # further rounds do not touch the table
            marks = spark.createDataFrame([(c,) for c in sorted(full)], "cell long")                  # at most GRID
            rows = rows.join(F.broadcast(marks), F.shiftright("k", levels[-1]) == F.col("cell"), "left_semi")
            shift = max(0, levels[-1] - max(1, 16 - len(full).bit_length()))
        found = _cells(rows, shift)
        full = {c for c, b, several in found if b > target and several}
        leaves += [(c << shift, b, len(levels), c) for c, b, _ in found if c not in full]
        levels.append(shift)
        if not full:
            break
    shard, filled, of = 0, 0, [[] for _ in levels]
    for _, b, level, cell in sorted(leaves):
        if filled and filled + b > target:
            shard, filled = shard + 1, 0
        filled += b
        of[level].append((cell, shard))
    tables = [(s, spark.createDataFrame(own, f"__cell{i} long, __shard{i} int")) for i, (s, own) in enumerate(zip(levels, of, strict=True))]

    def add(other: DataFrame) -> DataFrame:
        names = other.columns
        for i, (s, cells) in enumerate(tables):
            other = other.join(F.broadcast(cells), F.shiftright(F.col(key).cast("long"), s) == F.col(f"__cell{i}"), "left")
        own = F.coalesce(*[F.col(f"__shard{i}") for i in range(len(tables))], F.lit(0))
        return other.select(*names, own.alias("shard"))

    return add, shard + 1


def by_key_range(df: DataFrame, key: str, size: Column, target: int, *ties: Column) -> DataFrame:
    """``df`` with the shard of each row, one partition for each shard, sorted by key (then ``ties``) inside it."""
    add, n = plan(df, key, size, target)
    return add(df).repartitionById(n, F.col("shard")).sortWithinPartitions(key, *ties)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder's URI (file, hdfs, s3, gs, abfss); made if missing."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    return system, path
