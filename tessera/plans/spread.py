"""Dealing rows out to as many tasks as their bytes call for, so that what a task holds doesn't grow with the table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of files whose rows one task takes, about: some 300,000 rows of a narrow table. A sum per key keeps a few hundred
#: bytes for each, so several of them in one task stay in the low hundreds of MB.
TASK_BYTES = 4 << 20

#: A shuffle to more tasks than ``BARE`` keeps its rows in memory while it is written (``spark.shuffle.sort.bypassMergeThreshold``).
#: So tables that call for more tasks give each task more bytes first, up to ``MOST_BYTES``.
BARE, MOST_BYTES = 200, 32 << 20


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files and rows that a plan reads, as the planner knows them; RDDs of unknown size count by partitions."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        size = int(str(leaf.stats().sizeInBytes()))
        if size >= 1 << 60:
            size = leaf.rdd().getNumPartitions() * TASK_BYTES if leaf.nodeName() == "LogicalRDD" else 0
        total += size
    return total


def tasks_for(df: DataFrame) -> int:
    """How many tasks the rows of ``df`` call for."""
    size = bytes_read(df)
    n = max(1, -(-size // TASK_BYTES))
    return n if n <= BARE else max(BARE, -(-size // MOST_BYTES))


def spread(df: DataFrame, *columns: str, tasks: int | None = None) -> DataFrame:
    """``df`` dealt out by columns to ``tasks`` (else by its bytes), so that sums per key need no other shuffle.

    Where the session's number of shuffle partitions is enough, AQE may put small ones together. Rows that are dealt out
    by one of these columns already stay where they are."""
    n = tasks or tasks_for(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = re.fullmatch(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", df._jdf.queryExecution().sparkPlan().outputPartitioning().toString())
    if by and by[1] in columns and (int(by[2]) >= n or n <= least):
        return df
    return df.repartition(n, *columns) if n > least else df.repartition(*columns)


def without(df: DataFrame, gone: DataFrame, columns: list[str], same: str | None = None) -> DataFrame:
    """Rows of ``df`` whose columns, nulls alike, aren't among those of ``gone``; with ``same`` that number counts too.

    The columns join as one struct, which is never null: a null-safe join deals rows out by expressions of its own, to as
    many tasks as the session says and no more."""
    tasks = tasks_for(df)
    left = spread(df.withColumn("_k", F.struct(*columns)), "_k", tasks=tasks)
    right = spread(gone.select(F.struct(*columns).alias("_k"), *([F.col(same).alias("_same")] if same else [])), "_k", tasks=tasks)
    on = left["_k"] == right["_k"]
    if same:
        on &= (left[same] <= right["_same"]) & (left[same] >= right["_same"])  # no further key of the join
    return left.join(right, on, "left_anti").drop("_k")
