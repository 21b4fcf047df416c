"""Order: nulls last by default, declared orders of values, row numbers without a single task."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def ascending(*columns: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def descending(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def declared(column: str, values: list[Any]) -> list[Column]:
    """Sort keys: named values in their given order, then all others by text, nulls last."""
    place = F.when(F.col(column).isNull(), len(values) + 1)
    for i, v in enumerate(values):
        place = place.when(F.col(column) == F.lit(v), i)
    return [place.otherwise(len(values)).asc(), F.col(column).cast("string").asc_nulls_last()]


def numbered(df: DataFrame, order: list[Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0, without sorting everything in one task.

    Rows are range-partitioned by the order; a partition's rows are counted, and numbers start after the rows of the
    partitions before. Ties are told apart arbitrarily unless the order is total.

    Ranges come from a sample that each run draws anew, so the partitioned rows are written to the checkpoint folder:
    counts and numbers then speak of the same partitions, whatever is run again.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = cut(ranged.withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))  # one row per partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_row", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_part", "_row", "_start")
