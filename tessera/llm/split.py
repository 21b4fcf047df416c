"""Deterministic splits and bounded samples by document key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column, folds: int, fold: int = 2) -> Column:
    """True where crc32(key as text) mod ``folds`` is ``fold``. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def smallest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows whose keys' hashes are smallest: a sample that doesn't depend on how rows are dealt."""
    return df.orderBy(F.xxhash64(key, F.lit("sample")), *df.columns).limit(rows)


def sampled(rows: DataFrame, chosen: DataFrame, most: int) -> DataFrame:
    """The rows (``_text`` and the columns of ``chosen``, among them ``_key``) that ``chosen``, which is small, has; of
    rows that repeat all of these one, and ``most`` in all. ``_t`` is added, a hash of the text."""
    same = [c for c in chosen.columns]
    found = rows.join(F.broadcast(chosen), same).withColumn("_t", F.xxhash64("_text"))
    kept = smallest(found.select(*same, "_t").distinct(), "_key", most)
    kept = df_of(kept)
    return found.join(F.broadcast(kept), [*same, "_t"]).dropDuplicates([*same, "_t"])


def df_of(small: DataFrame) -> DataFrame:
    """A small table through the driver: what reads it doesn't compute it again."""
    return small.sparkSession.createDataFrame(small.toArrow(), small.schema)
