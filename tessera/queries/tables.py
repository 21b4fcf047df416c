"""The tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Its schema is read from a file's footer once per session and folder, not by every query."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


class Tables:
    """``Tables(spark, sf_dir).orders``"""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return table(self._spark, self._dir, name)


def sql(spark: SparkSession, sf_dir: str, text: str, **args) -> DataFrame:
    """A SQL text over the tables, named in braces: ``SELECT * FROM {orders}``."""
    used = {n: table(spark, sf_dir, n) for n in NAMES if "{" + n + "}" in text}
    return spark.sql(text, args=args or None, **used)
