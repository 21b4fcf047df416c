"""User-defined functions: nulls give null without a call, batches go through Arrow, types are checked beforehand."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that functions may take and give.
ALLOWED = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.ArrayType)


class UnsupportedType(TypeError):
    """A type that functions can't take or give."""


def checked(spark: SparkSession, kind: str | T.DataType) -> T.DataType:
    parsed = kind if isinstance(kind, T.DataType) else T._parse_datatype_string(kind)
    if not isinstance(parsed, ALLOWED):
        raise UnsupportedType(f"functions can't give {parsed.simpleString()}")
    return parsed


def _arity(fn: Callable) -> int:
    return len(inspect.signature(fn).parameters)


def register(spark: SparkSession, name: str, kind: str, fn: Callable) -> Callable:
    """A scalar function of one to three arguments; where any argument is null the result is null, without a call."""
    result, n = checked(spark, kind), _arity(fn)
    if not 1 <= n <= 3:
        raise UnsupportedType("functions have one to three arguments")

    def safe(*args: Any) -> Any:
        return None if any(a is None for a in args) else fn(*args)

    made = F.udf(safe, result, useArrow=True)
    return spark.udf.register(name, made)


def register_nullable(spark: SparkSession, name: str, kind: str, fn: Callable) -> Callable:
    """A function that is called with nulls too."""
    return spark.udf.register(name, F.udf(fn, checked(spark, kind), useArrow=True))


def register_vectorised(spark: SparkSession, name: str, kind: str, fn: Callable[..., pd.Series]) -> Callable:
    """A function of whole series of numbers, for arithmetic without a call per row; null arguments give null."""
    result, n = checked(spark, kind), _arity(fn)

    if n == 1:

        def one(a: pd.Series) -> pd.Series:
            return fn(a).where(a.notna())

        made = F.pandas_udf(one, result)
    else:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return fn(a, b).where(a.notna() & b.notna())

        made = F.pandas_udf(two, result)
    return spark.udf.register(name, made)


def once_per_value(df: DataFrame, column: str, kind: str, fn: Callable, name: str) -> DataFrame:
    """``df`` with ``name``: the function's result, called once for each distinct value.

    The values are made distinct and the results joined back null-safe, so a costly function pays off on columns of few
    values. Declared as not deterministic, it isn't moved below the step that makes values distinct."""
    result = checked(df.sparkSession, kind)
    call = F.udf(lambda v: None if v is None else fn(v), result, useArrow=True).asNondeterministic()
    values = df.select(F.col(column).alias("_value")).distinct().withColumn(name, call(F.col("_value")))
    return df.join(values, df[column].eqNullSafe(values["_value"]), "left").drop("_value")


def table_function(spark: SparkSession, name: str, schema: str, fn: Callable[..., Iterator[tuple]]) -> None:
    """A function that gives rows, for use in FROM."""

    class Rows:
        def eval(self, *args: Any) -> Iterator[tuple]:
            yield from fn(*args)

    spark.udtf.register(name, F.udtf(Rows, returnType=schema))


def column(expression: str) -> Column:
    return F.expr(expression)
