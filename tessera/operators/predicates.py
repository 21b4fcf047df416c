"""A small predicate language over the columns of a collection.

A predicate compiles to one boolean ``Column``; predicates about other collections (``ExistsIn``) become existence flags
that a semi-join shape adds first. ``select`` returns the rows that match, each once.

A row whose attribute is null matches no comparison, so ``Not`` includes it: negation is "all rows but the matches".
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def column(self, df: DataFrame) -> Column:
        raise NotImplementedError


class _Attribute(Predicate):
    """A test of one attribute. On an array column a row matches if any element does."""

    attribute: str

    def test(self, value: Column) -> Column:
        raise NotImplementedError

    def column(self, df: DataFrame) -> Column:
        if isinstance(df.schema[self.attribute].dataType, T.ArrayType):
            return F.exists(self.attribute, self.test)
        return self.test(F.col(self.attribute))  # null where the attribute is: a filter drops it, ``Not`` resolves it


@dataclass(frozen=True)
class Equal(_Attribute):
    attribute: str
    value: Any

    def test(self, value: Column) -> Column:
        return value == F.lit(self.value)


@dataclass(frozen=True)
class In(_Attribute):
    """No value at all matches nothing."""

    attribute: str
    values: tuple

    def test(self, value: Column) -> Column:
        return value.isin(*self.values) if self.values else F.lit(False)


@dataclass(frozen=True)
class LessThan(_Attribute):
    attribute: str
    value: Any
    inclusive: bool = False

    def test(self, value: Column) -> Column:
        return value <= F.lit(self.value) if self.inclusive else value < F.lit(self.value)


@dataclass(frozen=True)
class GreaterThan(_Attribute):
    attribute: str
    value: Any
    inclusive: bool = False

    def test(self, value: Column) -> Column:
        return value >= F.lit(self.value) if self.inclusive else value > F.lit(self.value)


@dataclass(frozen=True)
class Between(_Attribute):
    attribute: str
    low: Any
    high: Any
    low_inclusive: bool = True
    high_inclusive: bool = True

    def test(self, value: Column) -> Column:
        low = value >= F.lit(self.low) if self.low_inclusive else value > F.lit(self.low)
        return low & (value <= F.lit(self.high) if self.high_inclusive else value < F.lit(self.high))


@dataclass(frozen=True)
class StartsWith(_Attribute):
    attribute: str
    prefix: str

    def test(self, value: Column) -> Column:
        return value.startswith(self.prefix)


@dataclass(frozen=True)
class EndsWith(_Attribute):
    attribute: str
    suffix: str

    def test(self, value: Column) -> Column:
        return value.endswith(self.suffix)


@dataclass(frozen=True)
class Contains(_Attribute):
    attribute: str
    part: str

    def test(self, value: Column) -> Column:
        return value.contains(self.part)


@dataclass(frozen=True)
class Matches(_Attribute):
    attribute: str
    pattern: str

    def test(self, value: Column) -> Column:
        return value.rlike(self.pattern)


@dataclass(frozen=True)
class Has(Predicate):
    """The attribute is not null; an array has an element."""

    attribute: str

    def column(self, df: DataFrame) -> Column:
        value = F.col(self.attribute)
        if isinstance(df.schema[self.attribute].dataType, T.ArrayType):
            return F.coalesce(F.size(value) > 0, F.lit(False))
        return value.isNotNull()


class And(Predicate):
    def __init__(self, *parts: Predicate):
        self.parts = parts

    def column(self, df: DataFrame) -> Column:
        return reduce(Column.__and__, (p.column(df) for p in self.parts), F.lit(True))


class Or(Predicate):
    def __init__(self, *parts: Predicate):
        self.parts = parts

    def column(self, df: DataFrame) -> Column:
        return reduce(Column.__or__, (p.column(df) for p in self.parts), F.lit(False))


class Not(Predicate):
    def __init__(self, part: Predicate):
        self.parts = (part,)

    def column(self, df: DataFrame) -> Column:
        return ~F.coalesce(self.parts[0].column(df), F.lit(False))


class All(Predicate):
    def column(self, df: DataFrame) -> Column:
        return F.lit(True)


class Nothing(Predicate):
    def column(self, df: DataFrame) -> Column:
        return F.lit(False)


class Filter(Predicate):
    """Any Python test of one attribute, for what no other predicate can say. Null values don't match."""

    def __init__(self, attribute: str, test: Callable[[Any], bool]):
        self.attribute, self.python = attribute, test

    def column(self, df: DataFrame) -> Column:
        python = self.python
        test = F.udf(lambda v: v is not None and bool(python(v)), "boolean", useArrow=True)
        return test(F.col(self.attribute))


class ExistsIn(Predicate):
    """Some row of ``foreign`` (that matches ``where``) has ``foreign_attribute`` equal to the row's ``attribute``."""

    def __init__(self, foreign: DataFrame, attribute: str, foreign_attribute: str, where: Predicate | None = None):
        self.foreign, self.attribute, self.foreign_attribute, self.where = foreign, attribute, foreign_attribute, where
        self.flag = f"_exists_{id(self)}"

    def keys(self) -> DataFrame:
        rows = select(self.foreign, self.where) if self.where else self.foreign
        found = rows.select(F.col(self.foreign_attribute).alias("_foreign_key"))
        if isinstance(rows.schema[self.foreign_attribute].dataType, T.ArrayType):
            found = found.select(F.explode("_foreign_key").alias("_foreign_key"))
        return found.dropna()

    def column(self, df: DataFrame) -> Column:
        return F.col(self.flag)


def _foreign(predicate: Predicate) -> Iterable[ExistsIn]:
    if isinstance(predicate, ExistsIn):
        yield predicate
    for part in getattr(predicate, "parts", ()):
        yield from _foreign(part)


def _top(predicate: Predicate) -> list[Predicate]:
    if isinstance(predicate, And):
        return [x for p in predicate.parts for x in _top(p)]
    return [predicate]


def _element_flag(df: DataFrame, foreign: ExistsIn, keys: DataFrame) -> DataFrame:
    """``df`` with the flag of an existence test on an array. Arrays are told apart by their elements: each distinct one
    is exploded once, its elements meet the keys in a plain equality join, and the arrays with a match come back."""
    elements = df.select(F.array_sort(F.array_distinct(foreign.attribute)).alias("_set")).distinct()
    met = elements.withColumn("_element", F.explode("_set")).join(keys, F.col("_element") == F.col("_foreign_key"), "left_semi")
    hit = met.select("_set").distinct().withColumn(foreign.flag, F.lit(True))
    marked = df.withColumn("_set_of_row", F.array_sort(F.array_distinct(foreign.attribute)))
    return marked.join(hit, marked["_set_of_row"] == hit["_set"], "left").drop("_set", "_set_of_row").withColumn(foreign.flag, F.coalesce(foreign.flag, F.lit(False)))


def select(df: DataFrame, predicate: Predicate) -> DataFrame:
    """The rows that match, with the columns of ``df``.

    Conjuncts that are (negated) existence tests become semi- and anti-joins, the shapes Spark plans best; those nested
    in ``Or`` or ``Not``, and those of array attributes, become flags from equality joins on distinct keys. Plain tests go
    first, to the scan.
    """
    columns = df.columns
    plain, rest = [], []
    for p in _top(predicate):
        (rest if any(True for _ in _foreign(p)) else plain).append(p)
    out = df
    for p in plain:
        out = out.filter(p.column(out))
    for p in rest:
        negated = isinstance(p, Not) and isinstance(p.parts[0], ExistsIn)
        test = p.parts[0] if negated else p
        if isinstance(test, ExistsIn):
            if not isinstance(out.schema[test.attribute].dataType, T.ArrayType):
                keys = test.keys()
                out = out.join(keys, out[test.attribute] == keys["_foreign_key"], "left_anti" if negated else "left_semi")
                continue
        for foreign in _foreign(p):
            keys = foreign.keys().distinct().withColumn(foreign.flag, F.lit(True))
            if isinstance(out.schema[foreign.attribute].dataType, T.ArrayType):
                out = _element_flag(out, foreign, keys)
                continue
            out = out.join(keys, out[foreign.attribute] == keys["_foreign_key"], "left").drop("_foreign_key").withColumn(foreign.flag, F.coalesce(foreign.flag, F.lit(False)))
        out = out.filter(p.column(out)).select(*columns)
    return out.select(*columns)


def key_statistics(df: DataFrame, attribute: str, low: Any = None, high: Any = None, descending: bool = False) -> DataFrame:
    """Rows per distinct value of an attribute, ordered by it, within optional inclusive bounds. Arrays count elements."""
    if isinstance(df.schema[attribute].dataType, T.ArrayType):
        df = df.select(F.explode(F.array_distinct(attribute)).alias(attribute))
    key = F.col(attribute)
    df = df.filter(key.isNotNull())
    if low is not None:
        df = df.filter(key >= F.lit(low))
    if high is not None:
        df = df.filter(key <= F.lit(high))
    return df.groupBy(attribute).agg(F.count("*").alias("n")).orderBy(key.desc() if descending else key.asc())
