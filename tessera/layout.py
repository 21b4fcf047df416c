"""How Python objects lie in columns: a schema from a dataclass, rows from objects and objects from rows."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import enum
import types
import typing
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LayoutError(TypeError):
    """A type that has no column."""


SCALARS: dict[type, T.DataType] = {
    str: T.StringType(),
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    decimal.Decimal: T.DecimalType(38, 10),
    uuid.UUID: T.StringType(),
    bytes: T.BinaryType(),
    dt.date: T.DateType(),
    dt.datetime: T.TimestampNTZType(),
    dt.time: T.StringType(),
}


@dataclass(frozen=True)
class Vector:
    """Marks an annotated list of numbers as a vector of a fixed length: ``Annotated[list[float], Vector(64)]``."""

    size: int


@dataclass(frozen=True)
class Info:
    """Description and unit of a column: ``Annotated[float, Info("price", "EUR")]``."""

    description: str = ""
    unit: str = ""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: T.DataType
    kind: Any
    description: str = ""
    unit: str = ""
    vector: int | None = None

    def field(self) -> T.StructField:
        notes = {k: v for k, v in (("description", self.description), ("unit", self.unit), ("vector", self.vector)) if v}
        return T.StructField(self.name, self.type, True, notes)


def _plain(kind: Any) -> tuple[Any, list[Any]]:
    """A type without Optional and Annotated, and its annotations."""
    notes: list[Any] = []
    if typing.get_origin(kind) is typing.Annotated:
        notes, kind = list(kind.__metadata__), typing.get_args(kind)[0]
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(kind) if a is not type(None)]
        if len(rest) != 1:
            raise LayoutError(f"no column for {kind}")
        kind, more = _plain(rest[0])
        notes += more
    return kind, notes


def _scalar(kind: Any) -> T.DataType:
    kind, _ = _plain(kind)
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return T.IntegerType()
    if kind not in SCALARS:
        raise LayoutError(f"no column for {kind}")
    return SCALARS[kind]


def data_type(kind: Any) -> T.DataType:
    """The column type of an annotation. Lists, maps and dataclasses hold scalars, one level deep."""
    kind, _ = _plain(kind)
    origin = typing.get_origin(kind)
    if origin is list:
        return T.ArrayType(_scalar(typing.get_args(kind)[0]))
    if origin is dict:
        k, v = typing.get_args(kind)
        return T.MapType(_scalar(k), _scalar(v))
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind, include_extras=True)
        return T.StructType([T.StructField(f.name, _scalar(hints[f.name])) for f in dataclasses.fields(kind)])
    return _scalar(kind)


def _store(value: Any, kind: Any) -> Any:
    if value is None:
        return None
    kind, _ = _plain(kind)
    if isinstance(value, enum.Enum):
        return list(type(value)).index(value)
    if isinstance(value, uuid.UUID):
        return str(value)
    if isinstance(value, dt.time):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return value.quantize(decimal.Decimal("1e-10"), rounding=decimal.ROUND_HALF_UP)
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    args = typing.get_args(kind)
    if isinstance(value, (list, tuple)) and args:
        return [_store(v, args[0]) for v in value]
    if isinstance(value, dict) and args:
        return {_store(k, args[0]): _store(v, args[1]) for k, v in value.items()}
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind, include_extras=True)
        return tuple(_store(getattr(value, f.name), hints[f.name]) for f in dataclasses.fields(kind))
    return value


def _load(value: Any, kind: Any) -> Any:
    if value is None:
        return None
    kind, _ = _plain(kind)
    if isinstance(kind, type) and issubclass(kind, enum.Enum):
        return list(kind)[value]
    if kind is uuid.UUID:
        return uuid.UUID(value)
    if kind is dt.time:
        return dt.time.fromisoformat(value)
    args = typing.get_args(kind)
    if isinstance(value, list) and args:
        return [_load(v, args[0]) for v in value]
    if isinstance(value, dict) and args:
        return {_load(k, args[0]): _load(v, args[1]) for k, v in value.items()}
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind, include_extras=True)
        return kind(**{f.name: _load(value[f.name], hints[f.name]) for f in dataclasses.fields(kind)})
    return value


class Layout:
    """The columns of a dataclass, in order; the first is the key."""

    def __init__(self, cls: type, columns: list[ColumnDef]):
        self.cls, self.columns = cls, columns

    @classmethod
    def of(cls, kind: type) -> Layout:
        if not dataclasses.is_dataclass(kind):
            raise LayoutError(f"{kind} is no dataclass")
        hints = typing.get_type_hints(kind, include_extras=True)
        columns = []
        for f in dataclasses.fields(kind):
            plain, notes = _plain(hints[f.name])
            info = next((n for n in notes if isinstance(n, Info)), Info())
            vector = next((n.size for n in notes if isinstance(n, Vector)), None)
            columns.append(ColumnDef(f.name, data_type(plain), plain, info.description, info.unit, vector))
        return cls(kind, columns)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([c.field() for c in self.columns])

    @property
    def key(self) -> str:
        return self.columns[0].name

    def row(self, item: Any) -> tuple:
        out = []
        for c in self.columns:
            value = _store(getattr(item, c.name), c.kind)
            if c.vector is not None and value is not None and len(value) != c.vector:
                raise LayoutError(f"{c.name} has {c.vector} dimensions, the value has {len(value)}")
            out.append(value)
        return tuple(out)

    def item(self, row: Row) -> Any:
        return self.cls(**{c.name: _load(row[c.name], c.kind) for c in self.columns})

    def df(self, spark: SparkSession, items: Iterable[Any]) -> DataFrame:
        return spark.createDataFrame([self.row(i) for i in items], self.schema)

    def items(self, df: DataFrame) -> list[Any]:
        return [self.item(r) for r in df.select(*[c.name for c in self.columns]).collect()]

    def check_vectors(self, df: DataFrame) -> DataFrame:
        """``df``, which fails when read where a vector has another length than its column."""
        for c in self.columns:
            if c.vector is not None:
                wrong = F.size(c.name) != c.vector
                df = df.withColumn(c.name, F.when(wrong, F.raise_error(F.concat(F.lit(f"{c.name} has {c.vector} dimensions, the value has "), F.size(c.name).cast("string")))).otherwise(F.col(c.name)))
        return df


def described(df: DataFrame, column: str, description: str = "", unit: str = "") -> DataFrame:
    """``df`` whose column carries a description and a unit; they go with it into Parquet files."""
    notes = df.schema[column].metadata | {k: v for k, v in (("description", description), ("unit", unit)) if v}
    return df.withMetadata(column, notes)
