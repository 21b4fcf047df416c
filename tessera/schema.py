"""Short forms of schemas that need no running session."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "date": T.DateType(),
}


def columns(**kinds: str) -> T.StructType:
    """``columns(id="long", name="string")``"""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in kinds.items()])
