"""Schemas declared by position."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def filler(i: int) -> str:
    """The name of a column that is not declared."""
    return f"__unspecified_{i}__"


def schema(fields: Mapping[str, Mapping], width: int | None = None) -> T.StructType:
    """A schema from {name: {"type", "index"}}; places in between, and up to width, are strings with names of their own.

    Raises ValueError for an unknown type, an index given twice or missing, and a width below the last index.
    """
    by: dict[int, T.StructField] = {}
    for name, field in fields.items():
        if "type" not in field or "index" not in field:
            raise ValueError(f"column {name} needs a type and an index")
        kind, index = str(field["type"]).lower(), int(field["index"])
        if kind not in TYPES:
            raise ValueError(f"column {name} has the unknown type {kind}")
        if index in by or index < 0:
            raise ValueError(f"column {name} has the index {index}, which is not free")
        by[index] = T.StructField(name, TYPES[kind])
    count = max(by, default=-1) + 1
    if width is not None:
        if width < count:
            raise ValueError(f"a row of {width} has no column {count - 1}")
        count = width
    return T.StructType([by.get(i) or T.StructField(filler(i), T.StringType()) for i in range(count)])
