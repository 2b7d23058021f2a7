"""Dtype names, Spark types and the record casts between them."""

from __future__ import annotations

import datetime as dt
import decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dtype name to Spark type.
BY_NAME: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "str": T.StringType(),
    "object": T.StringType(),
    "date": T.DateType(),
    "datetime64": T.TimestampNTZType(),
    "timedelta64": T.DayTimeIntervalType(),
    "bytes": T.BinaryType(),
}
_ALIASES = {"int": "int64", "float": "float64", "string": "str", "boolean": "bool", "datetime": "datetime64", "timestamp": "datetime64", "double": "float64", "decimal": "float64", "timedelta": "timedelta64"}
_PYTHON = {int: "int64", float: "float64", bool: "bool", str: "str", dt.datetime: "datetime64", dt.date: "date", dt.timedelta: "timedelta64", decimal.Decimal: "float64", bytes: "bytes", object: "object"}


def dtype_name(dtype: object) -> str:
    """The name of a NumPy dtype, Python type, Spark type or name; bit widths of strings and units of times are dropped.

    Raises TypeError for what is no dtype.
    """
    if isinstance(dtype, T.DataType):
        return name_of(dtype)
    if isinstance(dtype, type) and dtype in _PYTHON:
        return _PYTHON[dtype]
    if isinstance(dtype, str):
        plain = dtype.split("[")[0].replace("_", "").lower()
        plain = _ALIASES.get(plain, plain)
        if plain in BY_NAME:
            return plain
    try:
        found = np.dtype(dtype)
    except TypeError:
        raise TypeError(f"`{dtype}` is not a dtype") from None
    if found.kind in "US":
        return "str" if found.kind == "U" else "bytes"
    name = found.name.split("[")[0]
    return "object" if name not in BY_NAME else name


def reduced_name(dtype: object) -> str:
    """The dtype's name without its bit width."""
    return dtype_name(dtype).rstrip("0123456789")


def spark_type(dtype: object) -> T.DataType:
    return dtype if isinstance(dtype, T.DataType) else BY_NAME[dtype_name(dtype)]


def name_of(kind: T.DataType) -> str:
    """The dtype name of a Spark type; nested types keep Spark's name."""
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return "datetime64"
    if isinstance(kind, T.DecimalType):
        return "float64" if kind.scale else "int64"
    if isinstance(kind, T.StringType | T.NullType):
        return "str"
    for name, known in BY_NAME.items():
        if type(known) is type(kind) and not name.startswith("u"):
            return name
    return kind.simpleString()


def cast_to(column: Column, source: T.DataType, target: object) -> Column:
    """``column`` as ``target``; blank strings become null, other strings that don't fit raise when they are read."""
    kind = spark_type(target)
    if isinstance(source, T.StringType) and not isinstance(kind, T.StringType | T.BinaryType):
        trimmed = F.trim(column)
        return F.when(trimmed != "", trimmed).cast(kind)
    return column.cast(kind)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def missing_as_null(column: Column, kind: T.DataType) -> Column:
    return F.nanvl(column, F.lit(None).cast(kind)) if is_float(kind) else column


def as_record(column: Column, kind: T.DataType, cast_null: bool = True) -> Column:
    """A cell as records have it: times as ISO text, and NaN as null if ``cast_null``."""
    if isinstance(kind, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(F.date_format(column, "SSSSSS") == "000000", whole).otherwise(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return missing_as_null(column, kind) if cast_null else column
