"""Frames from data in the driver's memory: dicts, pairs, iterators, records, pandas."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatter import object_formatter
from ..plans.ordinals import RID
from ..types import cast_to, dtype_name, spark_type


def as_columns(data: object) -> dict[str, Any]:
    """A mapping, or a sequence, iterator or iterable of mappings and (name, values) pairs, as a new dict.

    Names that aren't strings become strings, and stand last. Raises TypeError for other input, ValueError for none.
    """
    if isinstance(data, Mapping):
        found = dict(data)
    elif isinstance(data, np.ndarray | str | bytes) or not isinstance(data, Iterable):
        raise TypeError(f"A frame can't be made from `{type(data).__name__}`.")
    else:
        found = {}
        for item in data:
            found.update(_pair(item))
    named = {k: v for k, v in found.items() if isinstance(k, str)}
    named |= {str(k): v for k, v in found.items() if not isinstance(k, str)}
    if not named:
        raise ValueError("No data was given.")
    return named


def _pair(item: object) -> dict[Any, Any]:
    if isinstance(item, Mapping):
        return dict(item)
    if isinstance(item, Sequence) and not isinstance(item, str) and len(item) == 2:
        name = item[0]
        if isinstance(name, np.ndarray):
            name = name.reshape(-1)[0].item() if name.size == 1 else name
        if isinstance(name, str | int | float | np.generic):
            return {name.item() if isinstance(name, np.generic) else name: item[1]}
    raise TypeError(f"`{item!r}` is not a mapping or a (name, values) pair.")


def as_array(values: object) -> np.ndarray:
    """Values as a one-dimensional array; a scalar has length 1; TypeError for more dimensions."""
    if isinstance(values, np.ndarray):
        out = values
    elif isinstance(values, str | bytes) or not isinstance(values, Iterable):
        out = np.array([values], dtype=object if not isinstance(values, bool | int | float | np.generic) else None)
    else:
        own = list(values)
        plain = all(isinstance(v, bool | int | float | np.generic) for v in own) and len({type(v) is bool for v in own}) < 2
        out = np.array(own) if plain and own else _objects(own)
    if out.ndim == 0:
        out = out.reshape(1)
    if out.ndim > 1:
        out = np.squeeze(out)
        out = out.reshape(1) if out.ndim == 0 else out
    if out.ndim != 1:
        raise TypeError("Columns must have one dimension.")
    return out


def _objects(values: Sequence[object]) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def as_arrow(values: np.ndarray) -> pa.Array:
    """An Arrow column: decimals become floats, mixed objects text, times have no zone."""
    if values.dtype.kind == "O":
        own = [None if v is None else float(v) if isinstance(v, decimal.Decimal) else v.item() if isinstance(v, np.generic) else v for v in values.tolist()]
        kinds = {type(v) for v in own if v is not None}
        if not kinds:
            return pa.array(own, pa.string())
        if kinds <= {int, float} and float in kinds:
            return pa.array([None if v is None else float(v) for v in own], pa.float64())
        if kinds <= {dt.datetime, dt.date} and dt.datetime in kinds:
            return pa.array(own, pa.timestamp("us"))
        if len(kinds) > 1:
            own = [None if v is None else str(v) for v in own]
        return pa.array(own)
    if values.dtype.kind == "M":
        return pa.array(values.astype("datetime64[D]")) if np.datetime_data(values.dtype)[0] == "D" else pa.array(values.astype("datetime64[us]"), pa.timestamp("us"))
    if values.dtype.kind == "m":
        return pa.array(values.astype("timedelta64[us]"))
    if values.dtype.kind == "u":
        return pa.array(values).cast({1: pa.int16(), 2: pa.int32(), 4: pa.int64(), 8: pa.decimal128(20, 0)}[values.dtype.itemsize])
    if values.dtype.kind == "c":
        raise TypeError("Complex numbers aren't supported.")
    return pa.array(values)


def local_table(data: Mapping[str, object], check_rows: bool = True) -> pa.Table:
    """An Arrow table with the hidden row order. ValueError if columns differ in length."""
    arrays = {name: as_array(values) for name, values in data.items()}
    if len({len(a) for a in arrays.values()}) > 1:
        raise ValueError("Columns must have the same length." if check_rows else "Columns of different lengths can't be held, even unchecked.")
    columns = {name: as_arrow(a) for name, a in arrays.items()}
    rows = len(next(iter(columns.values())))
    for name in columns:
        if name == RID:
            raise ValueError(f"`{RID}` is a reserved name.")
    return pa.table(columns | {RID: pa.array(np.arange(rows, dtype=np.int64))})


def local_frame(spark: SparkSession, data: Mapping[str, object], dtypes: Mapping[str, object] | None = None, check_rows: bool = True) -> DataFrame:
    """A DataFrame with the hidden row order. ValueError if columns differ in length."""
    return cast_columns(spark.createDataFrame(local_table(data, check_rows)), dtypes or {})


def cast_columns(df: DataFrame, dtypes: Mapping[str, object]) -> DataFrame:
    for name in dtypes:
        if name not in df.columns:
            raise ValueError(f"Column {name} does not exist in the frame.")
        dtype_name(dtypes[name])
    return df.withColumns({n: cast_to(F.col(f"`{n}`"), df.schema[n].dataType, d) for n, d in dtypes.items()}) if dtypes else df


def records_table(records: Iterable[Sequence[object]], columns: Sequence[str]) -> pa.Table:
    """Rows as an Arrow table; ValueError if there are none, or if their lengths differ from the names'."""
    rows = [tuple(r) for r in records]
    if not rows:
        raise ValueError("No records were given.")
    if any(len(r) != len(columns) for r in rows):
        raise ValueError("Each record must have a value for each column.")
    return local_table({c: _objects(list(v)) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})


def records_frame(spark: SparkSession, records: Iterable[Sequence[object]], columns: Sequence[str], dtypes: Mapping[str, object] | Sequence[object] | None = None) -> DataFrame:
    """Rows as a frame; ValueError if there are none, or if their lengths differ from the names'."""
    found = records_table(records, columns)
    if dtypes is not None and not isinstance(dtypes, Mapping):
        dtypes = dict(zip(columns, dtypes, strict=True))
    return cast_columns(spark.createDataFrame(found), dtypes or {})


@dataclass(frozen=True, eq=False)
class Pieces:
    """Local rows in pieces that become a DataFrame together, when one is asked for; so a union of many costs no plan, and no job, each.

    ``tables`` is an Arrow table or a pair of such, nested; all have the same names. Columns without a dtype have the same type in all.
    """

    spark: SparkSession
    tables: Any
    kinds: dict[str, pa.DataType | None]
    dtypes: Mapping[str, object]
    casts: Mapping[str, Callable[[Column], Column]]

    @classmethod
    def of(cls, spark: SparkSession, table: pa.Table, dtypes: Mapping[str, object]) -> Pieces:
        return cls(spark, table, {f.name: None if f.name in dtypes else f.type for f in table.schema}, dtypes, object_formatter.copy())

    def followed_by(self, other: Pieces) -> Pieces | None:
        """Both, this one's rows first; None if their types, sessions or formatters differ."""
        same = self.spark is other.spark and self.kinds == other.kinds and self.dtypes == other.dtypes and self.casts == other.casts
        return Pieces(self.spark, (self.tables, other.tables), self.kinds, self.dtypes, self.casts) if same else None

    def frame(self) -> DataFrame:
        """One local relation for each set of Arrow types that pieces have; the hidden order runs through all pieces."""
        by_types: dict[tuple[pa.DataType, ...], list[pa.Table]] = {}
        names, at, left = list(self.kinds), 0, [self.tables]
        while left:
            piece = left.pop()
            if isinstance(piece, tuple):
                left += reversed(piece)
                continue
            piece = piece.select(names)
            piece = piece.set_column(names.index(RID), RID, pa.array(np.arange(at, at + piece.num_rows, dtype=np.int64)))
            at += piece.num_rows
            by_types.setdefault(tuple(piece.schema.types), []).append(piece)
        frames = [cast_columns(self.spark.createDataFrame(pa.concat_tables(t).combine_chunks()), self.dtypes) for t in by_types.values()]
        return object_formatter.apply(reduce(lambda a, b: a.union(b), frames), self.casts)


def empty_frame(spark: SparkSession, columns: Sequence[str], dtypes: Sequence[object]) -> DataFrame:
    from pyspark.sql import types as T

    return spark.createDataFrame([], T.StructType([*(T.StructField(c, spark_type(d)) for c, d in zip(columns, dtypes, strict=True)), T.StructField(RID, T.LongType())]))


def batches(rows: Iterable[Sequence[object]], size: int) -> Iterator[list[Sequence[object]]]:
    held: list[Sequence[object]] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
