"""Aggregate callables as native Spark columns; others become grouped Arrow-batched UDFs.

A native aggregate is summed in map tasks before the shuffle. Results keep the source column's type, so that a
mean of integers is cut toward zero; but sums and products of integers, which outgrow narrow types as tables grow, and counts are long.
``preserve_dtype=False`` gives Spark's own result type.
"""

from __future__ import annotations

import builtins
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import is_float

NAN = float("nan")


def _sum(c: Column, kind: T.DataType) -> Column:
    return F.bool_or(c) if isinstance(kind, T.BooleanType) else F.sum(c)


def _min(c: Column, kind: T.DataType) -> Column:
    return F.when(F.bool_or(F.isnan(c)), F.lit(NAN)).otherwise(F.min(c)) if is_float(kind) else F.min(c)


#: What each known callable is, by name.
NATIVE: dict[str, Callable[[Column, T.DataType], Column]] = {
    "sum": _sum,
    "len": lambda c, kind: F.count(F.lit(1)),
    "max": lambda c, kind: F.max(c),
    "min": _min,
    "mean": lambda c, kind: F.avg(c),
    "std": lambda c, kind: F.stddev_pop(c),
    "var": lambda c, kind: F.var_pop(c),
    "median": lambda c, kind: F.median(c),
    "prod": lambda c, kind: F.product(c),
    "any": lambda c, kind: F.bool_or(c),
    "all": lambda c, kind: F.bool_and(c),
}
_KNOWN = {builtins.sum: "sum", builtins.len: "len", builtins.max: "max", builtins.min: "min", builtins.any: "any", builtins.all: "all"}
_KNOWN |= {np.sum: "sum", np.size: "len", np.max: "max", np.min: "min", np.amax: "max", np.amin: "min", np.mean: "mean", np.average: "mean", np.std: "std", np.var: "var", np.median: "median", np.prod: "prod", np.any: "any", np.all: "all"}
#: Callables that give a row for each row of the group.
RUNNING = {np.cumsum: "cumsum", "cumsum": "cumsum"}


@dataclass(frozen=True)
class Native:
    """A function from Column to an aggregate Column, marked so that it isn't taken for one on arrays."""

    fn: Callable[[Column], Column]

    def __call__(self, c: Column) -> Column:
        return self.fn(c)


def native(fn: Callable[[Column], Column]) -> Native:
    return Native(fn)


def known_name(fn: object) -> str | None:
    if isinstance(fn, str):
        return fn if fn in NATIVE else None
    try:
        return _KNOWN.get(fn)
    except TypeError:
        return None


def parse(aggregation: Mapping[str, object] | None) -> dict[str, tuple[object, str]]:
    """The function of each output column and the column that it reads: its own, or the one that is named beside the function."""
    return {name: _applied(name, given) for name, given in (aggregation or {}).items()}


def parse_iter(iter_fn: Mapping[str, object] | None) -> dict[str, object]:
    """The function of each output column that is made from the group's number."""
    return {name: _applied(name, fn, paired=False)[0] for name, fn in (iter_fn or {}).items()}


def _applied(name: str, given: object, paired: bool = True) -> tuple[object, str]:
    fn, source = given, name
    if paired and isinstance(given, tuple | list) and len(given) == 2:
        fn, source = given
    if not _is_function(fn) or not isinstance(source, str):
        raise ValueError(f"Output column `{name}` takes a function{' or a function with a column name' if paired else ''}, but got {given!r}.")
    return fn, source


def _is_function(fn: object) -> bool:
    return callable(fn) or (isinstance(fn, str) and (fn in NATIVE or fn in RUNNING))


def native_aggregate(fn: object, column: Column, kind: T.DataType, preserve_dtype: bool) -> Column | None:
    """The aggregate column of a known callable, else None."""
    if isinstance(fn, Native):
        return fn(column)
    name = known_name(fn)
    if name is None or (name in ("any", "all") and not isinstance(kind, T.BooleanType)):
        return None
    out = NATIVE[name](column, kind)
    if name == "len" or (name in ("sum", "prod") and isinstance(kind, T.IntegralType) and preserve_dtype):
        return out.cast("long")
    if isinstance(kind, T.StringType) or not preserve_dtype:
        return out
    return out.cast(kind)


def udf_aggregate(fn: Callable, kind: T.DataType, preserve_dtype: bool = True) -> Callable[[Column], Column]:
    """A grouped-aggregate pandas UDF of an unknown callable on the group's array; its result keeps the column's type, or is
    a double if that needn't be kept and is a number's."""
    import pandas as pd

    if not preserve_dtype and isinstance(kind, T.NumericType):
        kind = T.DoubleType()
    integral = isinstance(kind, T.IntegralType)

    def run(values: pd.Series) -> object:
        found = fn(values.to_numpy())
        return int(found) if integral else found

    run.__annotations__ = {"values": pd.Series, "return": {T.DoubleType: float}.get(type(kind), object)}
    return F.pandas_udf(run, kind, F.PandasUDFType.GROUPED_AGG)


def iter_value(fn: object, ordinal: Column, count: Column) -> Column:
    """``fn`` of the group's ordinal, repeated for each of its rows, as a long."""
    name = known_name(fn)
    closed = {"len": count, "max": ordinal, "min": ordinal, "mean": ordinal, "median": ordinal, "sum": ordinal * count, "std": F.lit(0), "var": F.lit(0)}
    if name in closed:
        return closed[name].cast("long")
    import pandas as pd

    @F.pandas_udf("long")
    def run(i: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(fn(a * np.ones(b, dtype=int))) for a, b in zip(i, n, strict=True)])

    return run(ordinal, count)
