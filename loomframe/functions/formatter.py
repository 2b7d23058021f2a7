"""Casts that are applied to columns by type when a frame takes them in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..types import name_of


class ObjectFormatter:
    """Type name (``Decimal``, ``date``, ``datetime``, ``str`` or a dtype's name) to a function from Column to Column.

    Works by the schema, so empty columns and columns that begin with nulls are cast like any other.
    """

    _NAMES = {T.DecimalType: "Decimal", T.DateType: "date", T.TimestampNTZType: "datetime", T.TimestampType: "datetime", T.StringType: "str"}

    def __init__(self) -> None:
        self._casts: dict[str, Callable[[Column], Column]] = {"Decimal": lambda c: c.cast("double")}

    def __setitem__(self, name: str, cast: Callable[[Column], Column]) -> None:
        if not callable(cast):
            raise ValueError(f"{name}: {cast} is not callable")
        from pyspark.sql import functions as F

        try:
            found = cast(F.lit(None))
        except Exception as e:
            raise ValueError(f"{name}: {cast} must take and return a Column") from e
        if not isinstance(found, Column):
            raise ValueError(f"{name}: {cast} must return a Column")
        self._casts[name] = cast

    def __getitem__(self, name: str) -> Callable[[Column], Column]:
        return self._casts[name]

    def __delitem__(self, name: str) -> None:
        del self._casts[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._casts)

    def __len__(self) -> int:
        return len(self._casts)

    def __contains__(self, name: object) -> bool:
        return name in self._casts

    def __str__(self) -> str:
        return str(self._casts)

    __repr__ = __str__

    def copy(self) -> dict[str, Callable[[Column], Column]]:
        return dict(self._casts)

    def cast_of(self, kind: T.DataType, casts: Mapping[str, Callable[[Column], Column]] | None = None) -> Callable[[Column], Column] | None:
        held = self._casts if casts is None else casts
        return held.get(self._NAMES.get(type(kind), "")) or held.get(name_of(kind))

    def apply(self, df: DataFrame, casts: Mapping[str, Callable[[Column], Column]] | None = None) -> DataFrame:
        """``casts``: those of an earlier copy() instead of the present ones."""
        casts = {f.name: cast(df[f"`{f.name}`"]) for f in df.schema if (cast := self.cast_of(f.dataType, casts))}
        return df.withColumns(casts) if casts else df


#: The formatter that frames use.
object_formatter = ObjectFormatter()
