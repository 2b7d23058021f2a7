"""Checks before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from ..types import name_of


def names(columns: str | Iterable[str]) -> list[str]:
    """A bare string is one column."""
    return [columns] if isinstance(columns, str) else list(columns)


def has_columns(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if c not in df.columns:
            raise ValueError(f"Column {c} does not exist in the frame.")


def same_schema(left: DataFrame, right: DataFrame) -> None:
    """For a union: ValueError for other column counts, TypeError for other names or types."""
    if len(left.columns) != len(right.columns):
        raise ValueError("Both frames must have the same number of columns.")
    kinds = {f.name: f.dataType for f in right.schema}
    for f in left.schema:
        if f.name not in kinds:
            raise TypeError(f"Column `{f.name}` does not exist in the right frame.")
        if f.dataType != kinds[f.name]:
            raise TypeError(f"Column `{f.name}` is `{name_of(f.dataType)}` on the left and `{name_of(kinds[f.name])}` on the right.")
