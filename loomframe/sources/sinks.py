"""Output: records, lists, arrays, pandas and CSV."""

from __future__ import annotations

import csv as _csv
import io
from collections import namedtuple
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import as_record, missing_as_null


def record_columns(df: DataFrame, columns: Sequence[str], cast_null: bool = True) -> DataFrame:
    return df.select(*(as_record(F.col(f"`{c}`"), df.schema[c].dataType, cast_null).alias(c) for c in columns))


def records(df: DataFrame, columns: Sequence[str], cast_null: bool = True) -> Iterator[tuple[Any, ...]]:
    """Tuples, one partition in memory at a time."""
    for row in record_columns(df, columns, cast_null).toLocalIterator(prefetchPartitions=True):
        yield tuple(row)


def arrays(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    table = df.select(*(F.col(f"`{c}`") for c in columns)).toArrow()
    return [table.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]


def pandas(df: DataFrame, columns: Sequence[str]) -> pd.DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in columns)).toPandas()


def named(name: str | None, columns: Sequence[str], values: Sequence[Any]) -> tuple[Any, ...]:
    return tuple(values) if name is None else namedtuple(name, columns, rename=True)(*values)


def write_csv(df: DataFrame, target: str | Path | io.TextIOBase, columns: Sequence[str], single_file: bool = True) -> None:
    """Header and records in the order of ``columns``; null and NaN are blank.

    A single file is written by the driver, row by row; otherwise all executors write into a folder.
    """
    if not single_file:
        df.select(*(missing_as_null(F.col(f"`{c}`"), df.schema[c].dataType).alias(c) for c in columns)).write.mode("overwrite").csv(str(target), header=True, escape='"', nullValue="", emptyValue="")
        return
    if isinstance(target, str | Path):
        with open(target, "w", newline="", encoding="utf-8") as f:
            write_csv(df, f, columns)
        return
    if not isinstance(target, io.TextIOBase):
        raise TypeError(f"`{type(target).__name__}` is not a path or a text file.")
    out = _csv.writer(target, lineterminator="\n")
    out.writerow(columns)
    out.writerows(records(df, columns))
