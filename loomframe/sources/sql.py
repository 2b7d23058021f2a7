"""SQL input: over registered views, or through a DB-API cursor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from .local import Pieces, batches, empty_frame, records_frame, records_table


class Cursor(Protocol):
    """What is used of a DB-API cursor."""

    description: Any

    def execute(self, sql: str) -> Any: ...
    def fetchone(self) -> Any: ...
    def fetchmany(self, size: int) -> Any: ...
    def fetchall(self) -> Any: ...


def _known(kind: object) -> object:
    from ..types import dtype_name

    try:
        return dtype_name(kind)
    except TypeError:
        return "object"


def _described(cur: Cursor) -> tuple[list[str], list[object]]:
    """Names and types; a type that the cursor doesn't tell is None, and found from the rows."""
    return [d[0] for d in cur.description], [None if d[1] is None else _known(d[1]) for d in cur.description]


def _rows_frame(spark: SparkSession, rows: list[Any], columns: list[str], kinds: list[object]) -> DataFrame:
    if not rows:
        return empty_frame(spark, columns, [k or "object" for k in kinds])
    return records_frame(spark, rows, columns, {c: k for c, k in zip(columns, kinds, strict=True) if k is not None})


def read_cursor(spark: SparkSession, query: str, cur: Cursor) -> DataFrame:
    """All rows of a query; none give an empty frame of the described columns."""
    cur.execute(query)
    columns, kinds = _described(cur)
    return _rows_frame(spark, cur.fetchall(), columns, kinds)


def read_cursor_chunks(spark: SparkSession, query: str, cur: Cursor, chunksize: int = 100) -> Iterator[Pieces | DataFrame]:
    """Local rows, up to ``chunksize`` each, fetched as they are asked for; one empty frame if there are no rows."""
    cur.execute(query)
    columns, kinds = _described(cur)
    empty = True
    while rows := cur.fetchmany(chunksize):
        empty = False
        yield Pieces.of(spark, records_table(rows, columns), {c: k for c, k in zip(columns, kinds, strict=True) if k is not None})
    if empty:
        yield _rows_frame(spark, [], columns, kinds)


def chunks(df: DataFrame, chunksize: int) -> Iterator[list[Any]]:
    """Rows of a distributed frame in lists of up to ``chunksize``; the driver holds one partition at a time."""
    return batches(df.toLocalIterator(prefetchPartitions=True), chunksize)
