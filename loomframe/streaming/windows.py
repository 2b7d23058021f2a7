"""Group-by on unbounded input: the aggregates of the frame over event-time windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates
from ..operators.validate import has_columns, names


def group_by_window(stream: DataFrame, time: str, width: str, columns: str | list[str] = (), aggregation: Mapping[str, object] | None = None, late: str = "0 seconds", slide: str | None = None) -> DataFrame:
    """One row for each window of event time and key: window_start, window_end, the keys and the aggregates.

    ``aggregation`` is that of group_by(), of known callables only, as state has to be combined. Rows that are more than
    ``late`` behind the latest event time are dropped, and with them a window's state; without late rows the result on a
    bounded table is the same as on a stream of it. Null times are dropped, null keys are keys.
    """
    keys, specs = names(columns), aggregates.parse(aggregation)
    has_columns(stream, [time, *keys, *(c for _, c in specs.values())])
    kinds = {f.name: f.dataType for f in stream.schema}
    out = []
    for name, (fn, source) in specs.items():
        found = aggregates.native_aggregate(fn, F.col(f"`{source}`"), kinds[source], True)
        if found is None:
            raise ValueError(f"Output column `{name}`: {fn!r} has no state that can be combined.")
        out.append(found.alias(name))
    span = F.window(F.col(f"`{time}`"), width, slide) if slide else F.window(F.col(f"`{time}`"), width)
    grouped = stream.withWatermark(time, late).groupBy(span.alias("__lf_window"), *(F.col(f"`{k}`") for k in keys)).agg(*out)
    return grouped.select(F.col("__lf_window.start").alias("window_start"), F.col("__lf_window.end").alias("window_end"), *(F.col(f"`{c}`") for c in (*keys, *specs)))
