"""Join conditions. Equality holds for null with null, and never for NaN; an order never holds with either."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import is_float

OPS = ("==", "!=", "<", "<=", ">", ">=")


def condition(left: Column, op: str, right: Column, kind: T.DataType) -> Column:
    """``left op right`` for columns of type ``kind``; TypeError for an unknown operator."""
    if op not in OPS:
        raise TypeError(f"The operator `{op}` is not valid: it must be one of {', '.join(OPS)}.")
    floating = is_float(kind)
    if op == "==":
        same = left.eqNullSafe(right)
        return same & ~F.isnan(left) if floating else same
    if op == "!=":
        other = ~left.eqNullSafe(right)
        return other | (F.isnan(left) & F.isnan(right)) if floating else other
    cond = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return cond & ~F.isnan(left) & ~F.isnan(right) if floating else cond


def all_of(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
