"""A PySpark-native frame library: typed columns, relational operators, CSV and SQL input, record and CSV output.

Names are loaded when they are first used, so that tasks which need one module don't import all.
"""

from __future__ import annotations

import importlib

_WHERE = {
    "Frame": "frame",
    "native": "functions.aggregates",
    "ObjectFormatter": "functions.formatter",
    "object_formatter": "functions.formatter",
    "to_field_name": "functions.names",
    "CrossJoin": "operators.relational",
    "GroupBy": "operators.relational",
    "InnerJoin": "operators.relational",
    "IterateBy": "operators.relational",
    "LeftJoin": "operators.relational",
    "Transform": "operators.relational",
    "Union": "operators.relational",
}
_METHODS = ("read_sql", "read_sql_chunks", "read_csv", "as_frame")

__all__ = [*_WHERE, *_METHODS]


def __getattr__(name: str):
    if name in _METHODS:
        return getattr(importlib.import_module(".frame", __name__).Frame, name)
    if name in _WHERE:
        return getattr(importlib.import_module(f".{_WHERE[name]}", __name__), name)
    raise AttributeError(name)
