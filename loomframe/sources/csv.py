"""CSV input with type inference over the whole file.

Pass one reads all columns as text and finds, in one aggregation, the first of int32, int64, float64 and bool
that every value of a column fits, else text. Pass two is a typed projection of the same scan. Rows with more or fewer
fields than the header are errors. Files are split and read by all executors, unless quoted fields hold line feeds
(``multi_line``).
"""

from __future__ import annotations

import csv as _csv
import io
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import spark_type

TRUE, FALSE = ("true", "yes", "t"), ("false", "no", "f")
_INT = r"^[+-]?[0-9]+(_[0-9]+)*$"
_FLOAT = r"^[+-]?(([0-9]+(_[0-9]+)*)?\.?([0-9]+(_[0-9]+)*)?([eE][+-]?[0-9]+)?|inf|infinity|nan)$"


def unique_header(header: Sequence[str]) -> list[str]:
    """Names with the second, third ... of equal ones marked `` (2)``, `` (3)``."""
    seen: dict[str, int] = {}
    out = []
    for name in header:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return out


def _number(c: Column) -> Column:
    return F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(""))


def _as_int(c: Column, kind: str) -> Column:
    return F.when(F.trim(c).rlike(_INT), _number(c).try_cast(kind))


def _as_float(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.rlike(_FLOAT) & text.rlike("[0-9nf]"), _number(c).try_cast("double"))


def _as_bool(c: Column) -> Column:
    text = F.lower(c)
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def parsers() -> list[tuple[str, object]]:
    """In order of preference."""
    return [("int32", lambda c: _as_int(c, "int")), ("int64", lambda c: _as_int(c, "long")), ("float64", _as_float), ("bool", _as_bool)]


def read_text(spark: SparkSession, path: str | Path, missing: str | None = "", sep: str = ",", quote: str = '"', multi_line: bool = False, escape: str | None = None, skip_spaces: bool = False) -> DataFrame:
    """All columns as text, from a path or an open file's path; ``missing`` is null, as with blanks if it is the empty string."""
    path = str(getattr(path, "name", path) if not isinstance(path, str | Path) else path)
    head = spark.read.text(path, wholetext=False).head(1)
    if not head:
        raise ValueError(f"{path} has no header.")
    header = unique_header(next(_csv.reader(io.StringIO(head[0][0]), delimiter=sep, quotechar=quote or None, quoting=_csv.QUOTE_MINIMAL if quote else _csv.QUOTE_NONE, escapechar=escape, skipinitialspace=skip_spaces)))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    options = {"header": True, "enforceSchema": True, "sep": sep, "quote": quote or "\x00", "escape": escape or quote or "\x00", "mode": "FAILFAST", "multiLine": multi_line, "columnPruning": False, "ignoreLeadingWhiteSpace": skip_spaces, "ignoreTrailingWhiteSpace": False}
    # an unlikely marker keeps the reader from making nulls of its own; which text is missing is decided here
    options |= {"nullValue": "\x00", "emptyValue": ""}
    df = spark.read.schema(schema).options(**options).csv(path)
    cell = lambda i: F.coalesce(F.col(f"c{i}"), F.lit(""))
    return df.select(*((F.when(cell(i) != missing, cell(i)) if missing is not None else cell(i)).alias(name) for i, name in enumerate(header)))


def csv_names(own: dict[str, object], given: Mapping[str, object]) -> dict[str, object]:
    """Arguments of read_text() from those that Python's csv module knows; TypeError for any other."""
    out, left = dict(own), dict(given)
    for theirs, ours in (("delimiter", "sep"), ("quotechar", "quote"), ("escapechar", "escape"), ("skipinitialspace", "skip_spaces")):
        if theirs in left:
            out[ours] = left.pop(theirs)
    quoting, doubled = left.pop("quoting", _csv.QUOTE_MINIMAL), left.pop("doublequote", True)
    if quoting == _csv.QUOTE_NONE:
        out["quote"] = ""
    elif quoting not in (_csv.QUOTE_MINIMAL, _csv.QUOTE_ALL):
        raise ValueError("Quoting must be minimal, all or none.")
    if not doubled and not out.get("escape"):
        out["escape"] = "\\"
    left.pop("strict", None)
    left.pop("lineterminator", None)
    if left:
        raise TypeError(f"Options {sorted(left)} aren't known.")
    return out


def infer(df: DataFrame) -> dict[str, str]:
    """The dtype of each text column; ValueError for rows of another length than the header."""
    kinds = parsers()
    fits = [F.coalesce(F.bool_and(F.coalesce(parse(F.col(f"`{c}`")).isNotNull(), F.lit(False)) | F.col(f"`{c}`").isNull()), F.lit(False)).alias(f"f{i}_{k}") for i, c in enumerate(df.columns) for k, (_, parse) in enumerate(kinds)]
    full = [F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(df.columns)]
    try:
        row = df.agg(*fits, *full).first()
    except Exception as e:
        if "MALFORMED" in str(e) or "FAILFAST" in str(e):
            raise ValueError("A row's length differs from the header's.") from e
        raise
    # a column without any value is of floats, as its blanks would be
    return {c: ("float64" if not row[f"n{i}"] else next((name for k, (name, _) in enumerate(kinds) if row[f"f{i}_{k}"]), "object")) for i, c in enumerate(df.columns)}


def read_csv(spark: SparkSession, path: str | Path, guess_rows: int = 5, missing: str | None = "", dtypes: Mapping[str, object] | None = None, sep: str = ",", quote: str = '"', multi_line: bool = False, **csv_options: object) -> DataFrame:
    """A typed DataFrame. ``guess_rows`` is accepted and has no effect: types are inferred over all rows.

    A blank in a column of whole numbers is null and the column stays whole. ``dtypes`` overrides what is inferred. The names that
    Python's csv module has for options are taken too: ``delimiter``, ``quotechar``, ``escapechar``, ``doublequote``, ``quoting`` (minimal, all or
    none), ``skipinitialspace``, ``strict`` and ``lineterminator``; the last two change nothing, as odd rows are errors and any line end is taken.
    """
    text = read_text(spark, path, missing, **csv_names({"sep": sep, "quote": quote, "multi_line": multi_line}, csv_options))
    found = infer(text)
    parse = dict(parsers())
    for name in dtypes or {}:
        if name not in found:
            raise ValueError(f"Column {name} does not exist in the frame.")
    out = []
    for name, kind in found.items():
        c = F.col(f"`{name}`")
        typed = parse[kind](c) if kind in parse else c
        if dtypes and name in dtypes:
            target = spark_type(dtypes[name])
            typed = typed.cast(target) if kind != "object" or isinstance(target, T.StringType) else F.when(F.trim(c) != "", F.trim(c)).cast(target)
        out.append(typed.alias(name))
    return text.select(*out)
