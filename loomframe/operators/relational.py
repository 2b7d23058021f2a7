"""Group-by, transform, grouped iteration, joins and union over Spark DataFrames.

A transform is an aggregation joined back on its keys, not a window: an aggregate is summed before the shuffle and the
few group rows are broadcast, so a group of any size doesn't have to fit in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import aggregates
from ..plans.ordinals import RID, with_ordinals
from . import predicates
from .validate import has_columns, names, same_schema

#: Rows of the smaller side of a join without an equality.
MOST_COMPARED = 100_000
_ORDINAL, _COUNT, _FIRST = "__lf_group", "__lf_count", "__lf_first"


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}


def _keys_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return predicates.all_of([left[f"`{k}`"].eqNullSafe(right[f"`__lf_key_{i}`"]) for i, k in enumerate(keys)])


def _renamed_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*(_q(k).alias(f"__lf_key_{i}") for i, k in enumerate(keys)), *(_q(c) for c in df.columns if c not in keys))


@dataclass
class _Aggregated:
    """What group_by and transform share: the spec, and a table of one row a group."""

    columns: str | Iterable[str]
    aggregation: Mapping[str, object] | None = None
    iter_fn: Mapping[str, object] | None = None
    preserve_dtype: bool = True
    keys: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.keys = list(dict.fromkeys(names(self.columns)))
        if not self.keys:
            raise ValueError("Give at least one column to group by.")
        self.specs = aggregates.parse(self.aggregation)
        self.iters = aggregates.parse_iter(self.iter_fn)

    @property
    def outputs(self) -> list[str]:
        """Keys, aggregates and iter_fns; of equal names the last counts, at the place of the first."""
        return list(dict.fromkeys([*self.keys, *self.specs, *self.iters]))

    def check(self, df: DataFrame) -> None:
        has_columns(df, [*self.keys, *(c for _, c in self.specs.values())])

    def groups(self, df: DataFrame, order: Sequence[Column | str], specs: Mapping[str, tuple[object, str]]) -> DataFrame:
        """Keys, the values ``__lf_v*`` of ``specs``, and if iter_fns ask for it the group's ordinal and count."""
        kinds = _kinds(df)
        native, udfs = [], []
        for i, (fn, source) in enumerate(specs.values()):
            found = aggregates.native_aggregate(fn, _q(source), kinds[source], self.preserve_dtype)
            if found is None:
                udfs.append(aggregates.udf_aggregate(fn, kinds[source], self.preserve_dtype)(_q(source)).alias(f"__lf_v{i}"))
            else:
                native.append(found.alias(f"__lf_v{i}"))
        if self.iters:
            first = _order_value(df, order)
            native += [F.count(F.lit(1)).alias(_COUNT), F.min(first).alias(_FIRST)]
        by = [_q(k) for k in self.keys]
        if not udfs:
            out = df.groupBy(*by).agg(*native) if native else df.select(*by).distinct()
        else:
            out = df.groupBy(*by).agg(*udfs)
            if native:  # Spark doesn't mix the two in one aggregation
                other = _renamed_keys(df.groupBy(*by).agg(*native), self.keys)
                out = out.join(other, _keys_match(out, other, self.keys)).drop(*(f"__lf_key_{i}" for i in range(len(self.keys))))
        return with_ordinals(out, [_FIRST], _ORDINAL) if self.iters else out

    def values(self, specs: Mapping[str, object]) -> dict[str, Column]:
        out = {name: _q(f"__lf_v{i}") for i, name in enumerate(specs)}
        return out | {name: aggregates.iter_value(fn, _q(_ORDINAL), _q(_COUNT)) for name, fn in self.iters.items()}


def _order_value(df: DataFrame, order: Sequence[Column | str]) -> Column:
    cols = [_q(c) if isinstance(c, str) else c for c in order]
    return F.struct(*cols) if cols else F.monotonically_increasing_id()


@dataclass
class GroupBy(_Aggregated):
    """One row for each distinct key. Null and NaN are keys like any other, each one group."""

    def apply(self, df: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
        self.check(df)
        out, values = self.groups(df, order, self.specs), self.values(self.specs)
        return out.select(*((values[c] if c in values else _q(c)).alias(c) for c in self.outputs))


@dataclass
class Transform(_Aggregated):
    """For each row its keys and its group's values, in input order.

    Known running functions become window functions; an unknown callable runs on its group's array in input
    order, and may give one value or one for each row.
    """

    def apply(self, df: DataFrame, order: Sequence[Column | str] = ()) -> DataFrame:
        self.check(df)
        kinds = _kinds(df)
        running = {n: s for n, s in self.specs.items() if _is_running(s[0])}
        unknown = {n: s for n, s in self.specs.items() if n not in running and aggregates.native_aggregate(s[0], F.lit(None), kinds[s[1]], self.preserve_dtype) is None}
        grouped = {n: s for n, s in self.specs.items() if n not in running and n not in unknown}
        rows = df
        if running or unknown:
            rows = rows.withColumn("__lf_order", _order_value(df, order))
            frame = Window.partitionBy(*(_q(k) for k in self.keys)).orderBy("__lf_order").rowsBetween(Window.unboundedPreceding, 0)
            for i, (_, source) in enumerate(running.values()):
                rows = rows.withColumn(f"__lf_r{i}", F.sum(_q(source)).over(frame).cast(kinds[source]))
            if unknown:
                rows = self._mapped(rows, unknown, kinds)
        values: dict[str, Column] = {n: _q(f"__lf_r{i}") for i, n in enumerate(running)} | {n: _q(f"__lf_u{i}") for i, n in enumerate(unknown)}
        if grouped or self.iters:
            groups = _renamed_keys(self.groups(df, order, grouped), self.keys)
            rows = rows.join(groups, _keys_match(rows, groups, self.keys), "left")
            values |= self.values(grouped)
        hidden = [c for c in (RID,) if c in df.columns and c not in self.outputs]
        return rows.select(*((values[c] if c in values else _q(c)).alias(c) for c in self.outputs), *hidden)

    def _mapped(self, rows: DataFrame, unknown: Mapping[str, tuple[object, str]], kinds: Mapping[str, T.DataType]) -> DataFrame:
        schema = T.StructType([*rows.schema, *(T.StructField(f"__lf_u{i}", kinds[c]) for i, (_, c) in enumerate(unknown.values()))])
        functions = [(f"__lf_u{i}", fn, c, isinstance(kinds[c], T.IntegralType)) for i, (fn, c) in enumerate(unknown.values())]

        def run(pdf):
            pdf = pdf.iloc[np.argsort(pdf["__lf_order"].map(_plain).to_numpy(), kind="stable")] if len(pdf) else pdf
            for name, fn, source, whole in functions:
                found = fn(pdf[source].to_numpy())
                pdf[name] = np.trunc(found).astype("int64") if whole and np.asarray(found).dtype.kind == "f" else found
            return pdf

        return rows.groupBy(*(_q(k) for k in self.keys)).applyInPandas(run, schema)


def _plain(value: object) -> object:
    """An order value that sorts: one of several columns arrives as a dict or row."""
    if isinstance(value, dict):
        value = tuple(value.values())
    return value[0] if isinstance(value, tuple) and len(value) == 1 else value


def _is_running(fn: object) -> bool:
    try:
        return fn in aggregates.RUNNING
    except TypeError:
        return False


@dataclass
class IterateBy:
    """The groups in order of appearance: key (bare for one column), the condition that selects it, and its rows.

    One job finds the keys, and each group is a lazy plan. To work on all groups at once use
    apply_groups(), which runs where the groups are.
    """

    columns: str | Iterable[str]

    def apply(self, df: DataFrame, order: Sequence[Column | str] = ()) -> Iterator[tuple[object, Column, DataFrame]]:
        keys = list(dict.fromkeys(names(self.columns)))
        if not keys:
            raise ValueError("Give at least one column to group by.")
        has_columns(df, keys)
        found = df.groupBy(*(_q(k) for k in keys)).agg(F.min(_order_value(df, order)).alias(_FIRST)).orderBy(_FIRST)
        for row in found.select(*(_q(k) for k in keys)).toLocalIterator():
            cond = predicates.all_of([_q(k).eqNullSafe(F.lit(v).cast(df.schema[k].dataType)) for k, v in zip(keys, row, strict=True)])
            yield (row[0] if len(keys) == 1 else tuple(row)), cond, df.filter(cond)


def apply_groups(df: DataFrame, columns: str | Iterable[str], fn: Callable, schema: str | T.StructType) -> DataFrame:
    """``fn`` of each group's pandas frame, on the executors."""
    keys = names(columns)
    has_columns(df, keys)
    return df.groupBy(*(_q(k) for k in keys)).applyInPandas(fn, schema)


@dataclass
class _Join:
    on: Sequence[tuple[str, str, str]]
    select: str | Iterable[str] = ()
    how = "inner"

    def check(self, left: DataFrame, right: DataFrame) -> None:
        if not self.on:
            raise ValueError("Give at least one (left, right, operator) condition.")
        has_columns(left, [a for a, _, _ in self.on])
        has_columns(right, [b for _, b, _ in self.on])
        a, b = _kinds(left), _kinds(right)
        for x, y, op in self.on:
            if a[x] != b[y]:
                raise TypeError(f"Column `{x}` is `{a[x].simpleString()}` and column `{y}` is `{b[y].simpleString()}`.")
            predicates.condition(F.lit(None), op, F.lit(None), T.LongType())

    def apply(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Selected columns in table order, left ones first; of a name on both sides the left column."""
        self.check(left, right)
        chosen = names(self.select)
        kinds = _kinds(left)
        moved = right.toDF(*(f"__lf_right_{i}" for i in range(len(right.columns))))
        place = {c: f"__lf_right_{i}" for i, c in enumerate(right.columns)}
        cond = predicates.all_of([predicates.condition(_q(a), op, _q(place[b]), kinds[a]) for a, b, op in self.on])
        hidden = [RID] if RID in left.columns else []
        out = left.join(moved, cond, self.how) if any(op == "==" for _, _, op in self.on) else self._compared(left, moved, cond)
        mine = [c for c in left.columns if c != RID and (not chosen or c in chosen)]
        theirs = [c for c in right.columns if c != RID and c not in left.columns and (not chosen or c in chosen)]
        return out.select(*(_q(c) for c in mine), *(_q(place[c]).alias(c) for c in theirs), *hidden)


    def _compared(self, left: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
        """A join without an equality compares all pairs, so one side must be small: it is counted and sent to all tasks. An outer join
        can only send the right one."""
        for side in ("right", "left")[: 2 if self.how == "inner" else 1]:
            small = right if side == "right" else left
            if small.limit(MOST_COMPARED + 1).count() <= MOST_COMPARED:
                pair = (left, F.broadcast(right)) if side == "right" else (F.broadcast(left), right)
                return pair[0].join(pair[1], cond, self.how)
        raise ValueError(f"A join without an equality needs a side of {MOST_COMPARED} rows or fewer{'' if self.how == 'inner' else ', the right one'}.")


@dataclass
class InnerJoin(_Join):
    """Rows of both sides for which all conditions hold."""

    how = "inner"


@dataclass
class LeftJoin(_Join):
    """As InnerJoin, and once each left row that matches nothing, with nulls."""

    how = "left"


@dataclass
class CrossJoin:
    """Every pair of rows: the Cartesian product. It is quadratic by definition; at most one side should be large."""

    select: str | Iterable[str] = ()

    def apply(self, left: DataFrame, right: DataFrame) -> DataFrame:
        chosen = names(self.select)
        mine = [c for c in left.columns if c != RID and (not chosen or c in chosen)]
        theirs = [c for c in right.columns if c != RID and c not in left.columns and (not chosen or c in chosen)]
        if chosen:
            for side, own in (("left", mine), ("right", [c for c in right.columns if c in chosen])):
                if not own:
                    raise IndexError(f"The selected columns must have one of the {side} frame.")
        hidden = [RID] if RID in left.columns else []
        moved = right.select(*(_q(c).alias(f"__lf_right_{i}") for i, c in enumerate(theirs)))
        return left.select(*(_q(c) for c in mine), *hidden).crossJoin(moved).select(*(_q(c) for c in mine), *(_q(f"__lf_right_{i}").alias(c) for i, c in enumerate(theirs)), *hidden)


@dataclass
class Union:
    """All rows of both, columns matched by name; schemas must be the same."""

    def apply(self, left: DataFrame, right: DataFrame) -> DataFrame:
        same_schema(left, right)
        return left.unionByName(right)
