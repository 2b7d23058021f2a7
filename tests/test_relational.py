"""Grouping, transforms and joins against values worked out by hand or by a plain loop."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe import Frame, native

NAN = float("nan")


@pytest.fixture
def base(spark):
    return Frame({"x": np.array([1, 2, 3, 4, 5, 6]), "y": np.array(["one", "two"] * 3, dtype=object), "z": np.array([0, 0, 0, 1, 1, 1])})


def rows(frame):
    return sorted(frame.to_records(), key=repr)


def test_group_by(base):
    out = base.group_by(["y", "z"], {"x": sum, "new_x": (sum, "x"), "count": (len, "x")}, {"id": max, "n": len, "s": sum})
    assert out.columns == ("y", "z", "x", "new_x", "count", "id", "n", "s")
    assert rows(out) == sorted([("one", 0, 4, 4, 2, 0, 2, 0), ("two", 0, 2, 2, 1, 1, 1, 1), ("two", 1, 10, 10, 2, 2, 2, 4), ("one", 1, 5, 5, 1, 3, 1, 3)], key=repr)
    assert base.group_by("y").rows == 2


def test_aggregates(base):
    fns = {"mean": (np.mean, "x"), "std": (np.std, "x"), "med": (np.median, "x"), "prod": (np.prod, "x"), "lo": (min, "x"), "hi": (max, "x"), "own": (native(F.first), "y"), "any": (lambda a: a.max() * 10, "x"), "name": ("sum", "x")}
    out = {r[0]: r[1:] for r in base.group_by("y", fns).to_records()}
    assert out["one"] == (3, 1, 3, 15, 1, 5, "one", 50, 9) and out["two"] == (4, 1, 4, 48, 2, 6, "two", 60, 12)
    loose = base.group_by("y", {"m": (np.mean, "x")}, preserve_dtype=False)
    assert loose.dtypes["m"] == "float64"
    cut = Frame({"k": ["a", "a", "a"], "x": [-1, -2, -2]}).group_by("k", {"x": np.mean})
    assert list(cut.to_records()) == [("a", -1)]
    flags = Frame({"k": [1, 1], "f": [False, True]}).group_by("k", {"f": sum, "e": (all, "f")})
    assert list(flags.to_records()) == [(1, True, False)]
    low = Frame({"k": [1, 1], "f": [1.0, NAN]}).group_by("k", {"f": min})
    assert math.isnan(next(low.to_records(cast_null=False))[1])


def test_null_and_nan_keys(spark):
    t = Frame({"k": np.array([NAN, NAN, 1.0]), "x": [1, 2, 3]})
    t["k"] = F.when(F.col("x") == 3, F.lit(None)).otherwise(F.col("k"))
    assert sorted(r[1] for r in t.group_by("k", {"n": (len, "x")}).to_records()) == [1, 2]
    assert sorted(r[1] for r in t.transform("k", {"n": (len, "x")}).to_records()) == [1, 2, 2]


@pytest.mark.parametrize("bad", [lambda t: t.group_by([], {"x": sum}), lambda t: t.group_by("y", {"x": 3}), lambda t: t.group_by("y", {"x": (sum, "x", 1)}), lambda t: t.transform("y", {}, {"i": "no"}), lambda t: t.group_by("no", {}), lambda t: t.group_by("y", {"a": (sum, "no")})])
def test_spec_errors(base, bad):
    with pytest.raises(ValueError):
        bad(base)


def test_transform(base):
    out = base.transform(["y", "z"], {"x": sum}, {"id": max})
    assert list(out.to_records()) == [("one", 0, 4, 0), ("two", 0, 2, 1), ("one", 0, 4, 0), ("two", 1, 10, 2), ("one", 1, 5, 3), ("two", 1, 10, 2)]
    assert base.transform("y", {"x": np.cumsum}).to_list(["x"], inner=True) == [[1, 2, 4, 6, 9, 12]]
    assert base.transform("y", {"x": lambda a: a - a.mean()}).to_list(["x"], inner=True) == [[-2, -2, 0, 0, 2, 2]]


def test_transform_plan_has_no_window(base):
    plan = base.transform("y", {"x": sum}).to_spark()._jdf.queryExecution().toString()
    assert "Window" not in plan and "partial_sum" in plan


def test_iterate_by(base):
    assert [(k, f.to_list(["x"], inner=True)[0]) for k, _, f in base.iterate_by("y")] == [("one", [1, 3, 5]), ("two", [2, 4, 6])]
    assert [k for k, _, _ in base.iterate_by(["y", "z"])] == [("one", 0), ("two", 0), ("two", 1), ("one", 1)]


R = {
    "R1": ([1, 2, 3, 4, 5, 6], [0, 0, 0, 1, 1, 1]),
    "R2": ([1, 1, 1, 2, 2, 2], [2, 2, 2, 3, 3, 3]),
    "R4": ([1, 1, 2, 2, 3, 3], [0, 0, 0, 1, 1, 1]),
}


def right(name):
    a, c = R[name]
    return Frame({"a": a, "b": ["one", "two"] * 3, "c": c})


SELECT = ["x", "y", "a", "b"]


def test_joins(base):
    assert base.left_join(right("R1"), [("x", "a", "==")], SELECT).rows == 6
    out = base.left_join(right("R2"), [("x", "a", "=="), ("z", "c", "==")], SELECT)
    assert [r[2:] for r in out.to_records()] == [(None, None)] * 6
    out = base.left_join(right("R4"), [("x", "a", "<")], SELECT)
    assert Counter(r[0] for r in out.to_records()) == {1: 4, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    assert base.inner_join(right("R4"), [("x", "a", "==")], SELECT).rows == 6
    assert base.inner_join(right("R2"), [("x", "a", "<=")], SELECT).rows == 9
    assert len(set(base.cross_join(right("R1"), ["x", "a"]).to_records())) == 36
    assert base.inner_join(right("R1"), [("x", "a", "==")]).columns == ("x", "y", "z", "a", "b", "c")


def test_name_clash_takes_the_left(base):
    other = Frame({"x": [1, 2], "y": ["l", "m"]})
    for out in (base.inner_join(other, [("x", "x", "==")]), base.left_join(other, [("x", "x", "==")]), base.cross_join(other)):
        assert out.columns == ("x", "y", "z") and set(out.to_list(["y"], inner=True)[0]) <= {"one", "two"}


def test_join_errors(base):
    r = right("R1")
    with pytest.raises(TypeError):
        base.inner_join(r, [("x", "a", "===")])
    with pytest.raises(TypeError):
        base.left_join(r.update_dtypes({"a": "float64"}), [("x", "a", "==")])
    with pytest.raises(ValueError):
        base.inner_join(r, [("no", "a", "==")])
    with pytest.raises(IndexError):
        base.cross_join(r, ["x"])
    with pytest.raises(ValueError):
        base.inner_join(r, [])


def test_equi_join_is_no_nested_loop(base):
    plan = base.inner_join(right("R1"), [("x", "a", "==")]).to_spark()._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_inputs(base):
    none = base[F.col("x") > 100]
    assert none.group_by("y", {"x": sum}).rows == 0 and none.transform("y", {"x": sum}).rows == 0
    assert base.left_join(right("R1")[F.col("a") > 100], [("x", "a", "==")]).rows == 6
    assert none.inner_join(right("R1"), [("x", "a", "==")]).rows == 0
    assert none.union(base).rows == 6 and list(none.iterate_by("y")) == []


VALUES = st.lists(st.sampled_from([None, NAN, 0.0, -0.0, 1.0, 2.0]), min_size=1, max_size=5)


def holds(op, a, b):
    if op in ("==", "!="):
        same = a is None and b is None or a is not None and b is not None and a == b
        return same if op == "==" else not same
    if a is None or b is None or math.isnan(a) or math.isnan(b):
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left=VALUES, right=VALUES, op=st.sampled_from(["==", "!=", "<", "<=", ">", ">="]))
def test_join_rules(spark, left, right, op):
    make = lambda name, vs: Frame(spark.createDataFrame([(i, v) for i, v in enumerate(vs)], f"{name}i int, {name} double"))
    found = sorted(make("a", left).inner_join(make("b", right), [("a", "b", op)], ["ai", "bi"]).to_records())
    assert found == sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if holds(op, a, b))


def test_sums_and_counts_are_long(spark):
    t = Frame(spark.createDataFrame([("a", 2**31 - 1), ("a", 2**31 - 1)], "k string, v int"))
    (row,) = t.group_by("k", {"v": sum, "n": (len, "v"), "p": (np.prod, "v")}).to_spark().collect()
    assert row.v == 2**32 - 2 and row.n == 2


def test_joins_without_equality_are_bounded(spark, monkeypatch):
    from loomframe.operators import relational

    monkeypatch.setattr(relational, "MOST_COMPARED", 3)
    few, many = (Frame(spark.range(n).toDF(c)) for n, c in ((3, "a"), (9, "b")))
    assert few.inner_join(many, [("a", "b", "<")]).rows == many.inner_join(few, [("b", "a", ">")]).rows == 8 + 7 + 6
    assert many.left_join(few, [("b", "a", "<")]).rows == 2 + 1 + 7
    for join in (lambda: many.inner_join(Frame(spark.range(9).toDF("a")), [("b", "a", "<")]), lambda: few.left_join(many, [("a", "b", "<")])):
        with pytest.raises(ValueError):
            join()
