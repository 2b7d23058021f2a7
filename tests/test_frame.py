"""Columns, rows, order and conversions, on small hand-made frames."""

import datetime as dt
import io
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe import Frame, object_formatter, to_field_name


@pytest.fixture
def base(spark):
    return Frame({"x": np.array([1, 2, 3, 4, 5, 6]), "y": np.array(["one", "two"] * 3, dtype=object), "z": np.array([0, 0, 0, 1, 1, 1])})


def xs(frame):
    return frame.to_list(["x"], inner=True)[0]


def test_properties(base):
    assert base.columns == ("x", "y", "z")
    assert base.dtypes == {"x": "int64", "y": "str", "z": "int64"}
    assert (base.rows, len(base), base.shape, base.size, base.ndim) == (6, 6, (6, 3), 18, 3)
    assert list(base.keys()) == ["x", "y", "z"] and base.get("no", 7) == 7 and len(base.items()) == 3
    for name in ("columns", "rows", "data", "dtypes", "size", "ndim", "shape"):
        with pytest.raises(ValueError):
            setattr(base, name, 1)


@pytest.mark.parametrize(
    "data",
    [
        {"x": [1, 2]},
        (("x", np.arange(2)),),
        [["x", np.arange(2)]],
        [(np.array("x"), np.arange(2))],
        [(np.array(["x"]), np.arange(2))],
        [{"x": np.arange(2)}, {"y": [1.0, None]}],
        iter([{"x": np.arange(2)}, ("y", ["a", "b"])]),
        enumerate(np.arange(2)),
    ],
)
def test_constructor_grammar(spark, data):
    assert Frame(data).rows in (1, 2)


def test_constructor_values(spark):
    assert Frame({"x": Decimal("1.23456")}).dtypes == {"x": "float64"}
    assert Frame({"x": "test"}).to_list(inner=True) == [["test"]]
    assert Frame({"x": None}).to_list(inner=True) == [[None]]
    assert Frame({"x": [True, False]}).dtypes == {"x": "bool"}
    assert Frame({"x": np.arange(6).astype("datetime64[D]")}).dtypes == {"x": "date"}
    assert Frame({"x": [1, "a"]}).dtypes == {"x": "str"}
    given = {1: [1], "a": [2]}
    assert Frame(given).columns == ("a", "1") and list(given) == [1, "a"]
    assert Frame({"x": ["1", ""]}, dtypes={"x": "float64"}).to_list(["x"])[0][0] == 1.0


@pytest.mark.parametrize("data, error", [({}, ValueError), ([{1, 2}], TypeError), (np.arange(6), TypeError), (3, TypeError), ({"x": [1, 2], "y": [1.0, 2.0, 3.0]}, ValueError), ({"x": np.ones((2, 2))}, TypeError)])
def test_constructor_errors(spark, data, error):
    with pytest.raises(error):
        Frame(data)


def test_as_frame(base):
    assert Frame.as_frame(base) is base
    for other in (pd.DataFrame({"x": [1]}), pd.Series([1], name="x"), {"x": [1]}, pa.table({"x": [1]}), base.to_spark()):
        assert "x" in Frame.as_frame(other).columns
    with pytest.raises(TypeError):
        Frame.as_frame(np.arange(3))


def test_records(spark):
    with pytest.raises(ValueError):
        Frame.from_records([], ["a"])
    t = Frame.from_records([("a", 1), ("b", 2)], ["n", "v"], {"v": "int32"})
    assert t.dtypes == {"n": "str", "v": "int32"}
    t = Frame({"d": [dt.date(2020, 1, 1)], "t": [dt.datetime(2020, 1, 2, 3, 4, 5)], "f": [float("nan")], "s": np.array([None], dtype=object)})
    assert list(t.to_records()) == [("2020-01-01", "2020-01-02T03:04:05", None, None)]
    assert np.isnan(next(t.to_records(["f"], cast_null=False))[0])


def test_sinks(base, tmp_path):
    assert xs(base) == [1, 2, 3, 4, 5, 6]
    assert base.to_tuple(["z", "x"], inner=True)._fields == ("z", "x")
    assert type(base.to_tuple(name=None)) is tuple
    assert base.to_array().shape == (6, 3)
    assert list(base.to_pandas(["z", "x"]).columns) == ["x", "z"]
    out = io.StringIO()
    base.to_csv(out, ["z", "x"])
    assert out.getvalue().splitlines()[:2] == ["z,x", "0,1"]
    base.to_csv(tmp_path / "a.csv")
    assert Frame.read_csv(tmp_path / "a.csv").rows == 6
    base.to_csv(tmp_path / "many", single_file=False)
    assert Frame.read_csv(tmp_path / "many").rows == 6
    with pytest.raises(TypeError):
        base.to_csv(3)


def test_filters_and_positions(base):
    assert xs(base[base["y"] == "one"]) == [1, 3, 5]
    assert xs(base[base["y"] == "one"][F.col("z") == 0]) == [1, 3]
    assert xs(base[np.array([True, False, True, True, False, True])]) == [1, 3, 4, 6]
    assert xs(base[[True, False, True, True, False, True]]) == [1, 3, 4, 6]
    assert xs(base[np.array([5, 0, 0])]) == [6, 1, 1]
    assert xs(base[[1, 3]]) == [2, 4] and xs(base[[True, 2]]) == [2, 3]
    assert xs(base[2]) == [3] and xs(base[-1]) == [6]
    assert xs(base.head(2)) == [1, 2] and xs(base.head(-4)) == [1, 2]
    assert base[["x", "z"]].columns == ("x", "z")


@pytest.mark.parametrize("key", [slice(None, 3), slice(1, None), slice(None, None, 2), slice(-2, None), slice(None, -2), slice(None, None, -1), slice(4, 0, -2), slice(10, 20), slice(-100, 2)])
def test_slices(base, key):
    assert xs(base[key]) == [1, 2, 3, 4, 5, 6][key]


@pytest.mark.parametrize("key, error", [(np.ones((2, 2), bool), IndexError), ((1, 2), IndexError), ([1.5], IndexError), (1.5, TypeError), ({}, TypeError), ("no", ValueError), (["no"], ValueError), (99, IndexError), (np.array([9]), IndexError), (np.array([True]), IndexError)])
def test_index_errors(base, key, error):
    with pytest.raises(error):
        base[key]


def test_set_columns(base):
    base["w"] = base["x"] * 2
    base["c"] = "k"
    base["v"] = np.array([6, 5, 4, 3, 2, 1])
    assert base.to_list(["w", "v"], inner=True) == [[2, 4, 6, 8, 10, 12], [6, 5, 4, 3, 2, 1]]
    with pytest.raises(ValueError):
        base["bad"] = [1, 2]
    with pytest.raises(TypeError):
        base["bad"] = np.ones((6, 6))


def test_columns(base):
    assert base.rename({"x": "a"}).columns == ("a", "y", "z")
    assert base.delete(["x", "z"]).columns == ("y",)
    for bad in (lambda: base.rename({"no": "a"}), lambda: base.delete("no"), lambda: base.select("no"), lambda: base.update_dtypes({"no": "int32"})):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        base.update_dtypes({"x": "no such"})
    other = base.copy()
    assert other.rename_inplace({"x": "a"}) is None and other.columns[0] == "a" and base.columns[0] == "x"
    other.delete_inplace("a")
    other.update_dtypes_inplace({"z": "float64"})
    assert other.dtypes == {"y": "str", "z": "float64"}
    base.update_inplace(Frame({"x": [9, 8, 7, 6, 5, 4], "n": list("abcdef")}))
    assert xs(base) == [9, 8, 7, 6, 5, 4] and base.columns == ("x", "y", "z", "n")
    with pytest.raises(ValueError):
        base.update(Frame({"x": [1, 2]}))


def test_coalesce(spark):
    x = Frame({"x": [1, 2, None, 4, None]})
    fills = [[1, 2, 3, None, 5], [None, None, None, None, "five"]]
    assert list(x.coalesce("x", fills)) == ["1", "2", "3", "4", "5"] or [float(v) for v in x.coalesce("x", fills)] == [1, 2, 3, 4, 5]
    y = list(x.coalesce("y", fills))
    assert y[3] is None and [float(v) for v in y[:3]] == [1, 2, 3]
    n = Frame({"x": [1.0, float("nan")]})
    n.coalesce_inplace("x", [-1.0])
    assert xs(n) == [1.0, -1.0]
    assert list(Frame({"x": np.array([None], dtype=object)}).coalesce("x", [[1], [None]])) in ([1], ["1"])


def test_union(base):
    both = base.union(base)
    assert xs(both) == [1, 2, 3, 4, 5, 6] * 2
    base.union_inplace(base.copy())
    assert base.rows == 12
    t = Frame({"x": [1]})
    with pytest.raises(ValueError):
        t.union(base)
    with pytest.raises(TypeError):
        t.union(Frame({"y": [1]}))
    with pytest.raises(TypeError):
        t.union(Frame({"x": [1.0]}))


def test_maps(base):
    assert [r.to_list(["x"], inner=True)[0][0] for r in base.head(2)] == [1, 2]
    assert list(base.row_map(lambda r, k: xs(r)[0] * k, 2))[:2] == [2, 4]
    assert [t.x for t in base.itertuples()] == [1, 2, 3, 4, 5, 6]
    assert list(base.tuple_map(lambda t: t[0], name=None))[0] == 1
    assert [len(v) for v in base.col_map(np.unique)] == [6, 2, 2]
    assert Frame(base.key_map(np.repeat, repeats=6)).rows == 36
    assert (base >> (lambda f: f.rows)) == 6 and base.pipe(lambda f, k: k, 3) == 3
    assert base.map_rows(lambda p: p[["x"]] + 1, "x long").rows == 6


def test_text(base):
    assert "x: int64" in repr(base) == str(base) or "x: int64" in repr(base)
    assert base.pformat().startswith("Frame(") and "'one'" in base.pformat()
    html = Frame({"a": ["<b>"]}).to_html()
    assert "&lt;b&gt;" in html and "<b>" not in html and base._repr_html_().count("<tr>") == 8


def test_formatter(spark):
    before = object_formatter.copy()
    try:
        object_formatter["str"] = lambda c: F.upper(c)
        assert Frame({"a": ["x"]}).to_list(inner=True) == [["X"]]
        with pytest.raises(ValueError):
            object_formatter["str"] = lambda c: 3
        assert "Decimal" in object_formatter and len(object_formatter) == 2 and "str" in str(object_formatter)
        del object_formatter["str"]
    finally:
        assert list(object_formatter) == list(before)


def test_field_names():
    assert [to_field_name(x) for x in ("a b-1", "1a", "12", "_x")] == ["ab1", "a", "field_12", "x"]
