"""Every table query against its DuckDB SQL at the smallest scale."""

import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loomframe.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(rows):
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = plain(df.select(*columns).collect())
    if name not in catalog.ORACLES:
        assert found
        return
    out = duck.sql(catalog.ORACLES[name])
    assert sorted(out.columns) == columns
    assert found == plain(out.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_operators():
    """Whatever the subpackage lacks, the other queries work."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; from loomframe.plans import catalog; assert e.queries() == catalog.QUERIES and e.oracle_sql() == catalog.ORACLES"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


def test_pushdown_and_partial_aggregation(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(l_quantity,4.0)" in plan("filter_mask")
    assert "partial_sum" in plan("group_by_sum_len") and "ReadSchema: struct<l_linenumber:int,l_returnflag:string,l_linestatus:string>" in plan("group_by_sum_len")
    assert "Python" not in plan("transform") and "Window" not in plan("transform")
