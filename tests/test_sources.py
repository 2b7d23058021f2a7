"""CSV inference and the DB-API adapter."""

import pytest

from loomframe import Frame


def put(tmp_path, text):
    (tmp_path / "t.csv").write_text(text)
    return tmp_path / "t.csv"


def test_plain_types(spark, tmp_path):
    t = Frame.read_csv(put(tmp_path, "a,b,c\n1,true,1.5\n2,no,\n3000000000,T,1e3\n"))
    assert t.dtypes == {"a": "int64", "b": "bool", "c": "float64"}
    assert list(t.to_records()) == [(1, True, 1.5), (2, False, None), (3000000000, True, 1000.0)]
    assert Frame.read_csv(put(tmp_path, "a\n1\n2\n")).dtypes == {"a": "int32"}


def test_duplicate_header_and_late_promotion(spark, tmp_path):
    t = Frame.read_csv(put(tmp_path, "a,b,b\n1,true,1.1\n2,false,2.2\n3,false,3\n4,true,4\n5,false,5\n6,jimmy,6\n"), guess_rows=2)
    assert t.dtypes == {"a": "int32", "b": "str", "b (2)": "float64"}
    assert t.to_list(["b"], inner=True) == [["true", "false", "false", "true", "false", "jimmy"]]
    assert Frame.read_csv(put(tmp_path, "a,b\n1,x\n"), dtypes={"a": "float32"}).dtypes["a"] == "float32"


def test_ragged_rows(spark, tmp_path):
    for text in ("a,b,c\n1,2,3\n4,5\n", "a,b\n1,2\n3,4,5\n"):
        with pytest.raises(ValueError):
            Frame.read_csv(put(tmp_path, text))


def test_numbers_in_other_forms(spark, tmp_path):
    t = Frame.read_csv(put(tmp_path, "a,b,c\n1_000, 2 ,nan\n7,3,inf\n"))
    assert t.dtypes == {"a": "int32", "b": "int32", "c": "float64"}
    assert t.to_list(["a", "b"], inner=True) == [[1000, 7], [2, 3]]


def test_missing(spark, tmp_path):
    path = put(tmp_path, "a,b\n1,\n,x\n")
    assert list(Frame.read_csv(path).to_records()) == [(1, None), (None, "x")]
    t = Frame.read_csv(path, missing=None)
    assert list(t.to_records()) == [("1", ""), ("", "x")]
    assert list(Frame.read_csv(put(tmp_path, "a,b\n1,NA\n2,3\n"), missing="NA").to_records()) == [(1, None), (2, 3)]
    assert Frame.read_csv(put(tmp_path, "a,b\n1,\n2,\n")).dtypes["b"] == "float64"


def test_quotes(spark, tmp_path):
    t = Frame.read_csv(put(tmp_path, 'a,"b,c"\n1,"x ""y"", z"\n'))
    assert t.columns == ("a", "b,c") and list(t.to_records()) == [(1, 'x "y", z')]
    t = Frame.read_csv(put(tmp_path, 'a,b\n1,"two\nlines"\n'), multi_line=True)
    assert list(t.to_records()) == [(1, "two\nlines")]


class Cursor:
    description = (("Fruit", str, None), ("Amount", int, None), ("Price", float, None))

    def __init__(self, rows):
        self.rows = list(rows)

    def execute(self, sql):
        self.sql = sql

    def fetchone(self):
        return self.rows.pop(0) if self.rows else None

    def fetchmany(self, n):
        out, self.rows = self.rows[:n], self.rows[n:]
        return out

    def fetchall(self):
        return self.fetchmany(len(self.rows))


ROWS = [("Apples", 5, 0.95), ("Pears", 2, 0.80)]


def test_cursor(spark):
    t = Frame.read_sql("select", Cursor(ROWS))
    assert t.dtypes == {"Fruit": "str", "Amount": "int64", "Price": "float64"} and list(t.to_records()) == ROWS
    assert Frame.read_sql("select", Cursor([])).rows == 0
    assert [c.rows for c in Frame.read_sql_chunks("select", Cursor(ROWS * 3), chunksize=4)] == [4, 2]
    assert [c.rows for c in Frame.read_sql_chunks("select", Cursor([]))] == [0]


class Typed(Cursor):
    """Column b's type isn't told; a is told to be float."""

    description = (("a", float, None), ("b", None, None))


def joined(parts):
    out = next(parts)
    for part in parts:
        out = out.union(part)
    return out


@pytest.mark.parametrize("chunksize", [300, 3])
def test_union_of_many_chunks_is_one_plan(spark, chunksize):
    """A loop over chunks runs no job, and neither partitions nor the plan's depth grow with the number of chunks."""
    rows = [(f"f{i}", i, i / 4) for i in range(7001)]
    sc = spark.sparkContext
    sc.setJobGroup("chunks", "union of chunks")
    try:
        out = joined(Frame.read_sql_chunks("select", Cursor(rows), chunksize=chunksize))
        assert not sc.statusTracker().getJobIdsForGroup("chunks")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    assert list(out.to_records()) == rows and list(out[6998:].to_records()) == rows[6998:]
    assert out.to_spark().rdd.getNumPartitions() <= sc.defaultParallelism
    assert "Union" not in out._df._jdf.queryExecution().toString()


def test_union_of_chunks_whose_values_differ_in_type(spark):
    """Told types hold whatever a chunk's values are, in the rows' order; where none is told, other types are refused."""
    rows = [(None, "x"), (1, "y"), (2.5, "z"), (None, None), (4, "u"), (None, "v")]
    parts = list(Frame.read_sql_chunks("select", Typed([r for r in rows if r[1]]), chunksize=1))
    first, second = parts[0].union(parts[1]), parts[0].union(parts[2])
    assert list(first.to_records()) == [(None, "x"), (1.0, "y")] and list(second.to_records()) == [(None, "x"), (2.5, "z")]
    both = second.union(first.union(parts[3]))
    assert both.dtypes == {"a": "float64", "b": "str"}
    assert list(both.to_records()) == [(None, "x"), (2.5, "z"), (None, "x"), (1.0, "y"), (4.0, "u")]
    assert list(joined(Frame.read_sql_chunks("select", Typed(rows), chunksize=1)).to_records()) == rows
    first.union_inplace(parts[4])
    assert first.rows == 3 and parts[0].rows == 1
    with pytest.raises(TypeError):
        joined(Frame.read_sql_chunks("select", Typed([(1.0, "x"), (2.0, 7)]), chunksize=1))


def test_views(spark):
    spark.range(7).createOrReplaceTempView("seven")
    assert Frame.read_sql("select * from seven where id > 2").rows == 4
    assert [c.rows for c in Frame.read_sql_chunks("select * from seven", chunksize=3)] == [3, 3, 1]
