"""The registered queries of the table operators, and the same in DuckDB SQL."""

from __future__ import annotations

import atexit
import csv
import io
import shutil
import sqlite3
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions.names import field_name_column
from ..types import as_record

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str, order_by: str = "") -> Frame:
    return Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), order_by=order_by or ())


def query(sql: str | None):
    def register(fn: Callable[[Callable[..., Frame]], Frame | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(lambda name, order_by="": table(spark, sf_dir, name, order_by))
            return out.to_spark() if isinstance(out, Frame) else out

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _folder(spark: SparkSession) -> str:
    """The shared folder; where none is set, as in tests, a temporary one that goes with the process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="loomframe-csv-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


# ---- columns


@query("select c_custkey, c_name from customer")
def select(t):
    return t("customer").select(["c_custkey", "c_name"])


@query("select o_orderkey, o_totalprice, 'x' as tag, o_totalprice * 2 as twice from orders")
def set_columns(t):
    out = t("orders").select(["o_orderkey", "o_totalprice"])
    out["tag"] = "x"
    out["twice"] = out["o_totalprice"] * 2
    return out


@query("select r_name as a from region")
def rename_delete(t):
    return t("region").rename({"r_name": "a"}).delete("r_regionkey")


@query("select o_orderkey, o_totalprice * 2 as o_totalprice, o_custkey from orders")
def update_overlay(t):
    base = t("orders", "o_orderkey").select(["o_orderkey", "o_totalprice", "o_custkey"])
    other = t("orders", "o_orderkey").select(["o_orderkey", "o_totalprice"])
    other["o_totalprice"] = other["o_totalprice"] * 2
    return base.update(other)


@query("select l_orderkey, cast(trunc(l_quantity) as integer) as l_quantity, cast(l_linenumber as double) as l_linenumber from lineitem")
def update_dtypes(t):
    return t("lineitem").select(["l_orderkey", "l_quantity", "l_linenumber"]).update_dtypes({"l_quantity": "int32", "l_linenumber": float})


@query("select d.doc_id, coalesce(quality, -1) as quality, toxic from documents d left join labels l on d.doc_id = l.doc_id")
def coalesce_nulls(t):
    out = t("documents").left_join(t("labels"), [("doc_id", "doc_id", "==")], ["doc_id", "quality", "toxic"])
    out.coalesce_inplace("quality", [-1])
    return out


@query("select o_orderkey, coalesce(case when o_totalprice > 200000 then 'nan'::double end, -1.0) as v from orders where o_totalprice <= 200000 union all select o_orderkey, -1.0 as v from orders where o_totalprice > 200000")
def coalesce_nan(t):
    out = t("orders").select(["o_orderkey", "o_totalprice"])
    out["v"] = F.when(out["o_totalprice"] > 200000, F.lit(float("nan")))
    out.coalesce_inplace("v", [-1.0])
    return out.select(["o_orderkey", "v"])


@query("select p_partkey, case when regexp_replace(regexp_replace(p_name, '[^0-9a-zA-Z]', '', 'g'), '^[^a-zA-Z]+', '') = '' then 'field_' || p_name else regexp_replace(regexp_replace(p_name, '[^0-9a-zA-Z]', '', 'g'), '^[^a-zA-Z]+', '') end as f from part")
def field_name(t):
    return t("part").to_spark().select("p_partkey", field_name_column(F.col("p_name")).alias("f"))


# ---- rows


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity <= 4 and l_returnflag = 'R'")
def filter_mask(t):
    li = t("lineitem")
    return li[(li["l_quantity"] <= 4) & (li["l_returnflag"] == "R")].select(["l_orderkey", "l_linenumber", "l_quantity"])


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 5")
def head(t):
    return t("orders", "o_orderkey").select(["o_orderkey", "o_totalprice"]).head(5)


@query("select r_regionkey, r_name from region order by r_regionkey limit (select count(*) - 2 from region)")
def head_negative(t):
    return t("region", "r_regionkey").select(["r_regionkey", "r_name"]).head(-2)


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) where i >= 10 and i < 100 and (i - 10) % 3 = 0")
def slice_step(t):
    return t("orders", "o_orderkey").select(["o_orderkey"])[10:100:3]


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey desc) as k from orders) where k <= 7")
def slice_negative(t):
    return t("orders", "o_orderkey").select(["o_orderkey"])[-7:]


@query("select o_orderkey, o_custkey from (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as i from orders) where i = 17")
def row_at(t):
    return t("orders", "o_orderkey").select(["o_orderkey", "o_custkey"])[17]


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) join (select unnest([5, 3, 3, 11]) as p) on i = p")
def gather(t):
    return t("orders", "o_orderkey").select(["o_orderkey"])[np.array([5, 3, 3, 11])]


@query("select r_regionkey, r_name from (select *, row_number() over (order by r_regionkey) - 1 as i from region) where i in (0, 2, 3)")
def mask_list(t):
    regions = t("region", "r_regionkey").select(["r_regionkey", "r_name"])
    return regions[[k in (0, 2, 3) for k in range(regions.rows)]]


# ---- aggregation


@query("select l_returnflag, l_linestatus, cast(sum(l_linenumber) as bigint) as l_linenumber, count(*) as count from lineitem group by all")
def group_by_sum_len(t):
    return t("lineitem").group_by(["l_returnflag", "l_linestatus"], {"l_linenumber": sum, "count": (len, "l_returnflag")})


@query("select l_returnflag, cast(trunc(avg(l_linenumber)) as integer) as l_linenumber from lineitem group by 1")
def group_by_mean_dtype(t):
    return t("lineitem").group_by("l_returnflag", {"l_linenumber": np.mean})


@query("select l_returnflag, round(avg(l_linenumber), 9) as m, round(stddev_pop(l_quantity), 6) as s, round(var_pop(l_quantity), 6) as v, median(l_quantity) as md from lineitem group by 1")
def group_by_statistics(t):
    out = t("lineitem").group_by("l_returnflag", {"m": (np.mean, "l_linenumber"), "s": (np.std, "l_quantity"), "v": (np.var, "l_quantity"), "md": (np.median, "l_quantity")}, preserve_dtype=False)
    for name, digits in (("m", 9), ("s", 6), ("v", 6)):
        out[name] = F.round(out[name], digits)
    return out


@query("select l_returnflag, max(l_quantity) as mx, min(l_quantity) as mn from lineitem group by 1")
def group_by_rename(t):
    return t("lineitem").group_by(["l_returnflag"], {"mx": (np.max, "l_quantity"), "mn": (np.min, "l_quantity")})


@query("select o_orderstatus, bool_or(o_totalprice > 100000) as some, bool_and(o_totalprice > 100) as every from orders group by 1")
def group_by_any_all(t):
    orders = t("orders").select(["o_orderstatus", "o_totalprice"])
    orders["some"] = orders["o_totalprice"] > 100000
    orders["every"] = orders["o_totalprice"] > 100
    return orders.group_by("o_orderstatus", {"some": any, "every": all})


@query("select l_returnflag, cast(max(l_linenumber) - min(l_linenumber) as integer) as spread, count(*) as n from lineitem group by 1")
def group_by_udaf(t):
    return t("lineitem").group_by("l_returnflag", {"spread": (lambda x: x.max() - x.min(), "l_linenumber"), "n": (len, "l_returnflag")})


@query("select distinct c_mktsegment, c_nationkey from customer")
def distinct(t):
    return t("customer").group_by(["c_mktsegment", "c_nationkey"])


@query("select event_type, row_number() over (order by f) - 1 as id, n from (select event_type, min(event_id) as f, count(*) as n from events group by 1)")
def group_id(t):
    return t("events", "event_id").group_by("event_type", {}, {"id": max, "n": len})


# ---- transform


@query("select l_returnflag, l_linestatus, sum(l_quantity) over w as sum_q, count(*) over w as cnt from lineitem window w as (partition by l_returnflag, l_linestatus)")
def transform(t):
    return t("lineitem").transform(["l_returnflag", "l_linestatus"], {"sum_q": (sum, "l_quantity"), "cnt": (len, "l_returnflag")})


@query("select user_id, cast(sum(event_id) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as cs from events")
def transform_cumsum(t):
    return t("events", "event_id").transform("user_id", {"cs": (np.cumsum, "event_id")})


@query("select o_orderstatus, o_orderkey - cast(min(o_orderkey) over (partition by o_orderstatus) as bigint) as off from orders")
def transform_vector(t):
    return t("orders", "o_orderkey").transform("o_orderstatus", {"off": (lambda x: x - x.min(), "o_orderkey")})


@query("select e.event_type, g.id from events e join (select event_type, row_number() over (order by f) - 1 as id from (select event_type, min(event_id) as f from events group by 1)) g on e.event_type = g.event_type")
def transform_group_id(t):
    return t("events", "event_id").transform("event_type", {}, {"id": max})


@query("select r_regionkey as key, r_name as name from region")
def iterate_by(t):
    out = None
    for key, _, part in t("region", "r_regionkey").iterate_by("r_regionkey"):
        own = part.select(["r_name"]).rename({"r_name": "name"})
        own["key"] = F.lit(key).cast("int")
        out = own if out is None else out.union(own)
    return out


@query("select o_orderpriority, count(*) as n, cast(max(o_custkey) as bigint) as top from orders group by 1")
def apply_groups(t):
    import pandas as pd

    return t("orders").apply_groups("o_orderpriority", lambda pdf: pd.DataFrame({"o_orderpriority": [pdf["o_orderpriority"].iloc[0]], "n": [len(pdf)], "top": [pdf["o_custkey"].max()]}), "o_orderpriority string, n long, top long")


# ---- joins and union


@query("select c_custkey, c_nationkey, n_nationkey, n_name from customer join nation on c_nationkey is not distinct from n_nationkey")
def inner_equi(t):
    return t("customer").inner_join(t("nation"), [("c_nationkey", "n_nationkey", "==")], ["c_custkey", "c_nationkey", "n_nationkey", "n_name"])


@query("select * from nation join region on n_regionkey <= r_regionkey")
def inner_theta(t):
    return t("nation").inner_join(t("region"), [("n_regionkey", "r_regionkey", "<=")])


@query("select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_acctbal < s_acctbal")
def inner_mixed(t):
    return t("customer").inner_join(t("supplier"), [("c_nationkey", "s_nationkey", "=="), ("c_acctbal", "s_acctbal", "<")], ["c_custkey", "s_suppkey"])


@query("select o_orderkey, l_linenumber, l_quantity from orders join lineitem on o_orderkey = l_orderkey")
def inner_large(t):
    return t("orders").inner_join(t("lineitem"), [("o_orderkey", "l_orderkey", "==")], ["o_orderkey", "l_linenumber", "l_quantity"])


@query("select c_custkey, o_orderkey, o_totalprice from customer left join orders on c_custkey = o_custkey")
def left_join(t):
    return t("customer").left_join(t("orders"), [("c_custkey", "o_custkey", "==")], ["c_custkey", "o_orderkey", "o_totalprice"])


@query("select r_name, n_name from region left join nation on r_regionkey <> n_regionkey")
def left_ne(t):
    return t("region").left_join(t("nation"), [("r_regionkey", "n_regionkey", "!=")], ["r_name", "n_name"])


@query("select r_name, n_name from region cross join nation")
def cross_join(t):
    return t("region").cross_join(t("nation"), ["r_name", "n_name"])


@query("select c_custkey from customer union all select c_custkey from customer")
def union(t):
    c = t("customer").select(["c_custkey"])
    return c.union(c)


# ---- functional and input/output


@query("select unnest(list_value(r_name, r_name, r_name, r_name, r_name, r_name)) as r_name from region")
def key_map_repeat(t):
    return t("region").select(["r_name"]).map_columns(lambda c, n: F.explode(F.array_repeat(c, n)), 6)


@query("select c_custkey, c_acctbal * 2 as c_acctbal from customer")
def map_rows(t):
    return t("customer").select(["c_custkey", "c_acctbal"]).map_rows(lambda pdf: pdf.assign(c_acctbal=pdf["c_acctbal"] * 2), "c_custkey long, c_acctbal double")


@query("select c_custkey from customer where c_acctbal > 0")
def pipe(t):
    return t("customer") >> (lambda f: f[f["c_acctbal"] > 0]) >> (lambda f: f.select("c_custkey"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as d from orders")
def record_dates(t):
    df = t("orders").to_spark()
    return df.select("o_orderkey", as_record(F.col("o_orderdate"), df.schema["o_orderdate"].dataType).alias("d"))


@query("select s_suppkey::int as s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def csv_round_trip(t):
    """Written as CSV by all executors, read again with inferred types."""
    supplier = t("supplier").select(["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    spark = supplier.to_spark().sparkSession
    path = f"{_folder(spark)}/csv-{np.random.default_rng().integers(1 << 62)}"
    supplier.to_csv(path, single_file=False)
    return Frame.read_csv(path, spark=spark)


@query("select r_regionkey, r_name from region order by r_regionkey")
def csv_single_file(t):
    """The driver's single-file writer, parsed again."""
    regions = t("region", "r_regionkey")
    out = io.StringIO()
    regions.to_csv(out, ["r_regionkey", "r_name"])
    rows = list(csv.reader(io.StringIO(out.getvalue())))
    return Frame.from_records(rows[1:], rows[0], {"r_regionkey": "int32"})


@query("select n_name, r_name from nation join region on n_regionkey = r_regionkey where r_name like 'A%'")
def read_sql(t):
    """A query over views of Spark's catalog."""
    t("nation").to_spark().createOrReplaceTempView("lf_nation")
    t("region").to_spark().createOrReplaceTempView("lf_region")
    return Frame.read_sql("select n_name, r_name from lf_nation join lf_region on n_regionkey = r_regionkey where r_name like 'A%'")


@query("select n_nationkey, n_name from nation")
def read_sql_chunks(t):
    """Chunks of a query, joined again."""
    t("nation").to_spark().createOrReplaceTempView("lf_nation")
    out = None
    for part in Frame.read_sql_chunks("select n_nationkey, n_name from lf_nation", chunksize=10):
        out = part if out is None else out.union(part)
    return out


@query("select n_nationkey, n_name from nation")
def from_records(t):
    rows = t("nation", "n_nationkey").to_records(["n_nationkey", "n_name"])
    return Frame.from_records(rows, ["n_nationkey", "n_name"], {"n_nationkey": "int32"})


@query("select r_regionkey, r_name from region")
def from_pandas(t):
    return Frame.from_dataframe(t("region", "r_regionkey").to_pandas())


@query("select c_mktsegment, cast(trunc(sum(c_acctbal)) as double) as total, count(*) as n from customer where c_acctbal > 0 group by 1")
def filter_group_chain(t):
    """Filter, group and cast in one lazy plan."""
    c = t("customer")
    out = c[c["c_acctbal"] > 0].group_by("c_mktsegment", {"total": (sum, "c_acctbal"), "n": (len, "c_mktsegment")})
    out["total"] = F.col("total").cast("long").cast("double")
    return out


@query("select o_orderpriority, cast(sum(o_totalprice > 150000) as double) / count(*) as share from orders group by 1")
def group_by_own_type(t):
    """An unknown callable whose result needn't have its column's type."""
    orders = t("orders").select(["o_orderpriority", "o_totalprice"])
    orders["big"] = F.col("o_totalprice").cast("long")
    return orders.group_by("o_orderpriority", {"share": (lambda x: float((x >= 150000).mean()), "big")}, preserve_dtype=False)


@query("select r_name, cast(product(n_regionkey + 1) as bigint) as p from region join nation on r_regionkey = n_regionkey group by 1")
def group_by_prod(t):
    both = t("region").inner_join(t("nation"), [("r_regionkey", "n_regionkey", "==")], ["r_name", "n_regionkey"])
    both["n_regionkey"] = both["n_regionkey"] + 1
    return both.group_by("r_name", {"p": (np.prod, "n_regionkey")})


@query("select unnest(list_value(r_name, r_name)) as r_name, unnest(list_value(r_regionkey, r_regionkey)) as r_regionkey from region")
def key_map(t):
    """A frame from what a function gives for each column's array."""
    return Frame(dict(t("region", "r_regionkey").select(["r_name", "r_regionkey"]).key_map(np.repeat, 2)), {"r_regionkey": "int32"})


@query("select 'r_regionkey' as name, max(r_regionkey)::bigint as top from region union all select 'n', max(length(r_name))::bigint from region")
def col_map(t):
    regions = t("region").select(["r_regionkey", "r_name"])
    regions["n"] = F.length(F.col("r_name"))
    regions = regions.select(["r_regionkey", "n"])
    return Frame.from_records(list(zip(regions.columns, regions.col_map(lambda a: int(a.max())))), ["name", "top"], {"top": "int64"})


@query("select r_regionkey * 10 + length(r_name) as v from region")
def tuple_map(t):
    out = t("region", "r_regionkey").select(["r_regionkey", "r_name"]).tuple_map(lambda r: (r.r_regionkey * 10 + len(r.r_name),))
    return Frame.from_records(list(out), ["v"], {"v": "int32"})


@query("select r_regionkey, r_name from region")
def row_map(t):
    rows = t("region", "r_regionkey").select(["r_regionkey", "r_name"]).row_map(lambda f: next(f.to_records()))
    return Frame.from_records(list(rows), ["r_regionkey", "r_name"], {"r_regionkey": "int32"})


@query("select n_nationkey, n_name from nation")
def itertuples(t):
    return Frame.from_records([tuple(r) for r in t("nation", "n_nationkey").select(["n_nationkey", "n_name"]).itertuples(None)], ["n_nationkey", "n_name"], {"n_nationkey": "int32"})


@query("select r_name, r_regionkey from region")
def itercols(t):
    return Frame(dict(t("region", "r_regionkey").select(["r_regionkey", "r_name"]).itercols()), {"r_regionkey": "int32"})


@query("select r_regionkey, r_name from region")
def to_list(t):
    keys, found = t("region", "r_regionkey").to_list(["r_regionkey", "r_name"], inner=True)
    return Frame.from_records(list(zip(keys, found)), ["r_regionkey", "r_name"], {"r_regionkey": "int32"})


@query("select r_regionkey, r_name from region")
def to_tuple(t):
    found = t("region", "r_regionkey").to_tuple(["r_regionkey", "r_name"], "Regions")
    return Frame({"r_regionkey": found.r_regionkey, "r_name": found.r_name}, {"r_regionkey": "int32"})


@query("select r_regionkey, r_name from region")
def to_array(t):
    return Frame.from_records([tuple(r) for r in t("region", "r_regionkey").to_array(["r_regionkey", "r_name"]).tolist()], ["r_regionkey", "r_name"], {"r_regionkey": "int32"})


@query("select n_name from nation")
def from_series(t):
    return Frame.from_series(t("nation", "n_nationkey").to_pandas("n_name")["n_name"])


@query("select r_regionkey, r_name from region")
def as_frame(t):
    return Frame.as_frame(t("region", "r_regionkey").to_pandas(["r_regionkey", "r_name"]))


@query("select s_name, s_acctbal from supplier where s_acctbal > 5000")
def read_cursor(t):
    """Rows of a query at another database, through its cursor."""
    cur = _loaded(t)
    return Frame.read_sql("select s_name, s_acctbal from supplier where s_acctbal > 5000", cur)


@query("select s_name, s_acctbal from supplier")
def read_cursor_chunks(t):
    out = None
    for part in Frame.read_sql_chunks("select s_name, s_acctbal from supplier", _loaded(t), 30):
        out = part if out is None else out.union(part)
    return out


def _loaded(t):
    cur = sqlite3.connect(":memory:").cursor()
    cur.execute("create table supplier (s_name text, s_acctbal real)")
    cur.executemany("insert into supplier values (?, ?)", list(t("supplier").to_records(["s_name", "s_acctbal"])))
    return cur


@query("""select * from (values (1, true, 1.5, 'x;y'), (null, false, null, 'say "hi"'), (3, null, 2.0, ' z')) v(a, b, "b (2)", d)""")
def csv_odd(t):
    """Bools, a repeated name, missing tokens and another separator."""
    spark = t("region").to_spark().sparkSession
    lines = ["a;b;b;d", '1;yes;1.5;"x;y"', '-;F;-;"say ""hi"""', "3;-;2.0; z"]
    path = f"{_folder(spark)}/csv-{np.random.default_rng().integers(1 << 62)}"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return Frame.read_csv(path, missing="-", delimiter=";", spark=spark)


@query("select r_regionkey, r_name from region union all select r_regionkey, r_name from region")
def union_inplace(t):
    out = t("region", "r_regionkey").select(["r_regionkey", "r_name"])
    out.union_inplace(out.copy())
    return out


@query("select count(*)::bigint as n_rows, 3::bigint as n_columns, 3 * count(*)::bigint as n_cells, 'r_comment' as missing from region")
def properties(t):
    regions = t("region")
    regions["twice"] = regions["r_regionkey"] * 2
    regions = regions.select(list(regions.keys()))
    return Frame.from_records([(*regions.shape, regions.size, regions.get("r_comment", "r_comment"))], ["n_rows", "n_columns", "n_cells", "missing"])


@query("select r_regionkey, r_name, upper(r_name) as u from region")
def set_array(t):
    """A column from a local array, by position."""
    regions = t("region", "r_regionkey").select(["r_regionkey", "r_name"])
    regions["u"] = np.array([n.upper() for n in regions.to_list("r_name", inner=True)[0]], dtype=object)
    return regions
