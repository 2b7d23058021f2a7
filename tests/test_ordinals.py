import pytest
from pyspark.sql import functions as F

from loomframe.plans import ordinals


@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_positions(spark, rows, monkeypatch):
    monkeypatch.setattr(ordinals, "RANGE_ROWS", max(1, rows // 4))
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k"), F.lit("x").alias("v")).withColumn("n", F.when(F.col("k") % 7 > 0, F.col("k")))
    for order, key in ((["k"], lambda r: r.k), ([F.col("k").desc()] if rows == 10_000 else ["n", "k"], lambda r: -r.k if rows == 10_000 else (r.n is not None, r.n or 0, r.k))):
        found = sorted(ordinals.with_ordinals(df, order, "p").collect(), key=lambda r: r.p)
        assert [r.p for r in found] == list(range(100)) and found == sorted(found, key=key)


def test_scan_order(spark):
    assert sorted(r.p for r in ordinals.with_ordinals(spark.range(50).repartition(4), [], "p").collect()) == list(range(50))
