"""Row order: consecutive ordinals without a single task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The hidden column that holds the input order of frames made from local data.
RID = "__lf_rid"
#: Rows that one task may sort.
RANGE_ROWS = 1_000_000
#: Sampled keys for each range; so much is collected to find the ranges' bounds.
SAMPLED = 100
_LOCAL_BITS = 33


def with_ordinals(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with its rows' positions from 0 in ``order`` (the scan's order if that is empty), as the long ``name``.

    Rows fall into ranges of the order, between bounds found once from a sample and then written into the plan, so
    that every branch and every retry sees the same ranges. Each range is numbered by itself; what it begins
    with follows from the ranges' counts, one row each.
    """
    if order:
        keys = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
        at = df.withColumn("__lf_part", _range_of(df, keys))
        local = F.row_number().over(Window.partitionBy("__lf_part").orderBy(*keys)) - 1
    else:
        at = df.withColumn("__lf_at", F.monotonically_increasing_id()).withColumn("__lf_part", F.shiftright("__lf_at", _LOCAL_BITS))
        local = F.col("__lf_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    before = Window.orderBy("__lf_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy("__lf_part").agg(F.count(F.lit(1)).alias("__lf_n"))
    starts = counts.select("__lf_part", F.coalesce(F.sum("__lf_n").over(before), F.lit(0)).alias("__lf_start"))
    numbered = at.withColumn("__lf_local", local).join(F.broadcast(starts), "__lf_part")
    return numbered.withColumn(name, (F.col("__lf_start") + F.col("__lf_local")).cast("long")).drop("__lf_at", "__lf_part", "__lf_start", "__lf_local")


def _range_of(df: DataFrame, keys: Sequence[Column]) -> Column:
    rows = df.count()
    n = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS + 1)
    if n < 2:
        return F.lit(0)
    named = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    sample = named.sample(fraction=min(1.0, SAMPLED * n / rows), seed=7).distinct().orderBy(*named.columns).collect()
    kinds = [f.dataType for f in named.schema]
    bounds = [sample[len(sample) * k // n] for k in range(1, n)] if len(sample) >= n else sample[1:]
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(bounds[mid], kinds, strict=True))))
        return F.when(key < bound, search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def slice_condition(at: Column, rows: int | None, key: slice) -> tuple[Column, bool]:
    """Which positions a slice takes, and if in reverse. ``rows`` is needed for negative bounds or steps only."""
    if rows is None:
        start, stop, step = key.start or 0, key.stop, key.step or 1
    else:
        start, stop, step = key.indices(rows)
    if step > 0:
        cond = at >= start
        if stop is not None:
            cond = cond & (at < stop)
        if step > 1:
            cond = cond & ((at - start) % step == 0)
        return cond, False
    cond = (at <= start) & (at > stop)
    return (cond & ((F.lit(start) - at) % (-step) == 0) if step < -1 else cond), True


def needs_rows(key: slice) -> bool:
    return (key.start or 0) < 0 or (key.stop or 0) < 0 or (key.step or 1) < 0
