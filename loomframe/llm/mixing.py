"""Mixing sources to target weights by a time-varying curriculum; DataFrame functions only.

Each source has a weight and a schedule: how its share of the mix changes over training time 0 to 1.
Targets: the total size is shared by weight; a source is read at most ``max_epochs`` times, and what it
can't give is shared again by weight. A source's documents queue up in hash order, and the queue is read
again until the target is met, the last document in part. The integral of the schedule is the source's
cumulative demand; inverting it turns a place in the queue into a training position, by which the mix is
range-sorted.

Scale: the running sum of a source never meets in one task. Documents are dealt by (source, hash bucket);
bucket totals are summed first, so a task only orders one bucket, however hot the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, no_reserved, scratch, word_count

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: By weight class: (training time, relative share) knots, linear between; each integrates to 1.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hash buckets a source: hexadecimal digits of the order hash.
BUCKET_DIGITS = 3


def segments(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(start, demand before, share at start, slope, demand at end) of each linear piece, scaled to a demand of 1.

    Raises ValueError unless times rise from 0 to 1 and shares aren't negative, with some share above 0.
    """
    times, shares = zip(*schedule, strict=True)
    if times[0] != 0 or times[-1] != 1 or any(b <= a for a, b in zip(times, times[1:], strict=False)) or min(shares) < 0:
        raise ValueError("a schedule has times rising from 0 to 1 and shares of 0 or more")
    pieces = [(t, u, a, b) for (t, a), (u, b) in zip(schedule, schedule[1:], strict=False)]
    total = sum((u - t) * (a + b) / 2 for t, u, a, b in pieces)
    if total <= 0:
        raise ValueError("a schedule needs a share above 0")
    out, before = [], 0.0
    for t, u, a, b in pieces:
        after = before + (u - t) * (a + b) / 2 / total
        out.append((t, before, a / total, (b - a) / total / (u - t), after))
        before = after
    return out


def position(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Training time at which ``share`` of the source's tokens has been asked for."""
    out, pieces = None, segments(schedule)
    for k, (start, before, density, slope, after) in enumerate(pieces):
        if after <= before:
            continue
        left = F.greatest(share - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(density * density) + left * F.lit(2 * slope), F.lit(0.0)))
        here = F.lit(start) + left * F.lit(2.0) / (F.lit(density) + root)
        fits = F.lit(True) if k == len(pieces) - 1 else share <= F.lit(after)
        out = F.when(fits, here) if out is None else out.when(fits, here)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with class, weight and target; one row a source, the null source last."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("class", (F.row_number().over(rank) - 1) % F.lit(len(weights)))
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1).cast("long"))
    named = named.withColumn("cap", F.col("source_size") * F.lit(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = named.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    level = level.withColumn("full", F.col("level") >= F.col("ratio"))
    level = level.withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy()))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return level.select("source", "source_size", "class", "weight", F.round(target, 6).alias("target"))


def _keyed(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    order = F.md5(F.coalesce(doc.cast("string"), text, F.lit("")))
    return df.withColumns({"__lf_source": F.col(f"`{source_col}`"), "__lf_size": word_count(text), "__lf_order": order, "__lf_bucket": F.substring(order, 1, BUCKET_DIGITS)})


def _flat(source: Column) -> list[Column]:
    """Null-safe join keys for a source."""
    return [source.isNull(), F.coalesce(source, F.lit(""))]


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row a document: the columns ``keep``, and a struct ``__lf_mix`` of size, source_size, target, taken and
    before (the words that stand before it in its source's queue), wanted (the words its source gives), class.

    A document is known by its id, or by its text if the id is null; repeated rows queue one after the
    other. Null text has no words and is never taken; the null source is a source of its own, after all
    others. An empty table gives an empty result. Other columns do no harm, whatever their names.
    """
    keyed = _keyed(df, id_col, text_col, source_col).select(*[F.col(f"`{c}`") for c in keep], *[F.col(c) for c in ("__lf_source", "__lf_size", "__lf_order", "__lf_bucket")])
    with scratch(df.sparkSession) as stays:
        plan = stays(cut(_plan(keyed, weights, max_epochs), "mix-plan"))
    null, name = _flat(F.col("__lf_source"))
    local = keyed.withColumns({"__lf_null": null, "__lf_name": name})
    queue = Window.partitionBy("__lf_null", "__lf_name", "__lf_bucket").orderBy("__lf_order", "__lf_size").rowsBetween(Window.unboundedPreceding, -1)
    local = local.withColumn("__lf_local", F.coalesce(F.sum("__lf_size").over(queue), F.lit(0)))
    both = local.join(plan, (F.col("__lf_null") == F.col("b_null")) & (F.col("__lf_name") == F.col("b_source")) & (F.col("__lf_bucket") == F.col("b_bucket")))
    size, total, wanted = F.col("__lf_size"), F.col("source_size"), F.floor(F.col("target") + 0.5)
    before = F.col("b_before") + F.col("__lf_local")
    passes = F.when(total > 0, F.floor(wanted / total)).otherwise(0)
    taken = passes * size + F.least(F.greatest(wanted - passes * total - before, F.lit(0)), size)
    mixed = F.struct(size.alias("size"), total.alias("source_size"), F.col("target"), taken.cast("long").alias("taken"), before.cast("long").alias("before"), wanted.cast("long").alias("wanted"), F.col("class"))
    return both.select(*[F.col(f"`{c}`") for c in keep], mixed.alias("__lf_mix"))


def _plan(keyed: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """For each bucket of a source: the words before it, and its source's size, class and target."""
    counts = cut(keyed.groupBy("__lf_source", "__lf_bucket").agg(F.sum("__lf_size").alias("words")), "mix-buckets")
    per_source = targets(counts.groupBy(F.col("__lf_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, max_epochs)
    by_bucket = Window.partitionBy("b_null", "b_source").orderBy("b_bucket").rowsBetween(Window.unboundedPreceding, -1)
    null, name = _flat(F.col("__lf_source"))
    buckets = counts.select(null.alias("b_null"), name.alias("b_source"), F.col("__lf_bucket").alias("b_bucket"), "words")
    buckets = buckets.select("b_null", "b_source", "b_bucket", F.coalesce(F.sum("words").over(by_bucket), F.lit(0)).alias("b_before"))
    null, name = _flat(F.col("source"))
    per_source = per_source.select(null.alias("s_null"), name.alias("s_source"), "source_size", "class", "target")
    plan = buckets.join(per_source, (F.col("b_null") == F.col("s_null")) & (F.col("b_source") == F.col("s_source")))
    return plan.select("b_null", "b_source", "b_bucket", "b_before", "source_size", "class", "target")


def _place(words_before: Column, schedules: Sequence[Sequence[tuple[float, float]]]) -> Column:
    share = F.when(F.col("__lf_mix.wanted") > 0, words_before / F.col("__lf_mix.wanted")).otherwise(F.lit(1.0))
    out = None
    for k, schedule in enumerate(schedules):
        here = position(share, schedule)
        out = F.when(F.col("__lf_mix.class") == k, here) if out is None else out.when(F.col("__lf_mix.class") == k, here)
    return F.round(out, 9)


def mixed_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """doc_id, size, source_size, target, taken and position (training time of the first copy; null if none is
    taken), range-sorted by position. Rules for odd rows: see mix()."""
    rows = mix(df, id_col, text_col, source_col, weights, max_epochs, schedules, keep=[id_col])
    at = F.when(F.col("__lf_mix.taken") > 0, _place(F.col("__lf_mix.before"), schedules))
    out = rows.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"__lf_mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")], at.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken, range-sorted by training position.

    Documents stay whole: a last copy of which at least half the words are taken counts as one, else as none. Null texts and
    texts without words are never taken. Repeated rows queue one after the other; rows at one position are ordered by
    id. A null id is mixed like any other. An empty table stays empty. Raises ValueError if a column's name begins with ``__lf_``.
    """
    no_reserved(df)
    rows = mix(df, id_col, text_col, source_col, weights, max_epochs, schedules, keep=df.columns)
    copies = F.when(F.col("__lf_mix.size") > 0, F.floor(F.col("__lf_mix.taken") / F.col("__lf_mix.size") + 0.5)).otherwise(0).cast("int")
    each = rows.withColumn("__lf_copies", copies).filter("__lf_copies > 0")
    each = each.withColumn("__lf_copy", F.explode(F.sequence(F.lit(0), F.col("__lf_copies") - 1)))
    at = _place(F.col("__lf_mix.before") + F.col("__lf_copy") * F.col("__lf_mix.source_size"), schedules)
    return each.withColumn("__lf_at", at).orderBy("__lf_at", F.col(f"`{id_col}`")).select(*[F.col(f"`{c}`") for c in df.columns])


#: DuckDB SQL for mixed_sizes() over ``documents``.
ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, text, '')) as ord
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, (row_number() over (order by source asc nulls last) - 1) % 3 as class from s),
w as (select *, class + 1 as weight, source_size * 3 as cap, (source_size * 3)::double / (class + 1) as ratio from n),
l as (select *, ((sum(source_size) over ()) - coalesce(sum(cap) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0))::double
        / (sum(weight) over (order by ratio, source asc nulls last rows between current row and unbounded following))::double as level from w),
t as (select source, source_size, class,
        round(case when level >= ratio then cap::double else (max(case when level < ratio then level end) over ()) * weight end, 6) as target from l),
q as (select d.doc_id, d.size, t.source_size, t.class, t.target, floor(t.target + 0.5)::bigint as wanted,
        coalesce(sum(d.size) over (partition by d.source order by d.ord, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from d join t on d.source is not distinct from t.source),
k as (select *, case when source_size > 0 then wanted // source_size else 0 end as passes from q),
a as (select *, (passes * size + least(greatest(wanted - passes * source_size - before, 0), size))::bigint as taken,
        case when wanted > 0 then before::double / wanted else 1.0 end as u from k)
select doc_id, size, source_size, target, taken,
  case when taken > 0 then round(least(greatest(
    case class
      when 0 then case when u <= 0.625 then 0.0 + greatest(u - 0.0, 0.0) * 2.0 / (1.5 + sqrt(greatest(2.25 + greatest(u - 0.0, 0.0) * -2.0, 0.0)))
                  else 0.5 + greatest(u - 0.625, 0.0) * 2.0 / (1.0 + sqrt(greatest(1.0 + greatest(u - 0.625, 0.0) * -2.0, 0.0))) end
      when 1 then u
      else case when u <= 0.375 then 0.0 + greatest(u, 0.0) * 2.0 / (0.5 + sqrt(greatest(0.25 + greatest(u, 0.0) * 2.0, 0.0)))
                else 0.5 + greatest(u - 0.375, 0.0) * 2.0 / (1.0 + sqrt(greatest(1.0 + greatest(u - 0.375, 0.0) * 2.0, 0.0))) end
    end, 0.0), 1.0), 9) end as position
from a
"""
