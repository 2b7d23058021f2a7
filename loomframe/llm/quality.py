"""Quality rules: base counts of each text, and robust multivariate outliers; DataFrame functions only.

Texts that pass the base rules become vectors of transformed statistics, rounded to a grid. For each language and source
the minimum-covariance-determinant estimate is found by concentration steps: from three deterministic starts, keep the
h rows with the least Mahalanobis distance, estimate mean and covariance from them, repeat until no determinant
falls, and take the start with the least one. A text is rejected if its distance from its group's estimate is beyond
a quantile of the distance's distribution, which depends on the group's size.

The subset has exactly h rows: of equal distances the lesser vector comes first, and of rows with the last vector as many
count as are needed. The covariance is scaled to be consistent at the normal distribution. Most texts have no symbols, repeated
lines or repeated words at all, so in many groups these don't vary within the subset, and one incident would be infinitely far
away. A variance below what STATISTICS states is singular in this sense and becomes that value; a greater one is left as it is.

Scale: rows are counted by (group, vector) in map tasks, so a group of any size becomes as many rows as it has distinct
vectors. Each step shuffles these once by group and start, and writes them, so that a lost executor costs one step; a group's
distinct vectors meet in one task. Sums are of whole numbers, so they don't depend on the order of rows. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, bind, cut, no_reserved, scratch, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: A text fails the base rules if more than this percentage of its words are in repeated windows.
MAX_REPEAT_PERCENT = 50

#: Statistic: steps of the grid in a unit of its transformed value, and the least standard deviation in that unit: for length and
#: word length what rounding makes, for the others a few incidents in a text. By itself a share of 22 % duplicate lines rejects.
STATISTICS = {"length": (8, 0.1), "word_length": (64, 0.02), "symbols": (16, 0.5), "dup_lines": (16, 0.3), "repeats": (16, 0.3)}
#: Share of rows that the least-determinant subset holds, in large groups; see subset_size().
SUBSET = 0.75
QUANTILE = 0.99999
#: The least rows for an estimate: twice the statistics. A smaller (language, source) has none, and only the base rules judge it.
MIN_GROUP = 2 * len(STATISTICS)
#: Group sizes for which factor and quantile are worked out one by one; larger ones in steps of an eighth of a doubling, up to a size
#: from which they are those of the limit.
EACH_SIZE, LIMIT_SIZE = 128, 1 << 17
#: Distinct vectors that a task of a concentration step works on, about.
STEP_ROWS = 100_000
#: Concentration steps after which something must be wrong: determinants only fall.
MAX_STEPS = 200
#: Most groups whose estimates are broadcast by hint: about 15 MB.
MAX_BROADCAST_GROUPS = 20_000


def chi2_cdf(x: float, p: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, p) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return high


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for k in range(1, 500):
        for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_quantile(q: float, p: float, v: float) -> float:
    """Quantile of Fisher's F distribution, from the upper tail."""
    low, high = 0.0, 1.0
    upper = lambda x: beta_cdf(v / (v + p * x), v / 2, p / 2)
    while upper(high) > 1 - q and high < 1e12:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > 1 - q else (low, mid)
    return high


def size_classes() -> list[int]:
    """The sizes that size_class() counts; groups between two take what is worked out for the lesser."""
    out = list(range(EACH_SIZE))
    while out[-1] < LIMIT_SIZE:
        out.append(max(out[-1] + 1, math.ceil(EACH_SIZE * 2 ** ((len(out) - EACH_SIZE) / 8) - 1e-9)))
    return out


def size_class(size: Column) -> Column:
    above = EACH_SIZE + F.floor(F.log2(size / EACH_SIZE) * 8 + F.lit(1e-9))
    return F.when(size < EACH_SIZE, size).otherwise(F.least(above, F.lit(len(size_classes())))).cast("int")


def subset_size(n: int, p: int, share: float = SUBSET) -> int:
    """Rows of the subset: ``share`` of many rows, and never less than half of them and the statistics."""
    half = (n + p + 1) // 2
    return min(n, math.floor(2 * half - n + 2 * (n - half) * share + 1e-9))


def consistency(h: float, n: float, p: int) -> float:
    """What the covariance of the ``h`` innermost of ``n`` normal rows is multiplied by."""
    return 1.0 if h >= n else h / n / chi2_cdf(chi2_quantile(h / n, p), p + 2)


def freedom(h: int, n: int, p: int) -> float:
    """Degrees of freedom of the Wishart distribution that is nearest to the subset's covariance: the asymptotic
    variance of its diagonal, after Croux and Haesbroeck (1999) and Hardin and Rocke (2005)."""
    if h >= n:
        return n - 1.0
    inside, out = h / n, 1 - h / n
    q = chi2_quantile(inside, p)
    c = inside / chi2_cdf(q, p + 2)
    c2, c3 = -chi2_cdf(q, p + 2) / 2, -chi2_cdf(q, p + 4) / 2
    b1 = c * (c3 - 3 * c3) / inside
    b2 = 0.5 + c / inside * (c3 - q / p * (c2 + inside / 2))
    v1 = inside * b1**2 * (out * (c * q / p - 1) ** 2 - 1) - 2 * c3 * c**2 * (3 * (b1 - p * b2) ** 2 + (p + 2) * b2 * (2 * b1 - p * b2))
    v2 = n * (b1 * (b1 - p * b2) * inside) ** 2 * c**2
    return 2 * v2 / (c**2 * v1)


@lru_cache
def cut_offs(quantile: float, p: int, share: float = SUBSET) -> tuple[float, ...]:
    """The greatest squared distance that is kept, by size class: a scaled F quantile, which nears the chi-square
    quantile as groups grow, and the chi-square quantile itself for the last. 0 where no estimate is defined."""
    out = []
    for n in size_classes():
        m = freedom(subset_size(n, p, share), n, p) if n >= 2 * p else 0.0
        v = max(m - p + 1, 1.0)
        out.append(p * max(m, p) / v * f_quantile(quantile, p, v) if n >= 2 * p else 0.0)
    return (*out, chi2_quantile(quantile, p))


def _bytes_of(text: Column, chars: str) -> Column:
    """How many of the ASCII characters ``chars`` are in ``text``."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0)).cast("long")


def _repeat_words(w: Column, n: Column) -> Column:
    """Words in three-word windows found twice or more. ``w``: the array, as a column of the table, not an expression.

    Hashes with positions in their low bits are sorted; neighbours with equal hashes are candidates, whose
    windows are then compared as text. So no step is quadratic in the text's length.
    """
    low = (1 << 31) - 1
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    packed = lambda h: F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    same = lambda a, b: F.coalesce(F.shiftright(a, 31) == F.shiftright(b, 31), F.lit(False))

    def candidates(s: Column) -> Column:
        return F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))

    def window(x: Column) -> Column:
        p = x.bitwiseAND(F.lit(low)).cast("int")
        return F.struct(F.concat_ws(" ", F.get(w, p), F.get(w, p + 1), F.get(w, p + 2)).alias("s"), p.alias("p"))

    def repeated(s: Column) -> Column:
        eq = lambda a, b: F.coalesce(a["s"] == b["s"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: eq(x, F.get(s, i + 1)) | eq(x, F.get(s, i - 1))), lambda x: x["p"])

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def of(found: Column) -> Column:
        return bind(F.sort_array(F.transform(found, window)), lambda s: bind(F.sort_array(repeated(s)), covered))

    def some(h: Column) -> Column:
        return bind(F.sort_array(packed(h)), lambda s: bind(candidates(s), lambda c: F.when(F.size(c) > 0, of(c)).otherwise(0)))

    # most texts have no hash twice, and are done
    return F.when(n >= 4, bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), some(h)).otherwise(0))).otherwise(0).cast("long")


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the struct ``__lf_base``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines.

    Null text counts as empty: no words, and so failed.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = df.withColumns({"__lf_words": words(text), "__lf_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))})
    n = F.size("__lf_words")
    df = df.withColumn("__lf_counts", F.struct(
        n.cast("long").alias("n_words"),
        (F.char_length(text) - _bytes_of(text, SPACES)).cast("long").alias("word_chars"),
        _bytes_of(text, SYMBOLS).alias("n_symbols"),
        (F.size("__lf_lines") - F.size(F.array_distinct("__lf_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("__lf_words"), n).alias("n_repeat_words"),
        F.size("__lf_lines").cast("long").alias("n_lines"),
        # a column that isn't deterministic keeps the optimizer from copying these expressions into filters above
        F.monotonically_increasing_id().alias("row"),
    ))
    c = F.col("__lf_counts")
    failed = (c["n_words"] < MIN_WORDS) | (c["n_repeat_words"] * 100 > c["n_words"] * MAX_REPEAT_PERCENT)
    fields = [c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")]
    return df.withColumn("__lf_base", F.struct(*fields, failed.alias("base_failed"))).drop("__lf_words", "__lf_lines", "__lf_counts")


def vector(base: Column) -> list[Column]:
    """The transformed statistics, in steps of the grid."""
    share = lambda a, b: F.when(base[b] > 0, base[a] / base[b]).otherwise(0.0)
    values = (
        F.log2(base["n_words"] + F.lit(1.0)),
        F.log2(share("word_chars", "n_words") + 1),
        F.log2(share("n_symbols", "word_chars") * 100 + 1),
        F.log2(share("n_dup_lines", "n_lines") * 10 + 1),
        F.log2(share("n_repeat_words", "n_words") * 10 + 1),
    )
    return [F.round(v * steps).cast("long") for v, (steps, _) in zip(values, STATISTICS.values(), strict=True)]


_P = len(STATISTICS)
_X = [f"x{i}" for i in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
#: By statistic, in steps: the least variance.
_LEAST = [(steps * sd) ** 2 for steps, sd in STATISTICS.values()]
_STATE = ["det", *(f"u{i}" for i in range(_P)), *(f"l{i}_{j}" for i, j in _PAIRS)]


def _factored(df: DataFrame) -> DataFrame:
    """With covariances c*_*: their Cholesky factor l*_* and log determinant. Variances are raised to the least ones; so is what of one
    the statistics before it leave, where that is nothing."""
    df = df.withColumns({f"c{i}_{i}": F.greatest(F.col(f"c{i}_{i}"), F.lit(_LEAST[i])) for i in range(_P)})
    for j in range(_P):
        rest = F.col(f"c{j}_{j}") - sum((F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.when(rest > _LEAST[j] * 1e-3, rest).otherwise(_LEAST[j])))
        if j + 1 < _P:
            df = df.withColumns({f"l{i}_{j}": (F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}_{j}") for i in range(j + 1, _P)})
    return df.withColumn("det", sum((F.log(F.col(f"l{i}_{i}")) for i in range(_P)), F.lit(0.0)) * 2)


def _inverted(df: DataFrame) -> DataFrame:
    """With the inverse v*_* of the factor."""
    for i in range(_P):
        df = df.withColumns({f"v{i}_{j}": 1 / F.col(f"l{i}_{i}") if i == j else -sum((F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}_{i}") for j in range(i + 1)})
    return df


def _distance(xs: Sequence[Column], prefix: str = "") -> Column:
    """Squared Mahalanobis distance from the estimate in columns u*, v*_*."""
    z = [sum((F.col(f"{prefix}v{i}_{j}") * (xs[j] - F.col(f"{prefix}u{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(_P)]
    return sum((v * v for v in z), F.lit(0.0))


def _away(df: DataFrame) -> DataFrame:
    """With the squared distance ``d`` of x* from the estimate; a column for each equation, so that none is computed twice."""
    for i in range(_P):
        df = df.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"u{i}") - sum((F.col(f"l{i}_{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}_{i}"))
    return df.withColumn("d", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(_P)), F.lit(0.0)))


def _group():
    return Window.partitionBy("g", "start")


def _moments(df: DataFrame, weight: Column, ys: Sequence[Column], scale: Column) -> DataFrame:
    """With means u* and covariances c*_* of ``ys`` over each group and start, covariances times ``scale``."""
    df = df.withColumns({"m": F.sum(weight).over(_group())} | {f"s{i}": F.sum(weight * y).over(_group()) for i, y in enumerate(ys)} | {f"s{i}_{j}": F.sum(weight * ys[i] * ys[j]).over(_group()) for i, j in _PAIRS})
    df = df.withColumns({f"u{i}": F.col(f"s{i}") / F.col("m") for i in range(_P)})
    return df.withColumns({f"c{i}_{j}": (F.col(f"s{i}_{j}") / F.col("m") - F.col(f"u{i}") * F.col(f"u{j}")) * scale for i, j in _PAIRS})


_CELL = ["g", "start", "n", "h", "scale", *_X]


def _step(df: DataFrame) -> DataFrame:
    """One concentration step of every group and start; ``moved`` tells whose determinant fell. The others stay as they are."""
    nearest = _group().orderBy("d", *_X).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.greatest(F.lit(0), F.least(F.col("n"), F.col("h") - F.coalesce(F.sum("n").over(nearest), F.lit(0))))
    old = df.select(*_CELL, weight.alias("w"), *(F.col(c).alias(f"old_{c}") for c in ("d", *_STATE)))
    new = _away(_factored(_moments(old, F.col("w"), [F.col(c) for c in _X], F.col("scale"))))
    moved = F.col("det") < F.col("old_det") - 1e-9
    return new.select(*_CELL, moved.alias("moved"), *(F.when(moved, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("d", *_STATE)))


def fit(stats: DataFrame, share: float = SUBSET, quantile: float = QUANTILE) -> DataFrame:
    """The estimate of each (lang, source) of MIN_GROUP rows or more: u*, v*_* (the inverse Cholesky factor of the covariance), and ``cut``,
    the greatest squared distance that is kept. ``stats``: lang, source, x*. Null is a language or source like any other.
    """
    cells = cut(stats.groupBy("lang", "source", *_X).agg(F.count("*").alias("n")), "mcd-cells")
    # what is left is as small as its vectors are few: as many tasks as cores do, whatever the shuffle partitions
    tasks = max(stats.sparkSession.sparkContext.defaultParallelism, cells.count() // STEP_ROWS)
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    groups = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"), *(F.percentile(c, quartiles, F.col("n")).alias(f"q{i}") for i, c in enumerate(_X)))
    size = F.col("size")
    half = F.floor((size + _P + 1) / 2)
    groups = groups.withColumn("h", F.least(size, F.floor(2 * half - size + 2 * (size - half) * F.lit(share) + F.lit(1e-9))))
    factors = [consistency(subset_size(n, _P, share), n, _P) if n >= MIN_GROUP else 1.0 for n in size_classes()] + [share / chi2_cdf(chi2_quantile(share, _P), _P + 2)]
    of_size = lambda values: F.element_at(F.array(*map(F.lit, values)), size_class(size) + 1)
    groups = groups.withColumns({"g": F.to_json(F.struct("lang", "source")), "scale": of_size(factors), "cut": of_size(cut_offs(quantile, _P, share))})
    groups = cut(groups.filter(size >= MIN_GROUP).coalesce(tasks), "mcd-groups")
    mid = [F.col(f"q{i}")[1] for i in range(_P)]
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(_LEAST[i] ** 0.5)) for i in range(_P)]
    own = groups.select("g", "h", "scale", *(mid[i].alias(f"a{i}") for i in range(_P)), *(spread[i].alias(f"b{i}") for i in range(_P)))
    rows = cells.withColumn("g", F.to_json(F.struct("lang", "source"))).join(own, "g").withColumn("start", F.explode(F.array(*map(F.lit, range(3)))))
    # starts: all rows, medians and quartiles, and all rows pulled in to two deviations
    bounded = [F.round(F.least(F.greatest(F.col(c), F.col(f"a{i}") - 2 * F.col(f"b{i}")), F.col(f"a{i}") + 2 * F.col(f"b{i}"))).cast("long") for i, c in enumerate(_X)]
    rows = rows.repartition("g", "start").withColumns({f"y{i}": F.when(F.col("start") == 2, bounded[i]).otherwise(F.col(c)) for i, c in enumerate(_X)})
    rows = _moments(rows, F.col("n"), [F.col(f"y{i}") for i in range(_P)], F.lit(1.0))
    plain = F.col("start") != 1
    rows = rows.withColumns({f"u{i}": F.when(plain, F.col(f"u{i}")).otherwise(F.col(f"a{i}")) for i in range(_P)} | {f"c{i}_{j}": F.when(plain, F.col(f"c{i}_{j}")).otherwise(F.col(f"b{i}") * F.col(f"b{i}") if i == j else F.lit(0.0)) for i, j in _PAIRS})
    rows = _away(_factored(rows)).withColumn("det", F.lit(float("inf")))
    states = None
    for _ in range(MAX_STEPS):
        rows = cut(_step(rows).coalesce(tasks), "mcd-step")
        # those that stay are done; the others go on
        done = rows.filter(~F.col("moved")).groupBy("g", "start").agg(*(F.first(c).alias(c) for c in _STATE))
        states = done.coalesce(tasks) if states is None else states.unionByName(done.coalesce(tasks))
        rows = rows.filter("moved")
        if rows.isEmpty():
            break
    else:
        raise RuntimeError("concentration steps did not settle")
    best = states.groupBy("g").agg(F.min(F.struct(F.round("det", 9).alias("det"), "start", *(c for c in _STATE if c != "det"))).alias("best"))
    best = _inverted(best.select("g", *(F.col(f"best.{c}").alias(c) for c in _STATE)))
    return cut(groups.join(best, "g").select("lang", "source", "cut", *(f"u{i}" for i in range(_P)), *(f"v{i}_{j}" for i, j in _PAIRS)).coalesce(tasks), "mcd-best")


def judge(df: DataFrame, lang_col: str = "lang", source_col: str = "source", quantile: float = QUANTILE) -> DataFrame:
    """``df`` (with ``__lf_base``) with ``__lf_distance`` (null without an estimate) and ``__lf_kept``."""
    stats = df.filter("not __lf_base.base_failed")
    stats = stats.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), *(v.alias(c) for c, v in zip(_X, vector(F.col("__lf_base")), strict=True)))
    with scratch(df.sparkSession) as keep:
        best = keep(fit(stats, quantile=quantile))
    best = best.select(*(F.col(c).alias(f"__lf_{c}") for c in best.columns))
    same = lambda a, b: a.eqNullSafe(b)
    on = same(F.col(f"`{lang_col}`"), F.col("__lf_lang")) & same(F.col(f"`{source_col}`"), F.col("__lf_source"))
    if best.count() <= MAX_BROADCAST_GROUPS:
        best = F.broadcast(best)
    joined = df.join(best, on, "left")
    base = F.col("__lf_base")
    away = F.when(~base["base_failed"], _distance(vector(base), "__lf_"))
    kept = ~base["base_failed"] & F.coalesce(away <= F.col("__lf_cut"), F.lit(True))
    return joined.withColumns({"__lf_distance": away, "__lf_kept": kept})


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = QUANTILE) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null or empty text fails the base rules. Nulls in language or source form groups of their own. A group with fewer
    than MIN_GROUP rows that pass the base rules rejects none of them. Repeated rows are judged alike, row by row; rows at equal
    distance are judged alike. A text of any length is one row. An empty table gives an empty result; columns beyond the four named ones aren't read.
    """
    read = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    counts = cut(base_counts(read).drop("text"), "quality-counts")
    out = judge(counts, quantile=quantile)
    return out.select("doc_id", *(f"__lf_base.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")), F.col("__lf_kept").alias("kept"), F.round("__lf_distance", 3).alias("distance"))


def good_documents(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``df`` that quality() keeps, all columns unchanged. The rows and their counts are written once to the shared
    folder and filtered from there: texts are counted once, and never shuffled. Null texts go, repeated rows stay or go together, an
    empty table stays empty. Raises ValueError if a column's name begins with ``__lf_``."""
    no_reserved(df)
    counted = cut(base_counts(df, text_col), "quality-documents")
    return judge(counted, lang_col, source_col, quantile).filter("__lf_kept").select(*[F.col(f"`{c}`") for c in df.columns])
