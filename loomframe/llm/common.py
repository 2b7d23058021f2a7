"""What the training-data operators share: the shared folder, lineage cuts and word patterns."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

#: The six ASCII white-space characters that separate words; any other character is part of a word.
SPACES = " \t\n\x0b\x0c\r"
#: Java and RE2 pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Java pattern of the space between words.
GAP = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_cuts: dict[str, list[str]] = {}
_paths: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="loomframe-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: later stages don't depend on lost executors. The table stays until
    a scratch() around it ends, or clear_cuts() or the end of the session deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomframe-{label}-{uuid.uuid4().hex}"
    void = [f.name for f in df.schema if isinstance(f.dataType, NullType)]  # Parquet has no such type
    written = df.withColumns({c: F.lit(None).cast("string") for c in void})
    own(spark, path)
    written.write.parquet(path)
    read = spark.read.schema(written.schema).parquet(path).withColumns({c: F.lit(None) for c in void})
    _paths[id(read)] = path
    weakref.finalize(read, _paths.pop, id(read), None)
    return read


def own(spark: SparkSession, path: str) -> None:
    """Count the table at ``path`` among those that clear_cuts() deletes."""
    app = spark.sparkContext.applicationId
    if app not in _cuts:
        _cuts[app] = []
        atexit.register(_at_exit, spark)
    _cuts[app].append(path)


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        clear_cuts(spark)


def cuts(spark: SparkSession) -> list[str]:
    """The tables that cut() has written in this application and that are still there."""
    return list(_cuts.get(spark.sparkContext.applicationId, []))


def clear_cuts(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete those tables, or some of them, once what was made from them is stored elsewhere; how many there were."""
    known, jvm = _cuts.get(spark.sparkContext.applicationId, []), spark.sparkContext._jvm
    gone = [p for p in known if paths is None or p in paths]
    for p in gone:
        known.remove(p)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end the tables that cut() wrote inside are deleted, but for those that were passed to what it yields. An operator's result
    may only read these."""
    before, kept = set(cuts(spark)), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_paths[id(df)])
        return df

    try:
        yield keep
    finally:
        clear_cuts(spark, [p for p in cuts(spark) if p not in before | kept])


#: A key is hot if it holds one row in so many; there are at most so many hot keys.
HOT_SHARE = 1000


def hot_join(rows: DataFrame, stats: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with ``stats``, which has one row a key and in ``size`` how many of ``rows`` the key holds.

    Rows of a key that holds a thousandth of all or more are joined by broadcast, at most a thousand rows of ``stats``; so no
    task gets all rows of such a key, and the others are too few to matter.
    """
    total = stats.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE >= total
    frequent = F.broadcast(stats.filter(hot))
    rest = rows.join(F.broadcast(stats.filter(hot).select(key)), key, "left_anti").join(stats.filter(~hot), key)
    return rows.join(frequent, key).unionByName(rest)


def no_reserved(df: DataFrame) -> None:
    """ValueError if a column's name begins with ``__lf_``, which the operators that add columns for a while keep to themselves."""
    taken = [c for c in df.columns if c.startswith("__lf_")]
    if taken:
        raise ValueError(f"Columns {taken} have names that are reserved.")


def bind(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` can use it many times and it is computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of ``text`` as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    """The number of words as a long; null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
