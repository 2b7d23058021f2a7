"""Document identity and the join of found spans with texts, for the operators on long repeated substrings.

A document is known by its id (null: the least) and a hash of its text, so that rows that repeat an id with
another text stay apart, and rows that repeat both are one document with one decision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import blob_rows, bucket_of, deal, lists, received, runs
from .textops import mix

NULL_ID = -(1 << 63)

FOUND_DDL = "k_doc long, k_sub long, kind int, first array<int>, n array<int>, bucket array<int>"
FOUND = pa.schema([("k_doc", pa.int64()), ("k_sub", pa.int64()), ("kind", pa.int32()), ("first", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("bucket", pa.list_(pa.int32()))])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k_doc, k_sub and text."""
    text = F.col(f"`{text_col}`")
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("k_doc"), F.xxhash64(text).alias("k_sub"), text.alias("text"))


def doc_id() -> F.Column:
    return F.when(F.col("k_doc") != NULL_ID, F.col("k_doc")).alias("doc_id")


def found_blobs(n_buckets: int, doc: np.ndarray, sub: np.ndarray, first: np.ndarray, n: np.ndarray | int = 1, kind: int = 0, bucket: int = -1) -> pa.RecordBatch:
    """Spans found by a reduce task, to buckets by document; see by_document()."""
    size = len(doc)
    columns = [doc, sub, np.full(size, kind, np.int8), first.astype(np.int32), np.broadcast_to(np.asarray(n, np.int32), size), np.full(size, bucket, np.int32)]
    return blob_rows(bucket_of(mix(doc.astype(np.uint64)), n_buckets), columns)


def firsts_and_later(new: np.ndarray, doc: np.ndarray, sub: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each run of equal strings, sorted by document and start, and of the later ones. The same place
    of the same document, which repeated rows give again, is neither."""
    k = np.arange(len(new))
    head = np.maximum.accumulate(np.where(new, k, 0))
    return k[new], k[~new & ((doc != doc[head]) | (sub != sub[head]) | (at != at[head]))]


def _regroup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns, _ = received(batches)
    if not columns:
        return
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    doc, sub, kind, first, n, bucket = (c[order] for c in columns)
    at = np.flatnonzero(runs(doc, sub, kind))
    edges = np.append(at, len(doc))
    for lo in range(0, len(at), 2000):
        part = edges[lo : lo + 2001]
        rows, spans = part[:-1], slice(part[0], part[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(sub[rows]), pa.array(kind[rows].astype(np.int32)), *(lists(part - part[0], c[spans], pa.int32()) for c in (first, n, bucket))], schema=FOUND)


def by_document(blobs: DataFrame, n_buckets: int) -> DataFrame:
    """One row a document and kind, with all its spans."""
    return deal(blobs, n_buckets).mapInArrow(_regroup, FOUND_DDL)


def with_found(docs: DataFrame, found: DataFrame, how: str, extra: Sequence[str] = ()) -> DataFrame:
    """``docs`` (keyed) joined with all spans found in each: the array ``spans`` of (first, n, *extra).

    A merge join at every size, so that what it takes grows as the texts do.
    """
    grouped = found.groupBy("k_doc", "k_sub").agg(F.collect_list(F.struct("first", "n", *extra)).alias("spans"))
    return docs.join(grouped.hint("merge"), ["k_doc", "k_sub"], how)


def flat_spans(column: pa.Array, names: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For a column of spans: the row of each span, and first, n and the extra values of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    outer = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    fields = {inner.type.field(i).name: x for i, x in enumerate(inner.flatten())} if len(inner) else {}
    if not fields:
        return np.empty(0, np.int64), [np.empty(0, np.int64) for _ in names]
    lengths = fields["first"].value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.repeat(np.arange(len(column)), outer), lengths)
    out = []
    for name in names:
        x = fields[name]
        out.append(x.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(x.type) else np.repeat(x.to_numpy(zero_copy_only=False), lengths))
    return rows, out
