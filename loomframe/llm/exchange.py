"""Packed exchange: NumPy columns travel between tasks as a few compressed blobs for each bucket.

A row a hash would cost the JVM far more than the hash itself. So map tasks sort their columns by bucket and
emit (bucket, blob) rows, Spark shuffles them by bucket, and reduce tasks unpack whole columns. Before they
emit, map tasks combine equal keys, so a key that a third of the corpus holds arrives in its bucket
at most once from each map task (and flush), never once a row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
BLOBS_DDL = "bucket int, blob binary"
#: Rows that a map task gathers before it emits them.
FLUSH_ROWS = 1 << 19
#: Bytes of input files for each bucket, and so many buckets at most, if the session has no more shuffle partitions.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 1 << 17
#: Spark's size of a table of which it knows none is as large as this or larger.
_UNKNOWN = 1 << 60


def pack(columns: Sequence[np.ndarray]) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=1)
    out = [struct.pack("<B", len(columns))]
    for c in columns:
        raw = np.ascontiguousarray(c).tobytes()
        small = squeeze.compress(raw)
        out.append(struct.pack("<3sQQ", c.dtype.str[-3:].encode().rjust(3, b"|")[:3], len(raw), len(small)))
        out.append(small)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    widen, at, out = zstandard.ZstdDecompressor(), 1, []
    for _ in range(blob[0]):
        kind, raw, small = struct.unpack_from("<3sQQ", blob, at)
        at += struct.calcsize("<3sQQ")
        data = widen.decompress(blob[at : at + small], max_output_size=raw) if raw else b""
        out.append(np.frombuffer(data, dtype=np.dtype(kind.decode())))
        at += small
    return out


def by_bucket(bucket: np.ndarray, columns: Sequence[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' parts with each bucket, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    sorted_bucket = bucket[order]
    edges = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1], True]) if len(bucket) else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(sorted_bucket[a]), [c[order[a:b]] for c in columns]


def blob_rows(bucket: np.ndarray, columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    found = [(k, pack(part)) for k, part in by_bucket(bucket, columns)]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], schema=BLOBS)


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a hash, from its high bits."""
    return ((key >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)


class Gather:
    """Columns of many pieces, emitted by ``flush`` (columns -> record batches) when there are enough rows."""

    def __init__(self, flush: Callable[[list[np.ndarray]], Iterable[pa.RecordBatch]], rows: int = FLUSH_ROWS):
        self.flush, self.rows, self.parts, self.n = flush, rows, [], 0

    def add(self, columns: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append(columns)
            self.n += len(columns[0])
        if self.n >= self.rows:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.n = [], 0
            yield from self.flush(columns)


def deal(blobs: DataFrame, n: int) -> DataFrame:
    """Shuffle blob rows so that a partition has one bucket."""
    return blobs.repartitionById(n, F.col("bucket"))


def received(batches: Iterable[pa.RecordBatch]) -> tuple[list[np.ndarray], int]:
    """All columns of a reduce task's blobs, joined; the bucket, or -1 if there is none."""
    found, bucket = received_kinds(batches)
    return next(iter(found.values()), []), bucket


def received_kinds(batches: Iterable[pa.RecordBatch]) -> tuple[dict[int, list[np.ndarray]], int]:
    """As received(), for blobs of several kinds, told apart by their number of columns."""
    parts: dict[int, list] = {}
    bucket = -1
    for batch in batches:
        for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            bucket, columns = k, unpack(blob.as_py())
            parts.setdefault(len(columns), []).append(columns)
    return {k: [np.concatenate(c) for c in zip(*x, strict=True)] for k, x in parts.items()}, bucket


def buckets(df: DataFrame) -> int:
    """As many buckets as shuffle partitions, or more if the tables that ``df`` reads are large: a bucket must fit in one Python
    worker, whatever the session's setting."""
    return max(1, shuffle_partitions(df.sparkSession), min(-(-_input_bytes(df) // BUCKET_BYTES), MOST_BUCKETS))


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as far as Spark knows them: rows that were made in the session count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(s for s in sizes if s < _UNKNOWN)


def flush_rows(n: int) -> int:
    """Rows that a map task gathers for ``n`` buckets: some dozens a blob at least, so that headers don't outweigh them."""
    return max(FLUSH_ROWS, 32 * n)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def lists(edges: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column; ``edges``: where each row's values begin, and their number."""
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values).cast(kind))
