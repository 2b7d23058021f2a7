"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a document are hashed. A window found before, in a document of smaller id or
earlier in its own, is repeated; the lines that repeated windows cover are merged and removed.

Scale: windows are dealt by hash, packed, and combined in map tasks, so a passage that a third of the corpus
holds reaches its bucket once a task. Texts are dealt once, by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import docwork
from .common import cut
from .exchange import BLOBS_DDL, Gather, blob_rows, bucket_of, buckets, deal, flush_rows, received, runs
from .textops import covered, kept_spans, mix, pieces, ragged, span_hashes, text_bytes, window_hashes

WINDOW = 3


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each line, without its line feed, and each row's first line (one more than rows). An empty row has one line."""
    feeds = np.flatnonzero(data == 10)
    row = np.searchsorted(offsets, feeds, side="right") - 1
    count = np.bincount(row, minlength=len(offsets) - 1) + 1
    first = np.append(0, np.cumsum(count))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    begins = np.zeros(first[-1], dtype=bool)
    begins[first[:-1]] = True
    starts[begins], starts[~begins] = offsets[:-1], feeds + 1
    closes = np.zeros(first[-1], dtype=bool)
    closes[first[1:] - 1] = True
    ends[closes], ends[~closes] = offsets[1:], feeds
    return starts, ends, first


def _windows(window: int, n: int):
    def earliest(columns: list[np.ndarray]) -> list[pa.RecordBatch]:
        order = np.lexsort(tuple(reversed(columns)))
        columns = [c[order] for c in columns]
        first, again = docwork.firsts_and_later(runs(columns[0], columns[1]), *columns[2:])
        columns = [c[np.append(first, again)] for c in columns]
        later = np.repeat([False, True], [len(first), len(again)])
        return [blob_rows(np.where(later, bucket_of(mix(columns[2].astype(np.uint64)), n), bucket_of(columns[0], n)), [later, *columns])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(earliest, flush_rows(n))
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            docs, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in pieces(offsets):
                part = data[offsets[a] : offsets[b]]
                starts, ends, first = line_spans(part, offsets[a : b + 1] - offsets[a])
                hashes = span_hashes(part, starts, ends)
                fits = np.maximum(np.diff(first) - window + 1, 0)
                row = np.repeat(np.arange(b - a), fits)
                at = ragged(np.zeros(b - a, np.int64), fits)
                keys = [window_hashes(h, window, v)[first[row] + at] if len(at) else np.empty(0, np.uint64) for v, h in enumerate(hashes)]
                yield from gather.add([keys[0], (keys[1] >> np.uint64(32)).astype(np.uint32), docs[a:b][row], subs[a:b][row], at.astype(np.int32)])
        yield from gather.end()

    return run


def _later(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    columns, _ = received(batches)
    if not columns:
        return
    passed, key, check, doc, sub, at = columns
    order = np.lexsort((at, sub, doc, check, key))
    order = order[~passed[order]]
    _, again = docwork.firsts_and_later(runs(key[order], check[order]), doc[order], sub[order], at[order])
    later = np.concatenate([np.flatnonzero(passed), order[again]])
    if len(later):
        yield docwork.found_blobs(n, doc[later], sub[later], at[later])


def _kept(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            rows, (at,) = docwork.flat_spans(batch.column(3), ["first"])
            n_lines, n_removed, texts = [], [], []
            for a, b in pieces(offsets):
                part, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = line_spans(part, edges)
                here = slice(*np.searchsorted(rows, [a, b]))
                begin = first[rows[here] - a] + at[here]
                gone = covered(begin, begin + window, len(starts))
                removed = np.append(0, np.cumsum(gone))[first]
                joined, stops = kept_spans(part, edges, first, starts, ends, ~gone, 10)
                for k in range(b - a):
                    n_lines.append(int(first[k + 1] - first[k]))
                    n_removed.append(int(removed[k + 1] - removed[k]))
                    texts.append(joined[stops[k] : max(stops[k], stops[k + 1] - 1)].tobytes().decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=["k_doc", "n_lines", "n_removed", "text"])

    return run


def remove_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, text (the lines that are left, joined by line feeds).

    Lines are split at line feeds and compared whole, blank ones too. Earlier: a smaller id (a null id is the least; of equal
    ids, the text of smaller hash), or earlier in the document. Null text is one empty line. Texts of fewer lines than a
    window are kept whole. Repeated rows (same id and text) are one document: each such row is judged like the
    first. A text of any length is one document, and needs some ten times its bytes in one Python worker. An empty table
    gives an empty result; other columns aren't read.
    """
    n = buckets(df)
    docs = docwork.keyed(df, id_col, text_col)
    windows = deal(docs.mapInArrow(_windows(window, n), BLOBS_DDL), n)
    later = cut(docwork.by_document(windows.mapInArrow(lambda it: _later(it, n), BLOBS_DDL), n), "line-windows")
    out = docwork.with_found(docs, later, "left").select("k_doc", "k_sub", "text", "spans").mapInArrow(_kept(window), "k_doc long, n_lines long, n_removed long, text string")
    return out.select(docwork.doc_id(), "n_lines", "n_removed", "text")


#: DuckDB SQL for remove_repeated_lines() over ``documents``.
ORACLE_SQL = """
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
w as (select doc_id, pos, line, lead(line, 1) over (partition by doc_id order by pos) as line2,
             lead(line, 2) over (partition by doc_id order by pos) as line3 from l),
r as (select doc_id, pos, row_number() over (partition by line, line2, line3 order by doc_id, pos) as k from w where line3 is not null),
m as (select w.doc_id, w.pos, w.line, coalesce(r.k, 1) > 1 as again from w left join r on w.doc_id = r.doc_id and w.pos = r.pos),
c as (select doc_id, pos, line, max(again::int) over (partition by doc_id order by pos rows between 2 preceding and current row) = 1 as gone from m)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_removed,
       coalesce(string_agg(case when not gone then line end, chr(10) order by pos), '') as text
from c group by doc_id
"""
