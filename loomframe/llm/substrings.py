"""Substring dedup on words by difference-cover anchors.

A window is a run of consecutive words of one document. Word sequences of anchor length are hashed only at
positions of a difference cover modulo its period: for any two positions some offset below the period puts
both on the cover, so two equal windows share an anchor hash at the same offset. Repeated anchors are
found by one exchange of hashes; only windows around them are then hashed whole, and a second
exchange finds which of those repeat anywhere. Words of repeated windows are removed, everywhere.

Scale: texts are dealt once, by document, and windows that no repeated anchor is in are never hashed.
Equal hashes are combined in each map task, so a passage that a third of the corpus holds reaches its bucket
once from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docwork
from .common import cut, scratch
from .exchange import BLOBS_DDL, Gather, blob_rows, bucket_of, buckets, deal, flush_rows, received, runs
from .textops import covered, kept_spans, mix, pieces, ragged, span_hashes, text_bytes, window_hashes, word_spans

WINDOW = 35
#: A perfect difference set: every difference modulo 21 is one of two members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


def check_cover(period: int, cover: tuple[int, ...]) -> None:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover: some difference is missing")


def _hashed_words(data: np.ndarray, offsets: np.ndarray, variants: int) -> tuple[list[np.ndarray], np.ndarray]:
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends, variants), first


def _combined(columns: list[np.ndarray], n_keys: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Map-side combining. columns: keys, doc, sub, at. Of equal keys one row goes to the key's bucket, flagged if
    it had equals; the others are decided, and go to a bucket of their document's, to be passed on."""
    keys, places = columns[:n_keys], columns[n_keys:]
    order = np.lexsort(tuple(reversed(keys)))
    new = runs(*(k[order] for k in keys))
    again = np.append(~new[1:], False) if len(new) else new
    kind = np.where(new, again, 2).astype(np.int8)
    keys, places = [k[order] for k in keys], [p[order] for p in places]
    bucket = np.where(kind == 2, bucket_of(mix(places[0].astype(np.uint64)), n), bucket_of(keys[0], n))
    return bucket, [kind, *keys, *places]


def _repeated(batches: Iterable[pa.RecordBatch], n_keys: int, n: int) -> Iterator[pa.RecordBatch]:
    columns, _ = received(batches)
    if not columns:
        return
    kind, keys, (doc, sub, at) = columns[0], columns[1 : 1 + n_keys], columns[1 + n_keys :]
    order = np.lexsort(tuple(reversed(keys)))
    new = runs(*(k[order] for k in keys))
    group = np.cumsum(new) - 1
    passed = kind[order] == 2
    sent = np.bincount(group[~passed], weights=1.0 + kind[order][~passed], minlength=group[-1] + 1)
    found = order[passed | (sent[group] >= 2)]
    if len(found):
        yield docwork.found_blobs(n, doc[found], sub[found], at[found])


def _anchors(window: int, period: int, cover: tuple[int, ...], n: int):
    width, on = window - period + 1, np.zeros(period, dtype=bool)
    on[list(cover)] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(lambda c: [blob_rows(*_combined(c, 1, n))], flush_rows(n))
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            docs, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in pieces(offsets):
                (h,), first = _hashed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], 1)
                words = np.diff(first)
                fits = np.where(words >= window, words - width + 1, 0)
                row = np.repeat(np.arange(b - a), fits)
                at = ragged(np.zeros(b - a, dtype=np.int64), fits)
                chosen = on[at % period]
                row, at = row[chosen], at[chosen]
                key = window_hashes(h, width)[first[row] + at] if len(at) else np.empty(0, np.uint64)
                yield from gather.add([key, docs[a:b][row], subs[a:b][row], at.astype(np.int32)])
        yield from gather.end()

    return run


def _windows(window: int, period: int, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(lambda c: [blob_rows(*_combined(c, 2, n))], flush_rows(n))
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            docs, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows, (anchor,) = docwork.flat_spans(batch.column(3), ["first"])
            for a, b in pieces(offsets):
                hashes, first = _hashed_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], 2)
                here = slice(*np.searchsorted(rows, [a, b]))
                row, x = rows[here] - a, anchor[here].astype(np.int64)
                last = first[row + 1] - first[row] - window
                low, high = np.maximum(x - period + 1, 0), np.minimum(x, last)
                near = covered(first[row] + low, first[row] + high + 1, len(hashes[0]))
                at = np.flatnonzero(near)
                row = np.searchsorted(first, at, side="right") - 1
                keys = [window_hashes(h, window, v)[at] if len(at) else np.empty(0, np.uint64) for v, h in enumerate(hashes)]
                check = (keys[1] >> np.uint64(32)).astype(np.uint32)
                yield from gather.add([keys[0], check, docs[a:b][row], subs[a:b][row], (at - first[row]).astype(np.int32)])
        yield from gather.end()

    return run


RESULT_DDL = "k_doc long, n_words long, n_removed long, kept_sha256 string, text string"


def _kept(window: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            rows, (at,) = docwork.flat_spans(batch.column(3), ["first"])
            out: list[list] = [[], [], [], []]
            for a, b in pieces(offsets):
                part, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = word_spans(part, edges)
                here = slice(*np.searchsorted(rows, [a, b]))
                begin = first[rows[here] - a] + at[here]
                gone = covered(begin, begin + window, len(starts))
                removed = np.append(0, np.cumsum(gone))[first]
                joined, stops = kept_spans(part, edges, first, starts, ends, ~gone, 32)
                for k in range(b - a):
                    text = joined[stops[k] : max(stops[k], stops[k + 1] - 1)].tobytes()
                    out[0].append(int(first[k + 1] - first[k]))
                    out[1].append(int(removed[k + 1] - removed[k]))
                    out[2].append(hashlib.sha256(text).hexdigest())
                    out[3].append(text.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["k_doc", "n_words", "n_removed", "kept_sha256", "text"])

    return run


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and text (the kept words joined by one space;
    null if not ``with_text``).

    Words are runs of anything but the six ASCII white-space characters. Null or empty text has no words and
    keeps nothing. Documents of fewer words than a window are kept whole. A repeated row (same id, same text)
    repeats all its windows. A null id stays null. A text of any length is one document, and needs some ten times its
    bytes in one Python worker. An empty table gives an empty result; other columns aren't read. Raises ValueError if ``cover`` isn't a difference cover or the window is shorter than its period.
    """
    check_cover(period, cover)
    if window < period:
        raise ValueError("the window must be as long as the period, or longer")
    n = buckets(df)
    docs = docwork.keyed(df, id_col, text_col)
    with scratch(df.sparkSession) as keep:
        anchors = deal(docs.mapInArrow(_anchors(window, period, cover, n), BLOBS_DDL), n)
        found = cut(docwork.by_document(anchors.mapInArrow(lambda it: _repeated(it, 1, n), BLOBS_DDL), n), "anchors")
        near = docwork.with_found(docs, found, "inner")
        windows = deal(near.select("k_doc", "k_sub", "text", "spans").mapInArrow(_windows(window, period, n), BLOBS_DDL), n)
        repeated = keep(cut(docwork.by_document(windows.mapInArrow(lambda it: _repeated(it, 2, n), BLOBS_DDL), n), "windows"))
    out = docwork.with_found(docs, repeated, "left").select("k_doc", "k_sub", "text", "spans").mapInArrow(_kept(window, with_text), RESULT_DDL)
    return out.select(docwork.doc_id(), "n_words", "n_removed", "kept_sha256", *["text"] * with_text)


#: DuckDB SQL for remove_repeated_windows() over ``documents``, without the text.
ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
s as (select doc_id, unnest(generate_series(1, len(w) - 34)) as pos, w from d where len(w) >= 35),
k as (select doc_id, pos, array_to_string(list_slice(w, pos, pos + 34), ' ') as key from s),
r as (select doc_id, pos, count(*) over (partition by key) > 1 as again from k),
m as (select p.doc_id, p.pos, p.word, coalesce(r.again, false) as again from p left join r on p.doc_id = r.doc_id and p.pos = r.pos),
c as (select doc_id, pos, word, max(again::int) over (partition by doc_id order by pos rows between 34 preceding and current row) = 1 as gone from m),
g as (select doc_id, sum(gone::int)::bigint as n_removed, coalesce(string_agg(case when not gone then word end, ' ' order by pos), '') as kept from c group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(g.n_removed, 0)::bigint as n_removed, sha256(coalesce(g.kept, '')) as kept_sha256
from d left join g on d.doc_id = g.doc_id
"""
