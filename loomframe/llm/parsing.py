"""Suffix-array dedup of long repeated byte strings by prefix-free parsing.

Parse. A rolling hash runs over each text's bytes; in every stretch of places in which a match-long string
must have one, the place of the least hash is a trigger. So triggers depend on nothing but the bytes around
them, and equal strings of the match length have the same first trigger at the same distance. The strings that share
a trigger lie side by side; together they span a phrase. Every string of the match length lies in
one phrase.

Dictionary. Phrases are dealt by the hash at their trigger, equal ones are combined, and the first in
corpus order is the dictionary's entry. All strings in any later occurrence start earlier, in the entry.

Suffix arrays. Only entries that share a trigger with another entry can share a string with it. Their bytes are sent to
the trigger's bucket. A string is a suffix of the phrase that ends with the trigger, and what the parse goes on with. So
the bucket orders its part of the dictionary, the suffixes up to the trigger, and its part of the parse, what follows
the trigger; the lengths of neighbours' common parts give, for any length, the class of equal ones. A string's two classes
combined say which strings are equal; of these the first in corpus order stays, the others start earlier too.

Hot triggers. A short common line gives one trigger to as many different phrases as there are documents that
hold it. A map task that sees many phrases for a trigger deals them by phrase hash instead, and tells the trigger's
bucket; all entries of such a trigger are then told apart by 128 bits of hash of their strings, dealt by
those hashes and combined in the map tasks. No entry is left out.

Scale: only hashes of phrases travel, one a 35 bytes of text or so, packed; later occurrences in the same map
task are decided there, so a passage that a third of the corpus holds reaches its bucket once a task. Texts are dealt
by document once, and used for the entries and for the result. A long text is parsed a stretch at a time; a phrase that
is cut shares its trigger with the whole one, and so meets it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docwork
from .common import cut
from .exchange import BLOBS, BLOBS_DDL, Gather, blob_rows, bucket_of, buckets, by_bucket, deal, flush_rows, pack, received, received_kinds, runs
from .textops import PLACE_BITS, ROLL, covered, mix, pieces, ragged, span_hashes, text_bytes, window_owner

MATCH = 100
#: Bytes that the trigger hash covers.
TRIGGER = 32

LATER, ENTRY = 1, 2
#: Bytes of text that are parsed at a time.
PIECE = 1 << 20
#: Kinds of rows in the exchange of phrases.
_PLAIN, _LATER, _HOT, _MARK = 0, 1, 2, 3
#: A trigger is hot if a map task has more phrases for it at a flush, or a bucket more entries.
HOT_LOCAL, HOT_BUCKET = 64, 20_000


def phrases(data: np.ndarray, offsets: np.ndarray, match: int, trigger: int) -> tuple[np.ndarray, ...]:
    """Row, first string's start, number of strings, trigger hash, phrase hash and a check of it, of each phrase of the rows."""
    n = len(data) - match + 1
    if n <= 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(np.uint32)
    hashes = ROLL.windows(data, trigger)
    owner = window_owner(hashes, match - trigger + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + match <= offsets[row + 1]
    new = runs(owner, row) & inside
    start = np.flatnonzero(new)
    final = np.append(new[1:] | ~inside[1:], True) & inside
    count = np.flatnonzero(final) - start + 1
    row = row[start]
    phrase, check = span_hashes(data, start, start + count + match - 1)
    return row, start - offsets[row], count, hashes[owner[start]], phrase, (check >> np.uint64(32)).astype(np.uint32)


def stretches(offsets: np.ndarray, match: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Parts of the texts of about PIECE bytes: first and last row, first byte and where rows begin in it; a long text gives several, with
    the strings that cross their edges in the earlier one."""
    for a, b in pieces(offsets, PIECE):
        size = int(offsets[b] - offsets[a])
        if size <= PIECE:
            yield a, b, int(offsets[a]), offsets[a : b + 1] - offsets[a]
        else:
            for at in range(0, size, PIECE):
                yield a, b, int(offsets[a]) + at, np.array([0, min(size - at, PIECE + match - 1)])


def _parse(match: int, trigger: int, n: int):
    def combined(columns: list[np.ndarray]) -> list[pa.RecordBatch]:
        order = np.lexsort(tuple(columns[i] for i in (5, 4, 3, 6, 2, 1, 0)))
        key, phrase, check, doc, sub, first, count = (c[order] for c in columns)
        kept = np.sort(np.concatenate(docwork.firsts_and_later(runs(key, phrase, check, count), doc, sub, first)))
        key, phrase, check, doc, sub, first, count = (c[kept] for c in (key, phrase, check, doc, sub, first, count))
        new = runs(key, phrase, check, count)
        kind = np.where(new, _PLAIN, _LATER).astype(np.int8)
        by_key = runs(key)
        group = np.cumsum(by_key) - 1
        hot = np.bincount(group, weights=new) > HOT_LOCAL
        kind[hot[group] & new] = _HOT
        # trigger hashes are minima, and so small: they are mixed again to choose a bucket
        home = bucket_of(mix(key + np.uint64(1)), n)
        bucket = np.where(kind == _LATER, bucket_of(mix(doc.astype(np.uint64)), n), np.where(kind == _HOT, bucket_of(mix(phrase + np.uint64(1)), n), home))
        mark = np.flatnonzero(by_key)[hot]
        rows = np.append(np.arange(len(key)), mark)
        kind, bucket = np.append(kind, np.full(len(mark), _MARK, np.int8)), np.append(bucket, home[mark])
        return [blob_rows(bucket, [kind, *(c[rows] for c in (key, phrase, check, doc, sub, first, count))])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(combined, flush_rows(n))
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            docs, subs = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b, lo, edges in stretches(offsets, match):
                row, first, count, key, phrase, check = phrases(data[lo : lo + edges[-1]], edges, match, trigger)
                first += lo - offsets[a]
                yield from gather.add([key, phrase, check, docs[a:b][row], subs[a:b][row], first.astype(np.int32), count.astype(np.uint8 if match <= 256 else np.int32)])
        yield from gather.end()

    return run


def _dictionary(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Later occurrences, and the entries whose trigger another entry shares; those of hot triggers have no bucket."""
    columns, bucket = received(batches)
    if not columns:
        return
    kind, key, phrase, check, doc, sub, first, count = columns
    marked = np.unique(key[kind >= _HOT])
    order = np.lexsort((first, sub, doc, count, check, phrase, key))
    order = order[(kind[order] == _PLAIN) | (kind[order] == _HOT)]
    new = runs(key[order], phrase[order], check[order], count[order])
    firsts, again = docwork.firsts_and_later(new, doc[order], sub[order], first[order])
    later = np.concatenate([np.flatnonzero(kind == _LATER), order[again]])
    entries = order[firsts]
    group = np.cumsum(runs(key[entries])) - 1
    shared = np.bincount(group, minlength=1)[group] if len(entries) else group
    hot = np.isin(key[entries], marked) | (shared > HOT_BUCKET)
    for k, to, which in ((LATER, -1, later), (ENTRY, bucket, entries[~hot & (shared > 1)]), (ENTRY, -1, entries[hot])):
        if len(which):
            yield docwork.found_blobs(n, doc[which], sub[which], first[which], count[which], k, to)


def _entries(match: int, n: int):
    """The bytes of dictionary entries, to the buckets of their triggers; of hot triggers, the hashes of the strings."""

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
            rows, (first, count, bucket) = docwork.flat_spans(batch.column(3), ["first", "n", "bucket"])
            plain = bucket >= 0
            found = []
            for k, (row, at, size) in by_bucket(bucket[plain].astype(np.int32), [rows[plain], first[plain].astype(np.int32), count[plain].astype(np.int32)]):
                text = data[ragged(offsets[row] + at, size.astype(np.int64) + match - 1)]
                found.append((k, pack([docs[row], subs[row], at, size, text])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], schema=BLOBS)
            if plain.all():
                continue
            for a, b in pieces(offsets, PIECE):
                here = slice(*np.searchsorted(rows, [a, b]))
                row, at, size = (c[here][~plain[here]] for c in (rows, first.astype(np.int64), count.astype(np.int64)))
                if not len(row):
                    continue
                part = data[offsets[a] : offsets[b]]
                start, row = ragged(offsets[row] - offsets[a] + at, size), np.repeat(row, size)
                yield from gather.add([*span_hashes(part, start, start + match), docs[row], subs[row], (start + offsets[a] - offsets[row]).astype(np.int32)])
        yield from gather.end()

    return run


def common_lengths(strings: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each string has in common with the one before it in ``order``. ``strings``: a row each; ``ends``: their lengths."""
    out = np.zeros(len(order), dtype=np.int64)
    one, two = strings[order[1:]], strings[order[:-1]]
    differ = one != two
    out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return np.minimum(out, np.minimum(ends[order], np.append(0, ends[order[:-1]])))


def sorted_rows(strings: np.ndarray) -> np.ndarray:
    """The order of the rows of bytes."""
    wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : strings.shape[1]] = strings
    return np.lexsort(wide.view(">u8").astype(np.uint64).T[::-1])


def later_strings(text: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, rank: np.ndarray, match: int, trigger: int) -> tuple[np.ndarray, np.ndarray]:
    """Entry, and start in it, of each string that an entry of lesser ``rank`` has too, or the same entry earlier.

    Entries are text[begin : begin + size]; ``at``: where their trigger is. No string is twice in an entry with its
    trigger at the same place, so a string is known by its entry and the bytes it has before the trigger.
    """
    n, side = len(begin), match - trigger
    step = np.arange(match)
    # up to the trigger's end, read backwards; and what follows the trigger
    head, tail = np.minimum(at, side) + trigger, np.minimum(size - at - trigger, side)
    ends = begin + at + trigger
    heads = np.where(step < head[:, None], text[np.maximum(ends[:, None] - 1 - step, 0)], 0)
    tails = np.where(step[:side] < tail[:, None], text[np.minimum(ends[:, None] + step[:side], len(text) - 1)], 0)
    by_head, by_tail = sorted_rows(heads), sorted_rows(tails)
    common_head, common_tail = common_lengths(heads, head, by_head), common_lengths(tails, tail, by_tail)
    by_rank = np.argsort(rank, kind="stable")
    entry, start = [], []
    for before in range(side + 1):
        here = by_rank[((head >= before + trigger) & (tail >= side - before))[by_rank]]
        if len(here) < 2:
            continue
        one, two = np.empty(n, np.int64), np.empty(n, np.int64)
        one[by_head] = np.cumsum(common_head < before + trigger)
        two[by_tail] = np.cumsum(common_tail < side - before)
        both = one[here] * (n + 1) + two[here]
        order = np.argsort(both, kind="stable")
        again = here[order[~runs(both[order])]]
        entry.append(again)
        start.append(at[again] - before)
    return (np.concatenate(entry), np.concatenate(start)) if entry else (np.empty(0, np.int64), np.empty(0, np.int64))


#: Bytes of dictionary that are ordered together.
SUFFIX_BYTES = 1 << 20


def _suffix_order(match: int, trigger: int, n: int):
    """Strings of the entries that start earlier in another entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, _ = received_kinds(batches)
        if 6 in found:
            passed, key, check, doc, sub, at = found[6]
            order = np.lexsort((at, sub, doc, check, key))
            order = order[~passed[order]]
            _, again = docwork.firsts_and_later(runs(key[order], check[order]), doc[order], sub[order], at[order])
            later = np.concatenate([np.flatnonzero(passed), order[again]])
            if len(later):
                yield docwork.found_blobs(n, doc[later], sub[later], at[later], 1, LATER)
        if 5 not in found:
            return
        doc, sub, first, count, text = found[5]
        size = count.astype(np.int64) + match - 1
        begin = np.cumsum(size) - size
        # strings with a common trigger meet; the dictionary part is cut between triggers
        key, place = np.empty(len(doc), np.uint64), np.empty(len(doc), np.int64)
        for lo, hi in pieces(np.append(begin, begin[-1] + size[-1]), PIECE):
            part = text[begin[lo] : begin[hi - 1] + size[hi - 1]]
            hashes = ROLL.windows(part, trigger)
            # an entry's trigger is the one place that is the least in the first string
            at = begin[lo:hi] - begin[lo]
            stretch = hashes[at[:, None] + np.arange(match - trigger + 1)]
            place[lo:hi] = (stretch >> np.uint64(PLACE_BITS)).argmin(axis=1)
            key[lo:hi] = stretch[np.arange(hi - lo), place[lo:hi]]
        # a string of an entry starts as far before its trigger as an equal string of another entry, so one order serves all.
        # repeated rows send their entries again
        by_place = np.lexsort((first, first + place, sub, doc))
        by_place = by_place[runs(doc[by_place], sub[by_place], first[by_place])]
        rank = np.empty(len(doc), np.int64)
        rank[by_place] = np.arange(len(by_place))
        order = by_place[np.argsort(key[by_place], kind="stable")]
        total = np.cumsum(size[order])
        groups = np.append(np.flatnonzero(runs(key[order])), len(order))
        lo = 0
        while lo < len(order):
            # as many whole groups as fit, or one
            done = total[lo - 1] if lo else 0
            fit = int(np.searchsorted(total[groups[1:] - 1], done + SUFFIX_BYTES, side="right"))
            hi = int(groups[max(fit, int(np.searchsorted(groups, lo, side="right")))])
            own = order[lo:hi]
            entry, start = later_strings(text, begin[own], size[own], place[own], rank[own], match, trigger)
            entry = own[entry]
            if len(entry):
                yield docwork.found_blobs(n, doc[entry], sub[entry], first[entry] + start, 1, LATER)
            lo = hi

    return run


RESULT_DDL = "k_doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _kept(match: int, with_bytes: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            rows, (first, count) = docwork.flat_spans(batch.column(3), ["first", "n"])
            out: list[list] = [[], [], [], [], []]
            for a, b in pieces(offsets, PIECE):
                part, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                here = slice(*np.searchsorted(rows, [a, b]))
                begin = edges[rows[here] - a] + first[here]
                gone = covered(begin, begin + count[here] + match - 1, len(part))
                for k in range(b - a):
                    own = gone[edges[k] : edges[k + 1]]
                    text = part[edges[k] : edges[k + 1]][~own].tobytes()
                    n_spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + own[:1].sum())
                    for column, value in zip(out, (len(own), len(own) - len(text), n_spans, hashlib.sha256(text).hexdigest(), text if with_bytes else None), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], names=["k_doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, trigger: int = TRIGGER, with_bytes: bool = True) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that are left; null
    if not ``with_bytes``; they needn't be valid UTF-8).

    A byte goes if it is in a string of ``match`` bytes that also starts earlier: in a document of smaller id (a
    null id is the least; of equal ids, that of the smaller text hash), or earlier in its document. Null text is
    empty. Repeated rows (same id and text) are one document: each such row is judged like the first. Texts
    shorter than ``match`` are kept whole. A text of any length is one document, parsed a stretch at a time; its result needs
    some six times its bytes in one Python worker. An empty table gives an empty result; other columns aren't read.
    """
    if not 0 < trigger < match:
        raise ValueError("the trigger must be shorter than the match")
    n = buckets(df)
    docs = docwork.keyed(df, id_col, text_col)
    parsed = deal(docs.mapInArrow(_parse(match, trigger, n), BLOBS_DDL), n)
    found = cut(docwork.by_document(parsed.mapInArrow(lambda it: _dictionary(it, n), BLOBS_DDL), n), "phrases")
    entries = docwork.with_found(docs, found.filter(F.col("kind") != LATER), "inner", ["bucket"])
    sent = deal(entries.select("k_doc", "k_sub", "text", "spans").mapInArrow(_entries(match, n), BLOBS_DDL), n)
    more = cut(docwork.by_document(sent.mapInArrow(_suffix_order(match, trigger, n), BLOBS_DDL), n), "suffixes")
    later = found.filter(F.col("kind") == LATER).unionByName(more)
    out = docwork.with_found(docs, later, "left").select("k_doc", "k_sub", "text", "spans").mapInArrow(_kept(match, with_bytes), RESULT_DDL)
    return out.select(docwork.doc_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes)


#: DuckDB SQL for remove_repeated_bytes() over ``documents``, without the bytes. Places are bytes; two hexadecimal digits each.
ORACLE_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, unnest(generate_series(0, (length(h) // 2)::bigint - 1)) as pos, h from d where length(h) > 0),
k as (select doc_id, pos, md5(substr(h, 2 * pos + 1, 200)) as key from s where pos <= (length(h) // 2)::bigint - 100),
r as (select doc_id, pos, row_number() over (partition by key order by doc_id, pos) > 1 as again from k),
m as (select s.doc_id, s.pos, substr(s.h, 2 * s.pos + 1, 2) as b, coalesce(r.again, false) as again from s left join r on s.doc_id = r.doc_id and s.pos = r.pos),
c as (select doc_id, pos, b, max(again::int) over (partition by doc_id order by pos rows between 99 preceding and current row) = 1 as gone from m),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as begins from c),
g as (select doc_id, sum(gone::int)::bigint as n_removed, sum(begins::int)::bigint as n_spans, coalesce(string_agg(case when not gone then b end, '' order by pos), '') as kept from e group by doc_id)
select d.doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(g.n_removed, 0)::bigint as n_removed, coalesce(g.n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(g.kept, ''))) as kept_sha256
from d left join g on d.doc_id = g.doc_id
"""
