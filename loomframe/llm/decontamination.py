"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: positions with a 1 are hashed, the others are ignored, so that
a substituted word spoils only the seeds that look at it. Seeds of the benchmark items and of all documents are
joined by hash; around each hit the item and the document are laid on each other, and the longest
stretch in which at least 80% of the words agree must be long enough. The masks miss no overlap with so many
substitutions in 13 to 30 words, wherever they are, and no short item.

Scale: documents are read once for each block of the benchmark and never shuffled. A block's words are broadcast; its
size is bounded, and a larger benchmark is worked off in more blocks, so no item is left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, word_count
from .textops import U64, mix, pieces, ragged, span_hashes, text_bytes, word_spans

#: Masks of weight 6. However three of 15 words are substituted, one of the masks fits between them; the same holds for a fifth of 13 to 30 words.
MASKS = ("1111011", "110110101", "1010011011", "11100101001", "1110100011")
#: For items of MIN_OVERLAP words or fewer: one fits in 4 to 13 words of which a fifth is substituted, the first and last ones included.
SHORT_MASKS = ("1111", "11011", "11101", "10111")
#: Words that must lie on each other, or the whole item if it is shorter.
MIN_OVERLAP = 13
SIMILARITY = 0.8
#: Items of fewer words say too little to be looked for; four words is the least that the masks can find.
LEAST_WORDS = 7
#: Hits, and words laid on each other, that are held at a time.
HITS, CELLS = 1 << 18, 1 << 22
#: Benchmark words that are broadcast at a time: 8 MB of hashes.
BLOCK_WORDS = 1_000_000

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0x94D049BB133111EB], dtype=U64)


def plain_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a text column: first and last row, word hashes, and each row's first word (one more than
    rows). Words are in lower case, without ASCII punctuation at either end; words of nothing else don't count."""
    data, offsets = text_bytes(pc.utf8_lower(column))
    for a, b in pieces(offsets):
        part, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, edges)
        left = np.arange(len(starts))
        while len(left := left[(starts[left] < ends[left]) & _PUNCTUATION[part[np.minimum(starts[left], len(part) - 1)]]]):
            starts[left] += 1
        left = np.arange(len(starts))
        while len(left := left[(starts[left] < ends[left]) & _PUNCTUATION[part[ends[left] - 1]]]):
            ends[left] -= 1
        full = starts < ends
        first = np.append(0, np.cumsum(full))[first]
        yield a, b, span_hashes(part, starts[full], ends[full], 1)[0], first


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each place where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    h = np.zeros(n, dtype=U64)
    for k, at in enumerate(i for i, c in enumerate(mask) if c == "1"):
        h += words[at : at + n] * _FACTORS[k % len(_FACTORS)] * U64(2 * k + 1)
    return mix(h)


class Index:
    """Seeds of a block of benchmark items. ``words``: all items' word hashes; ``first``: where each begins; ``masks``: those of
    items of more than ``short`` words, and those of the others, if they have ``least`` words."""

    def __init__(self, words: np.ndarray, first: np.ndarray, masks: tuple[tuple[str, ...], tuple[str, ...]], short: int, least: int):
        self.words, self.first = words, first
        size = np.diff(first)
        item = np.repeat(np.arange(len(size)), size)
        wanted = (size > short) & (size >= least), (size <= short) & (size >= least)
        self.tables = []
        for mask, sought in ((m, w) for ms, w in zip(masks, wanted, strict=True) for m in ms):
            key = seeds(words, mask)
            at = np.arange(len(key))
            inside = sought[item[at]] & (at + len(mask) <= first[item[at] + 1]) if len(at) else np.empty(0, bool)
            key, at = key[inside], at[inside]
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            bits = min(24, max(16, len(key).bit_length() + 6))
            sieve = np.zeros(1 << bits, dtype=bool)
            sieve[key >> U64(64 - bits)] = True
            self.tables.append((mask, key[order], at[order], sieve, U64(64 - bits)))

    def hits(self, words: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """(row, item, place in the row minus place in the item) of all seed hits, some HITS at a time; distinct in each part."""
        for mask, keys, places, sieve, shift in self.tables:
            h = seeds(words, mask)
            at = np.flatnonzero(sieve[h >> shift])
            low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            row = np.searchsorted(first, at, side="right") - 1
            use = (high > low) & (at + len(mask) <= first[row + 1])
            at, low, count, row = at[use], low[use], (high - low)[use], row[use]
            for a, b in portions(count, HITS):
                n = count[a:b]
                place = places[ragged(low[a:b], n)]
                item = np.searchsorted(self.first, place, side="right") - 1
                yield np.unique(np.stack([np.repeat(row[a:b], n), item, np.repeat(at[a:b] - first[row[a:b]], n) - (place - self.first[item])], axis=1), axis=0)


def portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive sizes that add up to ``most`` or less, or hold one."""
    sums, a = np.append(0, np.cumsum(sizes)), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(sums, sums[a] + most, side="right")) - 1)
        yield a, b
        a = b


def longest_stretch(same: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """Begin, length and agreeing words of the longest stretch that begins and ends with words that agree, and of which
    a share of ``similarity`` agrees; the first of equals."""
    part = np.round(np.append(0, np.cumsum(np.where(same, 1.0 - similarity, -similarity))), 9)
    low = np.minimum.accumulate(np.where(np.append(same, False), part, np.inf))
    high = np.maximum.accumulate(np.where(np.append(False, same), part, -np.inf)[::-1])[::-1]
    # for each end the earliest begin that is as low: both are monotone, so two pointers suffice
    best, begin, i = 0, 0, 0
    for j in range(len(part)):
        while i < len(low) and i <= j and low[i] > high[j]:
            i += 1
        if j - i > best:
            best, begin = j - i, i
    return begin, best, int(same[begin : begin + best].sum())


def matches(index: Index, words: np.ndarray, first: np.ndarray, min_overlap: int, similarity: float, once: bool = False) -> list[tuple[int, int, int, int, int]]:
    """(row, item, overlap, agreeing words, first word in the row) of each verified pair, the best of its alignments; with ``once`` any one pair of each row.

    Agreeing words are counted for all alignments at once; only where they could suffice is the stretch looked for.
    """
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    seen: set[tuple[int, int, int]] = set()
    done = np.zeros(len(first) - 1, dtype=bool)
    for found in index.hits(words, first):
        if once:
            found = found[~done[found[:, 0]]]
        row, item, shift = found.T
        own, text = index.first[item + 1] - index.first[item], first[row + 1] - first[row]
        lo = np.maximum(0, -shift)
        size = np.minimum(own, text - shift) - lo
        must = np.minimum(min_overlap, own)
        use = size >= must
        found, lo, size, must = found[use], lo[use], size[use], must[use]
        row, item, shift = found.T
        mine, theirs = first[row] + lo + shift, index.first[item] + lo
        for a, b in portions(size, CELLS):
            n = size[a:b]
            same = words[ragged(mine[a:b], n)] == index.words[ragged(theirs[a:b], n)]
            ends = np.cumsum(n)
            agree = np.diff(np.append(0, np.cumsum(same))[np.append(0, ends)])
            for k in np.flatnonzero(agree >= similarity * must[a:b] - 1e-9).tolist():
                r, i, by = hit = tuple(found[a + k].tolist())
                if hit in seen or (once and done[r]):
                    continue
                seen.add(hit)
                whole = index.first[i + 1] - index.first[i] <= min_overlap
                begin, length, equal = (0, int(n[k]), int(agree[k])) if whole else longest_stretch(same[ends[k] - n[k] : ends[k]], similarity)
                if length >= must[a + k]:
                    score = (equal, length, -(int(lo[a + k]) + by + begin))
                    best[r, i] = max(best.get((r, i), score), score)
                    done[r] = True
    return [(row, item, size, agree, -at) for (row, item), (agree, size, at) in best.items()]


_ready: dict[str, Index] = {}


def _index(sent) -> Index:
    """The block's index, built once in each Python worker."""
    token, words, first, *how = sent.value
    if token not in _ready:
        _ready.clear()
        _ready[token] = Index(np.frombuffer(words, dtype=U64), np.frombuffer(first, dtype=np.int64), *how)
    return _ready[token]


def blocks(benchmark: DataFrame, item_col: str, text_col: str, how: tuple, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list, object]]:
    """Blocks of the benchmark: item ids, and the broadcast words with ``how``, the rest of what Index takes. Items without words are
    left out, as nothing can match them."""
    spark, text = benchmark.sparkSession, F.col(f"`{text_col}`")
    benchmark = benchmark.filter(text.rlike(WORD))
    total = benchmark.agg(F.sum(word_count(text))).first()[0] or 0
    n = max(1, -(-2 * total // block_words)) if total > block_words else 1
    for k in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64(F.col(f"`{item_col}`"), text), F.lit(n)) == k) if n > 1 else benchmark
        items = part.select(F.col(f"`{item_col}`").alias("item"), text.alias("text")).toArrow()
        column = items["text"].combine_chunks().cast(pa.large_string())
        words, first = [np.empty(0, U64)], [np.zeros(1, np.int64)]
        for _, _, w, f in plain_words(column):
            first.append(f[1:] + sum(map(len, words)))
            words.append(w)
        token = f"{spark.sparkContext.applicationId}-{id(items)}-{k}-{np.random.default_rng().integers(1 << 62)}"
        yield items["item"].to_pylist(), spark.sparkContext.broadcast((token, np.concatenate(words).tobytes(), np.concatenate(first).tobytes(), *how))


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS, min_overlap: int = MIN_OVERLAP, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, overlap, n_same, start.

    ``overlap``: words of the longest stretch, from one word that agrees to another, with at least ``similarity`` of its words the same, more than
    ``min_overlap`` or as many; of an item of so many words or fewer, all of them, of which as large a share must agree, at its ends or not. ``start``: its first word in the document. Words: see plain_words(). Items
    of fewer than ``least_words`` words aren't looked for, as they say too little. Null or
    empty texts match nothing; null ids stay null; each of repeated rows gives its own result rows; an empty
    documents or benchmark table gives an empty result. Other columns aren't read.
    """
    out = None
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("item", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("overlap", "n_same", "start"))])
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    for items, sent in blocks(benchmark, item_col, item_text_col, ((masks, short_masks), min_overlap, least_words), block_words):

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent)
            for batch in batches:
                ids, found = batch.column(0), []
                for a, _, words, first in plain_words(batch.column(1)):
                    found += [(row + a, *rest) for row, *rest in matches(index, words, first, min_overlap, similarity)]
                columns = list(zip(*sorted(found), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=schema.names)

        names = docs.sparkSession.createDataFrame([(k, x) for k, x in enumerate(items)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]))
        part = docs.mapInArrow(run, schema).join(F.broadcast(names), "item").select("doc_id", "item_id", "overlap", "n_same", "start")
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS, min_overlap: int = MIN_OVERLAP, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``df`` that overlap no benchmark item (see contaminated()), all columns unchanged.

    Null and empty texts overlap nothing and stay; repeated rows stay or go together; with an empty benchmark all rows stay. A row's other
    columns are passed through whatever their names.
    """
    at = df.columns.index(text_col)
    for _, sent in blocks(benchmark, item_col, item_text_col, ((masks, short_masks), min_overlap, least_words), block_words):

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for a, _, words, first in plain_words(batch.column(at)):
                    for row, *_ in matches(index, words, first, min_overlap, similarity, once=True):
                        keep[row + a] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df
