"""Token-id output as one wavelet matrix per shard.

A shard file holds the ids of consecutive documents, in id order, as succinct bit-planes: plane by plane from the highest bit,
ids are parted stably into those with a 0 and those with a 1. With counts of ones before each block (rank), the file
gives the token at any place, how often a token occurs before a place, and the place of its k-th occurrence,
reading only the blocks on the way; blocks are compressed one by one.

Layout, little endian: magic ``LFWM1\\0``; u32 length and JSON header (n, bits, zeros of each plane, n_docs,
block table sizes); document ids (i64), null flags (u8) and token counts (u32), compressed; for each plane the
ones before each block (u32) and the end of each block's bytes (u32); then the blocks' bytes.

Scale: documents are dealt by ranges of their id and encoded in order, so a shard's size is bounded and all
starts follow from one number a shard. Files are written by Spark's Parquet writer, one file format blob a row,
so any store that Spark can write to will do.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .exchange import buckets
from .textops import OWN_BITS, eights, pieces, ragged, span_hashes, text_bytes

MAGIC = b"LFWM1\0"
#: Bits of a plane that are compressed together, and counted together for rank.
BLOCK_BITS = 1 << 16
#: Tokens of a shard; a document with more is a shard of its own.
SHARD_TOKENS = 2 << 20
END_ID = 2
#: Bytes of the longest part whose ids are kept.
LONGEST = 64


class WaveletMatrix:
    """A shard file. Blocks are decompressed when they are first needed."""

    def __init__(self, blob: bytes):
        if blob[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack_from("<I", blob, len(MAGIC))
        at = len(MAGIC) + 4
        head = json.loads(blob[at : at + size])
        at += size
        self.blob, self.n, self.bits, self.zeros, self.n_docs = blob, head["n"], head["bits"], head["zeros"], head["n_docs"]
        widen = zstandard.ZstdDecompressor()
        docs = widen.decompress(blob[at : at + head["docs"]], max_output_size=max(1, self.n_docs * 13)) if self.n_docs else b""
        at += head["docs"]
        self.ids = np.frombuffer(docs, "<i8", self.n_docs)
        self.nulls = np.frombuffer(docs, np.uint8, self.n_docs, self.n_docs * 8)
        self.counts = np.frombuffer(docs, "<u4", self.n_docs, self.n_docs * 9)
        blocks = -(-self.n // BLOCK_BITS)
        table = np.frombuffer(blob, "<u4", 2 * blocks * self.bits, at).reshape(self.bits, 2, blocks)
        self.ones, ends = table[:, 0], table[:, 1]
        at += table.nbytes
        self.spans = [[(at + int(a), at + int(b)) for a, b in zip(np.append(0, e[:-1]) if k == 0 else np.append(ends[k - 1][-1], e[:-1]), e, strict=True)] for k, e in enumerate(ends)] if blocks else [[] for _ in range(self.bits)]
        self._cache: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def build(tokens: np.ndarray, bits: int, ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1)
        v = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
        n, zeros, ones, ends, parts, at = len(v), [], [], [], [], 0
        for k in range(bits - 1, -1, -1):
            mask = (v & v.dtype.type(1 << k)) != 0
            packed = np.packbits(mask, bitorder="little")
            full = np.zeros(-(-n // BLOCK_BITS) * (BLOCK_BITS // 8), dtype=np.uint8)
            full[: len(packed)] = packed
            blocks = full.reshape(-1, BLOCK_BITS // 8)
            count = np.bitwise_count(full.view(np.uint64)).reshape(len(blocks), BLOCK_BITS // 64).sum(axis=1, dtype=np.int64)
            ones.append((np.cumsum(count) - count).astype("<u4"))
            for block in blocks:
                parts.append(squeeze.compress(block.tobytes()))
                at += len(parts[-1])
                ends.append(at)
            zero = v[~mask]
            zeros.append(len(zero))
            v = np.concatenate([zero, v[mask]])
        docs = squeeze.compress(ids.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + counts.astype("<u4").tobytes()) if len(ids) else b""
        head = json.dumps({"n": n, "bits": bits, "zeros": zeros, "n_docs": len(ids), "docs": len(docs)}).encode()
        per = -(-n // BLOCK_BITS)
        table = np.stack([np.stack(ones), np.array(ends, "<u4").reshape(bits, per)], axis=1).astype("<u4") if per else np.empty(0, "<u4")
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, docs, table.tobytes(), *parts])

    def _bits(self, plane: int, block: int) -> np.ndarray:
        key = (plane, block)
        if key not in self._cache:
            a, b = self.spans[plane][block]
            raw = zstandard.ZstdDecompressor().decompress(self.blob[a:b], max_output_size=BLOCK_BITS // 8)
            self._cache[key] = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return self._cache[key]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i == 0:
            return 0
        block, rest = divmod(i, BLOCK_BITS)
        if rest == 0:
            block, rest = block - 1, BLOCK_BITS
        return int(self.ones[plane][block]) + int(self._bits(plane, block)[:rest].sum(dtype=np.int64))

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = int(self._bits(plane, i // BLOCK_BITS)[i % BLOCK_BITS])
            one = self._rank1(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + one if bit else i - one
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token < 0 or token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self._rank1(plane, lo), self._rank1(plane, hi)
            if token >> (self.bits - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                lo, hi = lo - a, hi - b
            if lo >= hi:
                return 0, 0
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token occurs in places [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) 0 or 1 of a plane."""
        before = self.ones[plane].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK_BITS - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        where = np.flatnonzero(self._bits(plane, block) == bit)
        return block * BLOCK_BITS + int(where[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0; -1 if there are fewer."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for plane in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - plane) & 1
            i = self._select(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens: planes are merged from the lowest up, each undoing its parting."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        widen = zstandard.ZstdDecompressor()
        for plane in range(self.bits - 1, -1, -1):
            raw = b"".join(widen.decompress(self.blob[a:b], max_output_size=BLOCK_BITS // 8) for a, b in self.spans[plane])
            mask = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n].view(bool)
            z, here = self.zeros[plane], np.empty(self.n, dtype=kind)
            here[~mask] = out[:z]
            here[mask] = out[z:] | kind(1 << (self.bits - 1 - plane))
            out = here
        return out


class HashTable:
    """64-bit keys to their numbers, in open addressing; looks up and adds arrays of keys. Key 0 is taken for 1."""

    def __init__(self, room: int):
        self.bits = max(4, (2 * room).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.numbers = np.zeros(1 << self.bits, dtype=np.int32)
        self.n = 0

    def _start(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.maximum(keys, np.uint64(1))
        return keys, (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers, -1 for unknown ones."""
        keys, at = self._start(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.numbers[at], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.numbers[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct unknown keys, which get the next numbers in their order."""
        keys, at = self._start(keys)
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            own = free[self.keys[at[free]] == keys[free]]  # of keys for one place the last was written
            self.numbers[at[own]] = numbers[own]
            done = np.zeros(len(keys), dtype=bool)
            done[own] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)


def same_bytes(view: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray, other: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Which spans of ``view`` (from eights()) hold the same bytes as the spans of ``text``."""
    out = size == other_size
    there = eights(text)
    left = np.flatnonzero(out & (size > 0))
    at, to, room = start[left], other[left], size[left]
    while len(left):
        differ = (view[at] ^ there[to]) & OWN_BITS[np.minimum(room, 8)] != 0
        out[left[differ]] = False
        more = ~differ & (room > 8)
        left, at, to, room = left[more], at[more] + 8, to[more] + 8, room[more] - 8
    return out


class Encoder:
    """Encodes batches of texts; each distinct stretch of text between safe places is encoded once.

    A text may be cut before a single space between two characters that surely aren't white space: the tokenizer's
    word pattern always begins a new word there, so the parts' ids joined are the text's ids. Ids and bytes of the first
    ``memory`` distinct parts of up to ``LONGEST`` bytes are kept by their hash; a part found there is compared byte by byte.
    """

    def __init__(self, path: str, memory: int = 1_500_000):
        # a task has one core; the library's threads would only compete with other tasks'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, END_ID)).bit_length())
        self.memory, self.known = memory, HashTable(memory)
        self.begin, self.size = np.zeros(memory, np.int64), np.zeros(memory, np.int32)
        self.pool, self.used = np.empty(1 << 20, dtype=np.uint32), 0
        self.text, self.text_used = np.zeros(1 << 20, dtype=np.uint8), 0
        self.text_begin, self.text_size = np.zeros(memory, np.int64), np.zeros(memory, np.int64)
        letters = {k: len(token) for token, k in self.tokenizer.get_vocab(with_added_tokens=True).items()}  # byte-level: one letter a byte
        self.width = np.zeros(max(letters) + 1, dtype=np.int64)
        self.width[list(letters)] = list(letters.values())

    def _encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, joined, and how many each has. All but the last ``alone`` parts begin at a safe place and end before one,
        so many of them are encoded as one text."""
        joined, size = len(start) - alone, end - start
        groups = list(range(0, joined, 1000)) + [joined]
        texts = [data[ragged(start[a:b], size[a:b])].tobytes().decode() for a, b in zip(groups, groups[1:], strict=False)]
        texts += [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[joined:].tolist(), end[joined:].tolist(), strict=True)]
        ids = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = [np.empty(0, np.int64)]
        for k, (a, b) in enumerate(zip(groups, groups[1:], strict=False)):
            cuts = np.searchsorted(np.cumsum(self.width[ids[k]]), np.cumsum(size[a:b])) + 1
            counts.append(np.diff(cuts, prepend=0))
        counts.append(np.array([len(x) for x in ids[len(groups) - 1 :]], dtype=np.int64))
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.concatenate(counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and of each row how many."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        place = np.flatnonzero(data == 0x20)
        place = place[(place > 0) & (place < n - 1)]
        before, after, two = data[place - 1], data[place + 1], data[np.maximum(place - 2, 0)]
        plain = lambda x: (x > 0x20) & (x < 0x7F)
        place = place[(plain(before) | ((two == 0xC3) & (place > 1))) & (plain(after) | (after == 0xC3))]
        safe = np.zeros(n + 1, dtype=bool)
        safe[place] = True
        # at a row's edges nothing is known of the neighbour
        for edge in (offsets[:-1], offsets[1:] - 1):
            safe[edge[(edge >= 0) & (edge < n)]] = False
        begins = safe[:n].copy()
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        full = np.flatnonzero(begins)
        ends = np.append(full[1:], n)
        (key,) = span_hashes(data, full, ends, 1)
        number = self.known.find(key).astype(np.int64)
        view = eights(data)
        hit = np.flatnonzero(number >= 0)
        same = same_bytes(view, full[hit], ends[hit] - full[hit], self.text[: self.text_used], self.text_begin[number[hit]], self.text_size[number[hit]])
        number[hit[~same]] = -1
        new = np.flatnonzero(number < 0)
        pool = self.pool
        begin, size = self.begin[number], self.size[number].astype(np.int64)
        if len(new):
            _, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            # parts with an equal hash and other bytes are encoded for themselves
            at = new[first[which]]
            same = same_bytes(view, full[new], ends[new] - full[new], data, full[at], ends[at] - full[at])
            at = np.append(new[first], new[~same])
            which[~same] = np.arange(len(first), len(at))
            alone = ~(safe[full[at]] & safe[ends[at]])
            order = np.argsort(alone, kind="stable")
            fresh, counts = self._encode(data, full[at][order], ends[at][order], int(alone.sum()))
            starts = self.used + np.cumsum(counts) - counts
            # kept: parts of a new hash, which aren't too long, as many as there is room for
            own = at[order]
            fits = np.flatnonzero((order < len(first)) & (ends[own] - full[own] <= LONGEST) & (self.known.find(key[own]) < 0))[: self.memory - self.known.n]
            if len(fits):
                lo, hi = self.known.n, self.known.n + len(fits)
                own = own[fits]
                self.known.add(key[own])
                bytes_, text = ends[own] - full[own], data[ragged(full[own], ends[own] - full[own])]
                while self.text_used + len(text) > len(self.text):
                    self.text = np.concatenate([self.text, np.zeros_like(self.text)])
                self.text[self.text_used : self.text_used + len(text)] = text
                self.text_size[lo:hi], self.text_begin[lo:hi] = bytes_, self.text_used + np.cumsum(bytes_) - bytes_
                self.text_used += len(text)
                self.begin[lo:hi], self.size[lo:hi] = starts[fits], counts[fits]
            while self.used + len(fresh) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            pool = self.pool
            pool[self.used : self.used + len(fresh)] = fresh
            # what lies behind the last kept part is overwritten by the next batch
            self.used += int((starts - self.used + counts)[fits[-1]]) if len(fits) else 0
            back = np.empty(len(order), dtype=np.int64)
            back[order] = np.arange(len(order))
            begin[new], size[new] = starts[back[which]], counts[back[which]]
        sums = np.append(0, np.cumsum(size))
        return pool[ragged(begin, size)], np.diff(sums[np.searchsorted(full, offsets)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder, which lives as long as the worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES_DDL = "part int, seq int, n_tokens long, blob binary"


def _written(path: str, end_id: int, shard_tokens: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(path)
        bits = max(enc.bits, int(end_id).bit_length())
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, total, seq
            tokens, ids, nulls, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            blob = WaveletMatrix.build(tokens, bits, ids, nulls, counts)
            held, total, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq - 1], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_tokens", "blob"])

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, nulls = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for a, b in pieces(offsets):
                found, counts = enc.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                stops = np.cumsum(counts + 1)
                tokens = np.full(int(stops[-1]), end_id, dtype=np.uint32)
                own = np.ones(len(tokens), dtype=bool)
                own[stops - 1] = False
                tokens[own] = found
                held.append((tokens, ids[a:b], nulls[a:b], counts + 1))
                total += len(tokens)
                if total >= shard_tokens:
                    yield emit()
        if held:
            yield emit()

    return run


def write_shards(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> DataFrame:
    """Shard files as rows (part, seq, n_tokens, blob), in ascending order of the document id over (part, seq); null ids first.

    Documents of equal id follow in the order of their texts' hash. Null text is empty: only the end id.
    """
    text = F.col(f"`{text_col}`")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    # rows that share an id, or have none, are told apart by their texts
    dealt = docs.repartitionByRange(partitions or buckets(df), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.mapInArrow(_written(tokenizer_path, end_id, shard_tokens), FILES_DDL)


READ_DDL = "part int, seq int, row int, doc_id long, before long, n_tokens long, ids_crc32 long"


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            shard = WaveletMatrix(blob.as_py())
            tokens = shard.tokens().astype("<u4")
            stops = np.cumsum(shard.counts.astype(np.int64))
            starts = stops - shard.counts
            n = shard.n_docs
            crc = [zlib.crc32(tokens[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(shard.ids, mask=shard.nulls.astype(bool)), pa.array(starts), pa.array(shard.counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "seq", "row", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_shards(files: DataFrame) -> DataFrame:
    """One row a document: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32.

    ``files``: rows of write_shards(). Null ids stay null, repeated ids give a row each, no files give no rows. The tokens of a range are
    summed first; only the ranges, one a shuffle partition, meet in one task.
    """
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sums.select("part", before.alias("part_start"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("part", "seq", within.alias("within")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("within")).alias("shard_start"))
    docs = files.select("part", "seq", "blob").mapInArrow(_read, READ_DDL)
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encode, write the shard files into the shared folder and read them back; see write_shards(), read_shards().

    An empty table gives no file and an empty result. Repeated rows are documents of their own. Other columns aren't read.
    """
    return read_shards(cut(write_shards(df, tokenizer_path, id_col, text_col, end_id), "tokens"))
