"""Vectorised work on the bytes of a batch of texts: words, hashes of spans and windows, window minima. NumPy only.

Spans of bytes (words, lines, phrases) are hashed eight bytes at a time, each step a bijection of all 64 bits of the state;
spans over LONG bytes by BLAKE2b. Windows of spans are hashed by combining halves. Both come in two variants whose states never
meet, so that they are independent: together 128 bits. ``Roller`` is the rolling hash over bytes, modulo 2^64; such
a polynomial has structured collisions, so it only chooses places and never decides equality.

Texts of any length are worked on in blocks of PIECE bytes or SPANS spans; what remains are a few numbers a word or line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MASK = (1 << 64) - 1
#: Bytes of text that are worked on at a time.
PIECE = 2 << 20
#: Spans that are hashed at a time.
SPANS = 1 << 18
#: Longer spans are hashed one by one.
LONG = 256


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, x = [], seed & _MASK
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """``h`` with its bits spread, in place; a bijection."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


#: For each variant of hash: a seed for lengths, an odd factor for each step, a seed for halves.
_SEEDS = [[U64(int(x) | 1) for x in _splitmix(seed, 3)] for seed in (11, 23)]
#: By bytes left in a span, 8 or more as 8: which bits of the next eight bytes are its own.
OWN_BITS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, without copying them; zeros follow the data."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, variants: int = 2) -> list[np.ndarray]:
    """The hashes of the byte spans [start, end), one array for each variant."""
    out = [np.empty(len(starts), dtype=U64) for _ in range(variants)]
    view = eights(data)
    for at in range(0, len(starts), SPANS):
        part = slice(at, at + SPANS)
        for whole, h in zip(out, _span_hashes(data, view, starts[part], ends[part], variants), strict=True):
            whole[part] = h
    return out


def _span_hashes(data: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray, variants: int) -> list[np.ndarray]:
    size = ends - starts
    seeds = _SEEDS[:variants]
    out = [mix(size.astype(U64) * factor + seed) for seed, factor, _ in seeds]
    long = np.flatnonzero(size > LONG)
    for k in long.tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=16).digest()
        for v, h in enumerate(out):
            h[k] = int.from_bytes(digest[8 * v : 8 * v + 8], "little")
    if len(long):
        size = np.where(size > LONG, 0, size)
    left = np.flatnonzero(size)
    at, room = starts[left], size[left]
    while len(left):
        eight = view[at]
        eight &= OWN_BITS[np.minimum(room, 8)]
        for h, (_, factor, _) in zip(out, seeds, strict=True):
            h[left] = mix((h[left] ^ eight) * factor)
        more = room > 8
        left, at, room = left[more], at[more] + 8, room[more] - 8
    return out


def _joined(a: np.ndarray, b: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = mix(a + seed)
    h += b
    return mix(h)


def window_hashes(h: np.ndarray, width: int, variant: int = 0) -> np.ndarray:
    """The hash of the ``width`` values from each place on where they fit, from ``h`` of the same variant."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    seed = _SEEDS[variant][2]
    out, done, power, span = None, 0, h, 1
    while True:
        if width & span:
            part = power[done : done + n]
            out = _joined(out, part, seed) if out is not None else mix(part + seed)
            done += span
        if done == width:
            return out
        power, span = _joined(power[:-span], power[span:], seed), 2 * span


class Roller:
    """The rolling hash of windows of bytes: a polynomial modulo 2^64 over random byte values, by prefix sums, then mixed."""

    def __init__(self, seed: int):
        values = _splitmix(seed, 257)
        self.bytes = values[:256]
        self.base = int(values[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=U64)

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 2 * len(self.powers), 1 << 16)
            self.powers = np.full(size, self.base, dtype=U64)
            self.inverses = np.full(size, self.inverse, dtype=U64)
            self.powers[0] = self.inverses[0] = 1
            np.multiply.accumulate(self.powers, out=self.powers)
            np.multiply.accumulate(self.inverses, out=self.inverses)

    def windows(self, data: np.ndarray, width: int) -> np.ndarray:
        """The hash of the window of ``width`` bytes at each place; empty if none fits."""
        n = len(data) - width + 1
        if n <= 0:
            return np.empty(0, dtype=U64)
        self._grow(len(data))
        sums = np.zeros(len(data) + 1, dtype=U64)
        np.multiply(self.bytes[data], self.powers[: len(data)], out=sums[1:])
        np.cumsum(sums[1:], out=sums[1:])
        h = sums[width:] - sums[:n]
        h *= self.inverses[:n]
        return mix(h)


ROLL = Roller(11)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row's begin and end (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``limit`` bytes together (PIECE if not given), or one row."""
    at, n, limit = 0, len(offsets) - 1, limit or PIECE
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of its first word (one more than rows)."""
    starts, ends, last = [np.empty(0, np.int64)], [np.empty(0, np.int64)], False
    for lo in range(0, len(data), PIECE):
        inside = ~_SPACE[data[lo : lo + PIECE]]
        edges = offsets[slice(*np.searchsorted(offsets, [lo, lo + len(inside)]))] - lo
        before = np.empty(len(inside), dtype=bool)
        before[0], before[1:] = last, inside[:-1]
        # a word ends where a space follows it, or another row does
        over = before & ~inside
        over[edges] = before[edges]
        before[edges] = False  # no word runs on into the next row
        starts.append(np.flatnonzero(inside & ~before) + lo)
        ends.append(np.flatnonzero(over) + lo)
        last = bool(inside[-1])
    if last:
        ends.append(np.array([len(data)]))
    starts, ends = np.concatenate(starts), np.concatenate(ends)
    return starts, ends, np.searchsorted(starts, offsets)


#: Bits that window_owner() leaves for places; the others are a key's rank.
PLACE_BITS = 23


def window_owner(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` places, the place of the least key in it (without its PLACE_BITS low bits), the first of equals."""
    n, block = len(keys) - width + 1, 1 << (PLACE_BITS - 1)
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    return np.concatenate([_owner(keys[at : at + block + width - 1], width) + at for at in range(0, n, block)])


def _owner(keys: np.ndarray, width: int) -> np.ndarray:
    n, low = len(keys) - width + 1, U64((1 << PLACE_BITS) - 1)
    grid = np.full(-(-len(keys) // width) * width, _MASK, dtype=U64)
    grid[: len(keys)] = (keys & ~low) | np.arange(len(keys), dtype=U64)
    grid = grid.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & low).astype(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each pair, joined."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def covered(begins: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places are in a span [begin, end); spans may overlap and come in any order."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    opens = np.ones(len(begins), dtype=bool)
    opens[1:] = begins[1:] > reach[:-1]
    step = np.zeros(size + 1, dtype=np.int8)
    step[begins[opens]] = 1
    step[reach[np.append(opens[1:], True)[: len(opens)]]] = -1
    return np.cumsum(step[:-1], dtype=np.int8).view(bool)


def kept_spans(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, separator: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the spans that ``keep`` marks, each followed by the separator, and where each row's begin (one more than rows).
    Spans of a row, ``first`` to the next row's, are at least a byte apart."""
    rows = len(offsets) - 1
    room = np.full(len(data) + rows, separator, dtype=np.uint8)  # a byte more a row: its last span needs one too
    for k in range(rows):
        room[offsets[k] + k : offsets[k + 1] + k] = data[offsets[k] : offsets[k + 1]]
    chosen = np.flatnonzero(keep)
    shift = np.repeat(np.arange(rows), np.diff(first))[chosen]
    begin, stop = starts[chosen] + shift, ends[chosen] + shift
    room[stop] = separator
    sizes = np.append(0, np.cumsum(stop + 1 - begin))
    return room[covered(begin, stop + 1, len(room))], sizes[np.searchsorted(chosen, first)]
