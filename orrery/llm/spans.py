"""Vectorised work on the bytes of a batch of texts: words, units and their 64-bit hashes, without a Python object for each.

A span is hashed eight bytes at a time: each step adds the bytes to the state and scrambles it by a bijection that is no ring
homomorphism, so texts with a regular build, such as Thue-Morse words, collide no more often than others. Spans over LONG bytes
are hashed by BLAKE2b. Where a hash stands for bytes whose result would be wrong for others, `same_spans` compares the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MULT, STEP = U(0x9E3779B97F4A7C55), U(0x2545F4914F6CDD1D)
LONG = 512
#: The low 0 to 8 bytes of a number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and where each begins; the last offset is the length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def batches(batch: pa.RecordBatch, column: str, limit: int = 1_000_000):
    """Slices of the batch whose texts have about limit bytes in all; one text is never cut."""
    from .common import slices

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in slices(sizes, limit):
        yield batch.slice(a, b - a)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def white(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, none over a text's end; for each text the index of its first."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    gap = white(raw)
    head = np.zeros(n + 1, bool)
    head[at] = True
    first = ~gap
    last = first.copy()
    first[1:] &= gap[:-1] | head[1:n]
    last[:-1] &= gap[1:] | head[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def _eights(raw: np.ndarray) -> np.ndarray:
    """At each byte position the number that the eight bytes from there make; zeros follow the end."""
    held = np.concatenate([raw, np.zeros(16, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", held, strides=(1,))


def byte_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of raw."""
    eights, size = _eights(raw), ends - starts
    h = mix(size.astype(np.uint64) * MULT + STEP)
    who = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[who], size[who]
    while len(who):
        h[who] = mix((h[who] ^ (eights[at] & _MASKS[np.minimum(left, 8)])) + STEP)
        go = left > 8
        who, at, left = who[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each `width` 64-bit items that follow each other."""
    n = max(0, len(items) - width + 1)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = mix((h ^ items[k : k + n]) + STEP)
    return h


def same_spans(one: np.ndarray, at_one: np.ndarray, two: np.ndarray, at_two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes of one from at_one are those of two from at_two."""
    same, a, b = np.ones(len(size), bool), _eights(one), _eights(two)
    who = np.flatnonzero((size > 0) & (size <= LONG))
    i, j, left = at_one[who], at_two[who], size[who]
    while len(who):
        equal = ((a[i] ^ b[j]) & _MASKS[np.minimum(left, 8)]) == 0
        same[who[~equal]] = False
        go = equal & (left > 8)
        who, i, j, left = who[go], i[go] + 8, j[go] + 8, left[go] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        same[k] = np.array_equal(one[at_one[k] : at_one[k] + size[k]], two[at_two[k] : at_two[k] + size[k]])
    return same


def code_points(raw: np.ndarray) -> np.ndarray:
    """For each byte position 0..n the number of code points before it, over the whole batch."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


class HashTable:
    """Open addressing from 64-bit hashes to numbers; all steps run over whole arrays. It is emptied when full."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.held = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def full(self, more: int) -> bool:
        return 2 * (self.held + more) > len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The value of each hash, or -1."""
        hashes = np.where(hashes == 0, U(1), hashes)
        out = np.full(len(hashes), -1, np.int32)
        slot, open_ = (hashes >> U(64 - self.bits)).astype(np.int64), None
        while True:
            there = self.keys[slot]
            hit = there == (hashes if open_ is None else hashes[open_])
            if open_ is None:
                out[hit] = self.values[slot[hit]]
                open_ = np.flatnonzero(~hit & (there != 0))
                slot = slot[open_]
            else:
                out[open_[hit]] = self.values[slot[hit]]
                go = ~hit & (there != 0)
                open_, slot = open_[go], slot[go]
            if not len(open_):
                return out
            slot = (slot + 1) & (len(self.keys) - 1)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """hashes: distinct, none there yet."""
        hashes = np.where(hashes == 0, U(1), hashes)
        self.held += len(hashes)
        slot = (hashes >> U(64 - self.bits)).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            placed = self.keys[slot] == hashes
            self.values[slot[placed]] = values[placed]
            hashes, values, slot = hashes[~placed], values[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1 for all i, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
