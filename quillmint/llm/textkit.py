"""Vectorised word work on Arrow string columns: word limits, word hashes and shingle hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. All functions work on
slices of a few megabytes, so memory follows the slice (or one text, where that is longer), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
SLICE_BYTES = 1 << 19
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _power(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, SLICE_BYTES + 1), base, U64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array; nulls count as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def frugal(batches_of: Batches) -> Batches:
    """A batch function that gives memory back when its task ends, as Python workers outlive their tasks."""

    @wraps(batches_of)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches_of(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _trim is not None:
                _trim(0)

    return run


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lowered."""
    return _LOWER[data]


class Slice(NamedTuple):
    first: int  # position of the first text in the batch
    offsets: np.ndarray  # of texts in data, from 0
    data: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in runs of at most ``limit`` bytes; a longer text is a run of its own."""
    offsets, data = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Slice(i, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
        i = j


class Words(NamedTuple):
    start: np.ndarray  # byte positions
    end: np.ndarray
    doc: np.ndarray  # index of the word's text
    count: np.ndarray  # words of each text
    first: np.ndarray  # each text's first word


def words(part: Slice, letters: np.ndarray | None = None) -> Words:
    """Maximal runs of the bytes that are not spaces, or of those marked in ``letters``."""
    data, offsets = part.data, part.offsets
    n = len(offsets) - 1
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~IS_SPACE[data] if letters is None else letters[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's end also ends its last word
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = inside[:-1] & (~inside[1:] | edge[1:])
    start, end = np.flatnonzero(start), np.flatnonzero(end)
    count = np.diff(np.searchsorted(start, offsets))
    first = np.concatenate([[0], np.cumsum(count)])
    return Words(start, end, np.repeat(np.arange(n), count), count, first[:-1])


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over random byte values, finalised."""
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _power(_P, len(data)), out=total[1:])
    value = (total[end] - total[start]) * _power(_P_INVERSE, len(data) + 1)[start]
    return mix(value ^ (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def word_hashes(part: Slice, w: Words, lower: bool) -> np.ndarray:
    return span_hashes(_LOWER[part.data] if lower else part.data, w.start, w.end)


class Shingles(NamedTuple):
    value: np.ndarray
    doc: np.ndarray
    word: np.ndarray  # index of the first word


def shingles(w: Words, hashes: np.ndarray, size: int = 5, short: bool = True) -> Shingles:
    """Hashes of each text's runs of ``size`` words; with ``short`` a shorter text is one run of all its words."""
    n = len(hashes)
    if n >= size:
        value = np.zeros(n - size + 1, U64)
        for k in range(size):
            value = value * U64(0xFF51AFD7ED558CCD) + hashes[k : n - size + 1 + k]
        inside = w.doc[: n - size + 1] == w.doc[size - 1 :]
        word = np.flatnonzero(inside)
        value, doc = mix(value[word]), w.doc[word]
    else:
        value, doc, word = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if short:
        few = np.flatnonzero((w.count > 0) & (w.count < size))
        if len(few):
            more = np.zeros(len(few), U64)
            for k in range(size - 1):
                has = w.count[few] > k
                at = np.where(has, w.first[few] + k, 0)
                more = np.where(has, more * U64(0xFF51AFD7ED558CCD) + hashes[at] + U64(k + 1), more)
            more = mix(more ^ w.count[few].astype(U64))
            value, doc, word = np.concatenate([value, more]), np.concatenate([doc, few]), np.concatenate([word, w.first[few]])
            order = np.argsort(doc, kind="stable")
            value, doc, word = value[order], doc[order], word[order]
    return Shingles(value, doc, word)


def distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, and the offsets of the texts in them."""
    limits = np.searchsorted(doc, np.arange(n + 1))
    value = value.copy()
    for i in np.flatnonzero(np.diff(limits) > 1):
        value[limits[i] : limits[i + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(n + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
