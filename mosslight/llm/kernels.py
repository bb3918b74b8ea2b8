"""Vectorised text kernels on Arrow batches: word spans, word hashes, k-gram hashes.

All of them work on the UTF-8 bytes of a slice of rows at once. Slices hold a bounded number of
bytes (one row at least), so memory follows the largest text and not the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, as tables over bytes: every
#: byte of a character beyond ASCII belongs to a word in both.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, of one row at least."""
    ends, i = np.cumsum(lengths), 0
    while i < len(lengths):
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right"))
        yield i, (i := max(j, i + 1))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError, TypeError):  # another C library, which has no such call
    _trim = None


def give_back() -> None:
    """A worker lives on after its task, beside those of other stages: freed memory that Arrow and the C library keep for later goes back."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def portions(batches, rows: int = 2_000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about so many rows and bytes, without a copy: a worker holds a batch several times over."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, n * size // max(1, batch.nbytes)))
        for i in range(0, n, step):
            yield batch.slice(i, step)
        del batch
    give_back()


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.empty(0, np.uint8)
    return data, offs - offs[0]


def text_slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for bounded slices of a string column."""
    data, offs = flat(col)
    for i, j in row_slices(np.diff(offs), limit):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def word_spans(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it lies in. Words don't cross rows."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    inside = table[data]
    cut = offs[:-1][np.diff(offs) > 0]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[cut] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[cut[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_counts(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Number of words in each row."""
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[:-1][np.diff(offs) > 0]
    first[cut] = inside[cut]
    sums = np.concatenate([[0], np.cumsum(first)])
    return sums[offs[1:]] - sums[offs[:-1]]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + limit, "right")))
        b = ends[j - 1]
        up, down = _power(max(int(b - a) + 1, limit + 1))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        if b - a > limit:
            _powers[:] = [p[: limit + 1] for p in _powers]
        i = j
    return out


def window_minima(values: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each `span` successive values."""
    n = len(values)
    padded = np.full(-(-n // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    grid = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - span + 1], ahead[span - 1 : n])


def kgrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[j : j + k] for every j that has k words after it, across rows as well."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h += words[i : i + n] * _MULT[i % 64] if k <= 64 else mix64(words[i : i + n] + np.uint64(i))
    return mix64(h)


def sequence_hash(words: np.ndarray) -> int:
    """The hash that kgrams gives to a whole short sequence."""
    return int(kgrams(words, len(words))[0])
