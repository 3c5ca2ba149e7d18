"""Vectorised text kernels over Arrow string columns.

Everything here works on whole texts, one Arrow slice at a time.  A *word* is a
maximal run of ASCII letters, digits, underscore and non-ASCII characters of
the lower-cased text; nulls count as empty texts.  Words are identified by a
64-bit hash of their bytes, computed for a whole slice at once from a running
polynomial sum, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a single longer text is its own slice.
SLICE_BYTES = 1 << 19
#: The same words as a regular expression over lower-cased text (Python, DuckDB).
WORD_RE = "[0-9a-z_\u0080-\U0010ffff]+"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=U64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyz_") + list(range(128, 256))] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.empty(size, U64)
        have[0] = 1
        have[1:] = U64(base)
        np.multiply.accumulate(have, out=have)
        if n <= SLICE_BYTES + 1:
            _POWERS[base] = have
    return have[:n]


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def trim() -> None:
    """Give memory that is free back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Bytes(NamedTuple):
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than texts


def utf8(texts: pa.Array, lower: bool = True) -> Bytes:
    """The texts' bytes end to end; ill-formed UTF-8 is replaced."""
    texts = pc.fill_null(texts, "")
    if lower:
        try:
            texts = pc.utf8_lower(texts)
        except pa.ArrowInvalid:
            raw = texts.cast(pa.binary()).to_pylist()
            texts = pa.array([x.decode("utf-8", "replace").lower() for x in raw], pa.string())
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if offs is None or len(texts) == 0:
        return Bytes(np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64))
    offsets = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Bytes(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most that many bytes of text, one row at least."""
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))])
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    trim()


class Words(NamedTuple):
    hash: np.ndarray  # uint64
    start: np.ndarray  # byte offsets into data
    end: np.ndarray
    rows: np.ndarray  # word offsets of the texts, one more than texts
    data: np.ndarray
    offsets: np.ndarray


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, wherever it lies; spans in order, of long data some at a time."""
    if len(data) > 2 * SLICE_BYTES and len(start) > 1:
        cuts = [0]
        while cuts[-1] < len(start):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, start[cuts[-1]] + SLICE_BYTES, "right"))))
        return np.concatenate([hash_spans(data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a]) for a, b in zip(cuts[:-1], cuts[1:])])
    run = np.zeros(len(data) + 1, U64)
    np.multiply(_BYTE[data], _powers(_BASE, len(data)), out=run[1:])
    np.cumsum(run, out=run)
    return mix((run[end] - run[start]) * _powers(_INV, len(data) + 1)[start])


def words(texts: pa.Array) -> Words:
    data, offsets = utf8(texts)
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(hash_spans(data, start, end), start, end, np.searchsorted(start, offsets), data, offsets)


def shingles(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words, their row offsets, and the first word of each.

    A text of 1 to n-1 words has one shorter run: all of it.
    """
    total, count = len(hashes), np.diff(rows)
    if total == 0:
        return np.zeros(0, U64), np.zeros(len(rows), np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([hashes, np.zeros(n - 1, U64)])
    left = np.repeat(rows[1:], count) - np.arange(total)  # words from here to the text's end
    acc = np.zeros(total, U64)
    for i in range(n):
        piece = padded[i : i + total]
        acc = acc * U64(_BASE) + (piece if i == 0 else np.where(left > i, piece, U64(0)))
    keep = left >= n
    short = (count > 0) & (count < n)
    keep[rows[:-1][short]] = True
    at = np.flatnonzero(keep)
    return mix(acc[at]), np.searchsorted(at, rows), at


def unique_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted, without repeats; and the new row offsets."""
    if len(values) == 0:
        return values, rows
    out = values.copy()
    for a, b in zip(rows[:-1], rows[1:]):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    starts = rows[:-1][np.diff(rows) > 0]
    new[starts] = True
    at = np.flatnonzero(new)
    return out[at], np.searchsorted(at, rows)


def lists(values: np.ndarray, rows: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column; 64-bit hashes keep their bits as signed values."""
    values = values.view(np.int64) if values.dtype == U64 else values
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values, kind))


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of each row's values, with wrap-around for integers."""
    run = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=run[1:])
    return run[rows[1:]] - run[rows[:-1]]


def keys128(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """16-byte binary keys of two 64-bit halves."""
    both = np.ascontiguousarray(np.stack([a, b], 1).astype(">u8"))
    offsets = np.arange(len(a) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(both)])


def long_column(column: pa.Array) -> np.ndarray:
    return np.asarray(column, np.int64)
