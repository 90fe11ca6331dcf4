"""Vectorised word arithmetic on the UTF-8 buffers of Arrow text columns.

A word is a maximal run of bytes other than ASCII white space (0x20 and 0x09 to 0x0D). Everything works on whole
buffers of many documents at once, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are worked on at once; one longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n at least."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES + (1 << 16)), base, dtype=np.uint64)
        steps[0] = 1
        known = _powers[base] = np.multiply.accumulate(steps)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text or binary column and its n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``limit`` bytes at most."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document the number of its first word (n + 1 numbers)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~separator[data]
    after = np.empty(n, bool)
    after[0] = False
    after[1:] = inside[:-1]
    after[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(inside & ~after)
    before = np.empty(n, bool)
    before[-1] = False
    before[:-1] = inside[1:]
    before[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    return starts, ends, np.searchsorted(starts, offs)


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal spans have equal hashes wherever they stand."""
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * powers(_BASE, len(data))[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values (n - k + 1 of them, none if n < k)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h *= U64(6364136223846793005)
        h += values[j : j + n]
    return mix(h)


def inner_windows(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Of the windows of k values over all documents in a row, those that lie within one document. first: n + 1 numbers."""
    ok = np.zeros(max(0, total - k + 1), bool)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    full = counts > 0
    edge = np.zeros(len(ok) + 1, np.int32)
    np.add.at(edge, first[:-1][full], 1)
    np.add.at(edge, first[:-1][full] + counts[full], -1)
    ok[:] = np.cumsum(edge[:-1]) > 0
    return ok
