"""Texts as flat numpy arrays: Arrow's own UTF-8 buffers, cut into spans and hashed without a loop over rows.

Everything works on chunks of whole rows of about ``CHUNK`` bytes, so that memory follows the chunk and not the
batch; a single longer text makes a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 4 << 20
U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, U64) + _GOLDEN
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_WEIGHTS = mix(np.arange(1 << 16, dtype=U64)) | U64(1)
_SYMBOLS = mix(np.arange(256, dtype=U64) + U64(1 << 40))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as its bytes and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    column = column.cast(pa.large_string() if text else pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if text else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of whole rows of at most ``most`` bytes."""
    data, off = utf8(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans_between(is_gap: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that aren't gaps and don't cross rows: starts, ends, and for each row the first run's number."""
    n = len(is_gap)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, is_gap[:-1]
    starts = np.flatnonzero(~is_gap & (before | first[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, is_gap[1:]
    ends = np.flatnonzero(~is_gap & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans_between(SPACE[data], off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every span's bytes: a sum of byte codes times position weights, then mixed with the length."""
    lens = ends - starts
    out = np.zeros(len(lens), U64)
    some = np.flatnonzero(lens)
    if len(some):
        s, k = starts[some], lens[some]
        at = np.cumsum(k) - k
        total = int(k.sum())
        pos = np.arange(total, dtype=np.int64)
        where = pos + np.repeat(s - at, k)
        pos -= np.repeat(at, k)
        with np.errstate(over="ignore"):
            weight = _WEIGHTS[np.minimum(pos, len(_WEIGHTS) - 1)]
            if (far := np.flatnonzero(pos >= len(_WEIGHTS))).size:
                weight[far] = mix(pos[far].astype(U64)) | U64(1)
            weight *= _SYMBOLS[data[where]]
            out[some] = np.add.reduceat(weight, at)
    with np.errstate(over="ignore"):
        return mix(out + mix(lens.astype(U64) + U64(seed * 0x10001)))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, one span after the other."""
    at = np.cumsum(lens) - lens
    return np.arange(int(lens.sum()), dtype=np.int64) + np.repeat(starts - at, lens)
