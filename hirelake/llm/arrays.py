"""Arrow text columns as flat numpy arrays: bytes, words, hashes and window minima.

Every helper works on a chunk of documents at once: one flat array holds their bytes, and ``offs``
(one longer than the documents) says where each begins. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 2000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of the column, and the offsets of each."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a piece hold ``limit`` bytes at most, in ``CHUNK_ROWS`` rows at most; one longer
    text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1), at + CHUNK_ROWS)
            yield batch.slice(at, to - at)
            at = to


def longs(column: pa.Array) -> np.ndarray:
    """int64 values; null is the least value."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return _LOWER[data]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document (one more at the end) the index of its first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = space[:-1]
    edge[offs[offs < n]] = True
    starts = np.flatnonzero(edge & ~space)
    edge[-1] = True
    edge[:-1] = space[1:]
    edge[offs[offs > 0] - 1] = True
    ends = np.flatnonzero(edge & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _S32)
    x = x * _M1
    x ^= x >> _S29
    x *= _M2
    x ^= x >> _S32
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring spans from their hashes; order matters."""
    return mix(a * _M2 + (b ^ _M1))


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(16, np.uint8)])


def eights(pad: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places as one number; pad has sixteen bytes more than the text."""
    return np.ndarray((n,), "<u8", pad, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes a step."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    view = eights(padded(data), len(data) + 8)
    left = ends - starts
    out = mix(left.astype(np.uint64))
    at, live = starts, np.arange(len(starts))
    while len(live):
        block = view[at]
        short = left < 8
        if short.any():
            block = np.where(short, block & ((np.uint64(1) << (np.minimum(left, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)), block)
        out[live] = joined(out[live], block)
        go = left > 8
        at, left, live = at[go] + 8, left[go] - 8, live[go]
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k units from each place; k is built from its binary halves."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    if k == 1:
        return h
    half = grams(h, k // 2)
    n = len(h) - k + 1
    out = joined(half[:n], half[k // 2 : k // 2 + n])
    return joined(out, h[k - 1 : k - 1 + n]) if k % 2 else out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place."""
    if len(a) < w:
        return a[:0]
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: -(w - span)], a[w - span :]) if span < w else a


def owners(offs: np.ndarray) -> np.ndarray:
    """The document of each unit."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
