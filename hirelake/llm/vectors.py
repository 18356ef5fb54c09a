"""Columns of vectors as numpy matrices of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole(column: pa.Array, scale: int, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows with a usable vector, and floor(scale * x) of each of these.

    A vector that is null, empty, or holds a null or a component that is not finite, is none. Numbers beyond ``most``
    either way count as ``most``, so that sums of products stay exact.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.take(pa.array(np.flatnonzero(sizes))).flatten().to_numpy(zero_copy_only=False).astype(float)
    offs = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    at = np.flatnonzero((sizes > 0) & (bad[offs[1:]] == bad[offs[:-1]]))
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.clip(np.floor(flat * scale), -most, most)
    return at, [flat[x:y] for x, y in zip(offs[at], offs[at + 1], strict=True)]


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to at least so many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
