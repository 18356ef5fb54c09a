"""A stated query set against all rows, in blocks: matrix products in tasks, each keeping its own best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Numbers in one block of scores.
BLOCK = 1_000_000


def ids(column: pa.Array) -> np.ndarray:
    """A column of keys as an array that sorts."""
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def unit_vectors(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold a usable vector, and these at length one.

    Null, empty and zero vectors, those that hold a null, and those of another width than the others are none.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        if not width and len(sizes):
            width = int(sizes.max())
    at = np.flatnonzero((sizes == width) & (width > 0))
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), width or 1)
    norm = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], flat[good] / norm[good][:, None]


#: Items that are put into clusters together, and the clusters made of them.
CLUSTERED, CLUSTERS = 8192, 64


class Clusters:
    """Unit vectors in clusters, each with its centre and the widest angle to it, which bound all cosines with a query.

    By the triangle inequality of angles, an item of a cluster of radius r whose centre is at an angle a from the query is
    at an angle of a - r or more.
    """

    def __init__(self, vectors: np.ndarray, count: int):
        centres = vectors[np.arange(count) * len(vectors) // count]
        for _ in range(2):
            own = np.concatenate([(vectors[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(vectors), 4096)])
            sums = np.zeros_like(centres)
            np.add.at(sums, own, vectors)
            norm = np.sqrt((sums * sums).sum(1))
            centres = np.where((norm > 0)[:, None], sums / np.where(norm > 0, norm, 1)[:, None], centres)
        self.order = np.argsort(own, kind="stable")
        self.ends = np.cumsum(np.bincount(own, minlength=count))
        self.centres, angles = centres, np.arccos(np.clip((vectors * centres[own]).sum(1), -1, 1))
        self.radius = np.zeros(count)
        np.maximum.at(self.radius, own, angles)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest cosine that an item of each cluster can have with each query, with room for rounding."""
        angle = np.arccos(np.clip(self.centres @ queries.T, -1, 1))
        return np.cos(np.maximum(angle - self.radius[:, None], 0)) + 1e-7

    def members(self, cluster: int) -> np.ndarray:
        return self.order[(self.ends[cluster - 1] if cluster else 0) : self.ends[cluster]]


def meet(best: Best, items: np.ndarray, vectors: np.ndarray, queries: np.ndarray, met: list[int] | None = None) -> None:
    """Adds all items to the best of all queries, but for clusters and queries whose bound is below the query's k-th best.

    With few queries a product with all is cheaper than clusters. ``met`` gets how many pairs were worked out, and of how many.
    """
    count = min(CLUSTERS, len(items) // 32)
    groups = [(np.arange(len(items)), None)]
    if count > 1 and len(queries) > 2 * count:
        clusters = Clusters(vectors, count)
        reach = np.floor(clusters.bounds(queries) * best.unit + 0.5)
        nearest = np.argsort(-clusters.bounds(queries).max(1), kind="stable")  # these raise the bar for the others
        groups = [(clusters.members(c), reach[c]) for c in nearest]
    for rows, reach in groups:
        step = max(1, BLOCK // max(len(queries), 1))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            alive = np.arange(len(queries)) if reach is None else np.flatnonzero(reach >= best.least)
            if met is not None:
                met[0], met[1] = met[0] + len(part) * len(alive), met[1] + len(part) * len(queries)
            if not len(alive):
                break
            best.add(items[part], vectors[part] @ queries[alive].T, which=None if len(alive) == len(queries) else alive)


class Best:
    """The k best items of each query by a score rounded to some digits, ties by the lesser item.

    New candidates are kept apart and sorted in when they are a quarter of what is held, so that small blocks cost no
    sort of all that is held; ``least`` is the bar as of then.
    """

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.unit = k, 10.0**digits
        self.least = np.full(queries, -np.inf)
        self._held: list[np.ndarray] | None = None  # query, rounded, item, values
        self._new: list[list[np.ndarray]] = []
        self._count = 0

    query, rounded, item = (property(lambda self, i=i: self._settled()[i]) for i in range(3))

    def add(self, items: np.ndarray, scores: np.ndarray, *others: np.ndarray, which: np.ndarray | None = None) -> None:
        """scores: a row for each item and a column for each query (of ``which``), NaN where they don't meet; others go along."""
        if not len(items):
            return
        rounded = scores * self.unit
        rounded += 0.5
        np.floor(rounded, out=rounded)
        rounded[np.isnan(rounded)] = -np.inf
        bar = self.least if which is None else self.least[which]
        if len(items) > self.k:
            bar = np.maximum(bar, np.partition(rounded, len(items) - self.k, axis=0)[len(items) - self.k])
        i, j = np.nonzero((rounded >= bar) & (rounded > -np.inf))
        if self._held is not None and not len(i):
            return
        self._new.append([j if which is None else which[j], rounded[i, j], items[i], *(x[i, j] for x in (scores, *others))])
        self._count += len(i)
        if self._held is None or 4 * self._count >= len(self._held[0]):
            self._settled()

    def _settled(self) -> list[np.ndarray]:
        """What is held, with the new candidates sorted in."""
        if self._new:
            parts = self._new if self._held is None else [self._held, *self._new]
            held = [np.concatenate(x) for x in zip(*parts, strict=True)]
            self._new, self._count = [], 0
            query, value, item = held[:3]
            order = np.lexsort((item, -value, query))
            query = query[order]
            start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
            place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
            self.least[query[place == self.k - 1]] = value[order[place == self.k - 1]]
            self._held = [x[order[place < self.k]] for x in held]
        return self._held or [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]

    def batch(self, queries: np.ndarray, names: list[str]) -> pa.RecordBatch | None:
        query, _, item, *values = self._settled()
        if not len(query):
            return None
        return pa.RecordBatch.from_arrays([pa.array(queries[query]), pa.array(item), *(pa.array(x) for x in values)], names=["query", "item", *names])
