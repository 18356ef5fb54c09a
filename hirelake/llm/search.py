"""Exact top-k by inner product, pruned by segment statistics from coarse to fine.

Cut two vectors into the same segments of l components. With the means m, n and deviations s, t of a segment,
l * ((m - n)^2 + (s - t)^2) is at most its squared distance, so the sum over segments bounds the squared distance from
below, and with |x|^2 = sum l * (m^2 + s^2) the inner product from above: by sum l * (m * n + s * t). Finer segments
bound more closely. What a level rules out, finer ones don't look at, and the rest is worked out in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .vectors import whole

#: Numbers count as at most this, so that a product of 8,192 components is a whole number that a double holds.
MOST = 1 << 20
#: Queries that are broadcast at a time, and numbers in one block of bounds.
QUERIES, CELLS = 4096, 4_000_000
#: Pairs beyond this share of a block are worked out as one product, fewer one by one.
DENSE = 1 / 16


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments (as equal as can be), times the root of their length."""
    cuts = np.unique(np.arange(segments) * rows.shape[1] // segments)
    length = np.diff(np.append(cuts, rows.shape[1]))
    mean = np.add.reduceat(rows, cuts, axis=1) / length
    square = np.add.reduceat(rows * rows, cuts, axis=1) / length
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]) * np.tile(np.sqrt(length), 2)


class Levels:
    """Queries of one length with the statistics of each level, and the least score that is of use to each."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        width = rows.shape[1]
        self.ids, self.rows, self.k = ids, rows, k
        self.segments = sorted({max(1, width // n) for n in (64, 16, 4, 2)})
        self.levels = [statistics(rows, s) for s in self.segments]
        self.norm = np.sqrt((rows * rows).sum(1).max(initial=0))
        self.least = np.full(len(ids), -np.inf)
        self.looked = [0] * (len(self.levels) + 1)

    def survivors(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of each pair whose score can be of use."""
        margin = 1e-9 * self.norm * np.sqrt((rows * rows).sum(1).max(initial=0))
        bar = self.least - margin
        at = None  # the pairs left, as places in the block of queries by rows
        for level, (own, segments) in enumerate(zip(self.levels, self.segments, strict=True)):
            at = self._step(level, own, statistics(rows, segments), bar, at)
        score = self._scores(len(self.levels), self.rows, rows, at)
        keep = score >= self.least[at // len(rows)]
        return at[keep] // len(rows), at[keep] % len(rows), score[keep]

    def _step(self, level: int, own: np.ndarray, other: np.ndarray, bar: np.ndarray, at: np.ndarray | None) -> np.ndarray:
        if at is None:
            self.looked[level] += len(own) * len(other)
            return np.flatnonzero(own @ other.T >= bar[:, None])
        return at[self._scores(level, own, other, at) >= bar[at // len(other)]]

    def _scores(self, level: int, own: np.ndarray, other: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.looked[level] += len(at)
        if len(at) > DENSE * len(own) * len(other):
            return (own @ other.T).ravel()[at]
        step = max(1, CELLS // own.shape[1])
        return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", own[x // len(other)], other[x % len(other)]) for x in (at[i : i + step] for i in range(0, len(at), step)))])


class Best:
    """The k best rows of each query so far, ties to the lesser id; a query's own id is none."""

    def __init__(self, levels: Levels):
        self.levels = levels
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        query, row, score = self.levels.survivors(rows)
        other = self.levels.ids[query] != ids[row]
        query, score, found = (np.append(a, b[other]) for a, b in ((self.query, query), (self.score, score), (self.id, ids[row])))
        order = np.lexsort((found, -score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, last = order[place < self.levels.k], place[place < self.levels.k] == self.levels.k - 1
        self.query, self.score, self.id = query[order], score[order], found[order]
        self.levels.least[self.query[last]] = np.maximum(self.levels.least[self.query[last]], self.score[last])


def _levels(ids: np.ndarray, vectors: list[np.ndarray], k: int) -> list[Levels]:
    """The queries by the length of their vectors, each with a bar from its scores against the other queries."""
    out, width = [], np.array([len(v) for v in vectors])
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        levels = Levels(ids[which], np.stack([vectors[i] for i in which]), k)
        for at in range(0, len(which), 512):
            scores = levels.rows[at : at + 512] @ levels.rows.T
            scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
            if len(which) > k:
                levels.least[at : at + 512] = np.partition(scores, -k, axis=1)[:, -k]
        out.append(levels)
    return out


def top_k(vectors: DataFrame, asked: Column, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each asked row's k highest inner products with other rows, ties to the lesser key.

    Vectors become floor(scale * x), and scores are exact whole numbers. Rows without a key or a usable vector (null,
    empty, holding nulls or numbers that are not finite) take no part; vectors of different lengths don't meet. Every
    row of the query's own key is its own. A key asked twice is asked once, with the lesser vector; any other row that
    comes twice is found twice. Numbers beyond ``MOST`` count as it. Other columns are ignored, an empty table gives an
    empty one.

    Queries are dealt into blocks of some ``QUERIES``, each broadcast and met with all rows in one scan; with several
    blocks each one's answer is written before the next starts. A query's scores against the others of its block give it
    a bar to start with, so that a task sends what reaches it, k rows a query at most.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"), asked.alias("asked")).where("key IS NOT NULL AND vector IS NOT NULL")
    queries = rows.where("asked").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).groupBy("key").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    if blocks == 1:
        return _search(rows, queries, k, scale)
    return reduce(DataFrame.unionByName, [written(_search(rows, queries.where(block == i), k, scale), f"found-{i}") for i in range(blocks)])


def _search(rows: DataFrame, queries: DataFrame, k: int, scale: int) -> DataFrame:
    table = queries.toArrow()
    at, found = whole(table.column("vector").combine_chunks(), scale, MOST)
    shared = rows.sparkSession.sparkContext.broadcast(_levels(table.column("key").to_numpy()[at], found, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {levels.rows.shape[1]: Best(levels) for levels in shared.value}
        for batch in batches:
            at, found = whole(batch.column("vector"), scale, MOST)
            ids, width = batch.column("key").to_numpy()[at], np.array([len(v) for v in found])
            for w in np.unique(width):
                if w not in best:
                    continue
                which = np.flatnonzero(width == w)
                step = max(1, CELLS // len(best[w].levels.ids))
                for i in range(0, len(which), step):
                    part = which[i : i + step]
                    best[w].add(ids[part], np.stack([found[j] for j in part]))
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(b.levels.ids[b.query]), pa.array(b.id), pa.array(b.score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    answers = rows.select("key", "vector").mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""
