"""Product codes of vectors by ball k-means, exact in whole numbers.

Of each part position, an entry and the parts that chose it form a ball. When entries have moved, half the distance
between two of them says which parts can change sides: inside the least of these a part stays where it is (the stable
core), and a part in the n-th ring round its entry can only go to the n nearest neighbours. Neighbours are those
entries that the ball's radius reaches. Balls are taken within a block of rows, whose radii are no larger than the
whole ball's, so nothing is missed and no radius has to be gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import newest, scratch, written
from .vectors import gathered, whole

#: Components count as at most this, so that squared distances are whole numbers that a double holds.
MOST = 1 << 22
ROWS = 32768
#: Neighbours looked at in one product; a ring is rounded up to these.
STEP = 32
_BITS = 9  # of an entry's index below its distance


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point, ties to the lower index, and its squared distance, by all distances."""
    index, error = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    norms = (entries * entries).sum(1)
    for at in range(0, len(points), 8192):
        part = points[at : at + 8192]
        far = norms - 2 * (part @ entries.T)
        best = far.argmin(1)
        index[at : at + 8192] = best
        error[at : at + 8192] = far[np.arange(len(part)), best] + (part * part).sum(1)
    return index, error


class Balls:
    """One part position's entries, their squared distances from each other, and which of them moved."""

    def __init__(self, entries: np.ndarray, before: np.ndarray):
        self.entries, self.moved, self.norms = entries, (entries != before).any(1), (entries * entries).sum(1)
        apart = self.norms[:, None] + self.norms - 2 * (entries @ entries.T)
        np.fill_diagonal(apart, -1)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.exact = 0  # distances worked out

    def move(self, points: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``nearest``, from the points' nearest entries before the entries moved."""
        step = points - self.entries[index]
        own = (step * step).sum(1)
        self.exact += len(points)
        key = own.astype(np.int64) << _BITS | index
        members = np.argsort(index, kind="stable")
        bounds = np.flatnonzero(np.diff(index[members], prepend=-1, append=-1))
        for begin, end in zip(bounds, bounds[1:]):  # noqa: B905
            ball = members[begin:end]
            entry, squares = index[ball[0]], own[ball]
            reach = int(np.searchsorted(self.apart[entry], 4 * squares.max(), "right"))
            near, apart = self.order[entry, :reach], self.apart[entry, :reach]
            if not self.moved[entry]:  # it is as near as it was: only moved neighbours can be nearer now
                near, apart = near[self.moved[near]], apart[self.moved[near]]
            ring = np.searchsorted(apart, 4 * squares, "right")
            outward = np.argsort(-ring, kind="stable")
            rings = -ring[outward]
            for at in range(0, len(near), STEP):
                rows = ball[outward[: np.searchsorted(rings, -at, "left")]]  # parts in a ring beyond ``at``
                if not len(rows):
                    break
                few = near[at : at + STEP]
                part = points[rows]
                far = (self.norms[few] - 2 * (part @ self.entries[few].T) + (part * part).sum(1)[:, None]).astype(np.int64)
                self.exact += far.size
                key[rows] = np.minimum(key[rows], (far << _BITS | few).min(1))
        return key & ((1 << _BITS) - 1), key >> _BITS


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The whole numbers of a batch's vectors, with zeros up to a multiple of the parts."""
    column = batch.column("vector")
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    return np.pad(rows, ((0, 0), (0, size - rows.shape[1])))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, codes (a byte for each part), error, label_error and codebooks_sha256, a row for each usable vector.

    Vectors become floor(scale * x) and are cut into equal parts. Each position's codebook starts as the parts of the
    vectors with the least keys; in each round every part goes to its nearest entry (ties: the lower index) and every
    entry to the floor of its parts' mean. error sums a vector's squared distances, label_error errors of equal labels.

    Vectors that are null or empty or hold nulls or numbers that are not finite have no row, nor have those of another
    length than the first. Null keys come last, vectors with equal keys by their numbers; rows that repeat count as often
    as they come. With fewer vectors than ``entries`` (256 at most) the codebook is as short. A length that the parts don't
    divide is filled up with zeros. Numbers beyond ``MOST`` count as it. Other columns are ignored; an empty table gives an
    empty one.

    No vector is shuffled: each round writes the table with its codes into the shared folder, and sums of at most parts x
    entries rows a task. Codebooks are broadcast (parts x entries rows). Sums by label are made before any shuffle,
    written, and joined: Spark broadcasts them if their files are small, and else splits a hot label's rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    fields = [rows.schema["key"], rows.schema["label"], T.StructField("vector", T.ArrayType(T.IntegerType()))]
    plain, coded = T.StructType(fields), T.StructType([*fields, T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())])

    def to_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = whole(batch.column("vector"), scale, MOST)
            if len(at):
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate(found).astype(np.int32))], names=["key", "label", "vector"])

    with scratch(spark) as keep:
        table = written(rows.mapInArrow(to_whole, plain), "vectors")
        in_order = table.orderBy(F.col("key").asc_nulls_last(), "vector")
        first = in_order.select("vector").limit(1).collect()
        width = len(first[0][0]) if first else 0
        size = -(-width // parts) * parts
        table = table.where(F.size("vector") == width)
        start = in_order.where(F.size("vector") == width).select("vector").limit(entries).collect()
        if not start:
            keep.append(newest())
            return table.select(F.col("key").alias(key), F.col("label").alias(label), F.lit(b"").alias("codes"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
        books = np.pad(np.array([r[0] for r in start], float), ((0, 0), (0, size - width))).reshape(len(start), parts, -1).transpose(1, 0, 2)
        before = None
        for step in range(rounds + 1):
            table = written(table.mapInArrow(_assigner(spark, books, before), coded), f"codes-{step}")
            if step < rounds:
                before, books = books, _means(table, books)
        keep.append(newest())
        sums = written(table.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
        keep.append(newest())
    digest = hashlib.sha256(",".join(map(str, books.astype(int).ravel().tolist())).encode()).hexdigest()
    joined = table.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "codes", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigner(spark, books: np.ndarray, before: np.ndarray | None):
    """A step that writes each vector's codes: by all distances first, then by balls round the entries it had."""
    shared, parts, size = spark.sparkContext.broadcast((books, before)), len(books), books.shape[0] * books.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, before = shared.value
        balls = before is not None and [Balls(*x) for x in zip(books, before, strict=True)]
        for batch in gathered(batches, ROWS):
            points = _matrix(batch, size).reshape(batch.num_rows, parts, -1)
            codes, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            had = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts) if balls else None
            for p in range(parts):
                own = np.ascontiguousarray(points[:, p])
                index, far = balls[p].move(own, had[:, p].astype(np.int64)) if balls else nearest(own, books[p])
                codes[:, p] = index
                error += far
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * parts), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed, pa.array(error)], names=["key", "label", "vector", "codes", "error"])

    return assign


def _means(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's mean, floored; one that no part chose stays. A task sends its sums only."""
    parts, count, width = books.shape
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * count, width + 1))  # whole numbers; exact up to 2^53, some 2^31 rows of the largest
        for batch in batches:
            points = _matrix(batch, parts * width).reshape(batch.num_rows * parts, width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            slot = (codes + np.arange(parts) * count).ravel()
            for i in range(width):
                total[:, i] += np.bincount(slot, points[:, i], len(total))
            total[:, -1] += np.bincount(slot, minlength=len(total))
        used = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(x) for x in total[used].astype(np.int64).T]], names=["slot", *names, "n"])

    found = table.select("vector", "codes").mapInArrow(sums, ", ".join(f"{c} long" for c in ("slot", *names, "n")))
    out = books.astype(np.int64).reshape(parts * count, width)
    for row in found.groupBy("slot").agg(*[F.sum(c).alias(c) for c in (*names, "n")]).collect():
        out[row["slot"]] = np.array([row[c] for c in names]) // row["n"]
    return out.reshape(books.shape).astype(float)


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same in SQL: every round compares every part with every entry."""
    ctes = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, k, x[k * len(x) // {parts} + 1:(k + 1) * len(x) // {parts}] AS x FROM v, range({parts}) t(k))",
        f"b0 AS MATERIALIZED (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p.k, any_value(x) AS x, min(struct_pack(d := CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT), e := e)) AS m FROM p JOIN b{r} b ON b.k = p.k GROUP BY vec_id, p.k)")
        if r < rounds:
            ctes.append(f"m{r} AS MATERIALIZED (SELECT k, e, list(f ORDER BY i) AS c FROM (SELECT k, m.e AS e, i, floor(sum(x[i]) / count(*)) AS f FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY ALL) y GROUP BY k, e)")
            ctes.append(f"b{r + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.k = b.k AND m.e = b.e)")
    ctes.append(f"o AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', m.e)), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY k, e)) AS s FROM b{rounds})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM o, h"


ORACLE = _oracle()
