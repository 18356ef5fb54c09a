"""Document fingerprints from prefix polynomial hashes.

A text's code points c0 c1 ... have, for two primes p, the prefix arrays ``H[i] = sum (c_j + 1) * B^j mod p`` for
j < i. ``(H[j] - H[i]) / B^i`` is the hash of the span i..j whatever its place, so any two spans are compared in
constant time and the longest common extension of two places is found by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import flat, longs

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Code points of a window, and slots of the sketch of a fingerprint.
WINDOW, SLOTS = 16, 128
#: Texts under so many code points have a second sketch, of short windows (of single points under the last number); two
#: texts are compared by these if one is under the second number.
SHORT, COMPARED_SHORT, SHORT_WINDOW, SHORT_SLOTS, TINY = 128, 64, 4, 64, 8
CHUNK_POINTS = 1 << 18
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, next_doc_id long"
_U = np.uint64
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _geometric(base: int, p: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * _U(pow(base, have, p)) % _U(p)
        have += more
    return out


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime, B^i and B^-i for i up to n."""
    if not _tables or len(_tables[0][0]) <= n:
        size = 1 << max(10, n.bit_length())
        _tables[:] = [(_geometric(b, p, size + 1), _geometric(pow(b, -1, p), p, size + 1)) for p, b in zip(PRIMES, BASES, strict=True)]
    return _tables


class PrefixHashes:
    """Prefix arrays over a run of code points, which may hold many texts one after the other."""

    def __init__(self, points: np.ndarray):
        self.points, n = points, len(points)
        self.tables = powers(n)
        self.sums = []
        for p, (up, _) in zip(PRIMES, self.tables, strict=True):
            h = np.zeros(n + 1, _U)
            np.cumsum((points.astype(_U) + _U(1)) * up[:n] % _U(p), out=h[1:])
            h %= _U(p)
            self.sums.append(h)

    def parts(self, i: np.ndarray, j: np.ndarray) -> list[np.ndarray]:
        """The hashes of the spans i..j for each prime, whatever their place."""
        return [(h[j] + _U(p) - h[i]) % _U(p) * down[i] % _U(p) for p, h, (_, down) in zip(PRIMES, self.sums, self.tables, strict=True)]

    def spans(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.parts(i, j)
        return a << _U(32) | b

    def windows(self, k: int) -> np.ndarray:
        """The hash of the k points from each place."""
        n = len(self.points) - k + 1
        if n <= 0:
            return np.zeros(0, _U)
        a, b = ((h[k:] + _U(p) - h[:n]) % _U(p) * down[:n] % _U(p) for p, h, (_, down) in zip(PRIMES, self.sums, self.tables, strict=True))
        return a << _U(32) | b

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far, up to ``most``, the points from i and from j agree: a binary search over equal spans."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.spans(i, i + mid) == self.spans(j, j + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def joined_spans(a: list[np.ndarray], a_len: np.ndarray, b: list[np.ndarray]) -> np.ndarray:
    """The hash of two spans written one after the other, from their hashes."""
    x, y = ((u + v * up[a_len]) % _U(p) for u, v, p, (up, _) in zip(a, b, PRIMES, powers(int(a_len.max(initial=0))), strict=True))
    return x << _U(32) | y


def _spread(h: np.ndarray) -> np.ndarray:
    h = h * _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(29))


def sketches(n: int, owner: np.ndarray, hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """For each of n texts, one byte for each slot: of the least spread window hash that falls there; 0 for none."""
    h = _spread(hashes)
    least = np.full(n * slots, np.iinfo(np.uint64).max, _U)
    np.minimum.at(least, owner * slots + (h & _U(slots - 1)).astype(np.int64), h >> _U(7))
    return np.where(least == np.iinfo(np.uint64).max, 0, _spread(least) % _U(255) + _U(1)).astype(np.uint8).reshape(n, slots)


def short_sketches(texts: list[np.ndarray]) -> np.ndarray:
    """Sketches of short windows of the texts (code points) under ``SHORT``; zeros for longer ones."""
    out = np.zeros((len(texts), SHORT_SLOTS), np.uint8)
    at = np.flatnonzero([0 < len(t) < SHORT for t in texts])
    if len(at):
        size = np.array([len(texts[i]) for i in at])
        owner = np.repeat(np.arange(len(at)), size)
        start = np.cumsum(size) - size
        width = np.where(size < TINY, 1, SHORT_WINDOW)[owner]
        place = np.arange(len(owner))
        hashes = PrefixHashes(np.concatenate([texts[i] for i in at]))
        inside = place - start[owner] + width <= size[owner]
        out[at] = sketches(len(at), owner[inside], hashes.spans(place[inside], (place + width)[inside]), SHORT_SLOTS)
    return out


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Share of the windows of two texts that both have (Dice), from their sketches; 1 for equal texts."""
    some = ((a > 0) | (b > 0)).sum(1)
    shared = ((a == b) & (a > 0)).sum(1) / np.maximum(some, 1)
    jaccard = np.clip((shared - 1 / 255) / (1 - 1 / 255), 0, 1)
    return np.where(same, 1.0, 2 * jaccard / (1 + jaccard))


def points_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offsets of each."""
    data, offs = flat(column)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), heads[offs]


def _hex(h: np.ndarray, sketch: np.ndarray, short: np.ndarray) -> list[str]:
    """The fingerprint: the whole text's hash, the sketch, and that of short windows where there is one."""
    return [f"{int(x):016x}{row.tobytes().hex()}{few.tobytes().hex() if few.any() else ''}" for x, row, few in zip(h, sketch, short, strict=True)]


def _alike(a: np.ndarray, b: np.ndarray, short_a: np.ndarray, short_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, same: np.ndarray) -> np.ndarray:
    return np.where((np.minimum(size_a, size_b) < COMPARED_SHORT) & (np.maximum(size_a, size_b) < SHORT), likeness(short_a, short_b, same), likeness(a, b, same))


def _pairs(ids: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    """Rows for all but the last text; each one's next is the text after it."""
    points, offs = points_of(texts)
    n, k = len(ids) - 1, WINDOW
    hashes = PrefixHashes(points)
    start, size = offs[:-1], np.diff(offs)
    keep, most = size - size // 2, size // 2
    take = np.minimum(most[:n], size[1:])
    keep = keep[:n]
    owner = np.repeat(np.arange(n + 1), size)
    local = np.arange(len(points)) - start[owner]
    windows = hashes.windows(k)
    owner, local = owner[: len(windows)], local[: len(windows)]
    whole = hashes.spans(start, start + size)
    inside = local + k <= size[owner]
    small = np.flatnonzero((size < k) & (size > 0))
    sketch = sketches(n + 1, np.concatenate([owner[inside], small]), np.concatenate([windows[inside], whole[small]]))
    # The edited texts: windows in what is kept, in what is taken from the next, and across the seam.
    own = (owner < n) & (local + k <= np.append(keep, 0)[np.minimum(owner, n)])
    new = (owner > 0) & (local + k <= take[np.maximum(owner, 1) - 1])
    tail = np.arange(1, k)[None, :]
    a, b = np.broadcast_to(tail, (n, k - 1)), np.broadcast_to(k - tail, (n, k - 1))
    seam = np.nonzero((a <= keep[:, None]) & (b <= take[:, None]))
    at = seam[0]
    left, right = start[:n] + keep, start[1:]
    across = joined_spans(hashes.parts(left[at] - a[seam], left[at]), a[seam], hashes.parts(right[at], right[at] + b[seam]))
    edited = joined_spans(hashes.parts(start[:n], left), keep, hashes.parts(right, right + take))
    little = np.flatnonzero((keep + take < k) & (keep + take > 0))
    edited_sketch = sketches(n, np.concatenate([owner[own], owner[new] - 1, at, little]), np.concatenate([windows[own], windows[new], across, edited[little]]))
    prefix = hashes.extension(start[:n], start[1:], np.minimum(size[:n], size[1:]))
    few = short_sketches([points[i : i + m] for i, m in zip(start, size, strict=True)])
    edited_few = short_sketches([np.concatenate([points[i : i + m], points[r : r + t]]) if m + t < SHORT else points[:0] for i, m, r, t in zip(start[:n], keep, right, take, strict=True)])
    sha = [hashlib.sha256(np.concatenate([points[s : s + m], points[r : r + t]]).tobytes().decode("utf-32-le").encode()).hexdigest() for s, m, r, t in zip(start[:n], keep, right, take, strict=True)]
    rows = {
        "doc_id": ids[:n],
        "n_chars": size[:n],
        "edited_sha256": sha,
        "fingerprint": _hex(whole[:n], sketch[:n], few[:n]),
        "edited_fingerprint": _hex(edited, edited_sketch, edited_few),
        "near_edited": _alike(sketch[:n], edited_sketch, few[:n], edited_few, size[:n], keep + take, whole[:n] == edited),
        "near_next": _alike(sketch[:n], sketch[1:], few[:n], few[1:], size[:n], size[1:], whole[:n] == whole[1:]),
        "common_prefix": prefix,
        "next_doc_id": ids[1:],
    }
    least = np.iinfo(np.int64).min
    return pa.RecordBatch.from_pydict({c: pa.array(v, mask=v == least) if c.endswith("doc_id") else v for c, v in rows.items()})


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of documents in order; the first row marked ``tail`` is the document after the range."""
    held_ids, held, load = [], [], 0
    for batch in batches:
        ids, tails, texts = longs(batch.column("doc_id")), batch.column("tail").to_pylist(), batch.column("text").to_pylist()
        for i, tail, text in zip(ids, tails, texts, strict=True):
            held_ids.append(i)
            held.append(text or "")
            load += len(held[-1])
            if tail or load > CHUNK_POINTS and len(held) > 1:
                yield _pairs(np.array(held_ids, np.int64), pa.array(held, pa.string()))
                held_ids, held, load = held_ids[-1:], held[-1:], len(held[-1])
            if tail:
                return


def _tree(x, bounds: list[int], low: int, high: int):
    """How many of the sorted bounds are at most x, by binary search in a column expression."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(x < F.lit(bounds[mid]), _tree(x, bounds, low, mid)).otherwise(_tree(x, bounds, mid + 1, high))


def fingerprint_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    The next document is the one after it by (doc_id, text), and the first one after the last. Ids are cut into
    ranges at quantiles of all ids (as many as shuffle partitions); one shuffle puts each range, with a copy of the
    first document of the next range, into one task that streams it in order. The driver holds two numbers a range.

    A null text is an empty one; a null doc_id sorts first. Rows that share a doc_id follow each other by text;
    a single row is its own next. Columns other than doc_id and text are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    cuts = docs.select(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5]).alias("q")).first().q or []
    bounds = sorted(set(cuts)) if parts > 1 else []
    place = _tree(order, bounds, 0, len(bounds))
    firsts = sorted((r.b, r.x) for r in docs.groupBy(place.alias("b")).agg(F.min(order).alias("x")).collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    dense = F.array(*[F.lit(before.get(b, 0)) for b in range(len(bounds) + 1)])
    own = F.struct(place.alias("b"), F.lit(False).alias("tail"))
    tail = F.struct(F.element_at(dense, place + 1).alias("b"), F.lit(True).alias("tail"))
    dealt = docs.select("doc_id", "text", F.explode(F.when(order.isin([x for _, x in firsts]), F.array(own, tail)).otherwise(F.array(own))).alias("at"))
    dealt = dealt.select("doc_id", "text", F.col("at.b").alias("b"), F.col("at.tail").alias("tail"))
    ranges = dealt.repartitionById(len(bounds) + 1, F.col("b")).sortWithinPartitions("tail", F.col("doc_id").asc_nulls_first(), "text")
    return ranges.mapInArrow(_follow, SCHEMA)
