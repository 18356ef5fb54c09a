"""Repeated passages of words, found by level-wise doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .arrays import flat, grams, joined, owners, word_hashes, words
from .repeats import covered, first_of_equal, ragged

SCHEMA = "doc_id long, n_words long, spans array<struct<begin:int,end:int>>, kept string"


def _levels(length: int) -> list[int]:
    """Lengths that double up to the length asked for: 5, 10, 20."""
    out = [length]
    while out[0] % 2 == 0 and out[0] > 6:
        out.insert(0, out[0] // 2)
    if len(out) < 2:
        raise ValueError("the length must be at least two levels of doubling: 8, 10, 12, 20, 40, ...")
    return out


def _find(length: int):
    seed = _levels(length)[0]

    def find(texts: pa.Array, order: np.ndarray):
        data, offs = flat(texts)
        starts, ends, woffs = words(data, offs)
        h = word_hashes(data, starts, ends)
        seeds, whole = grams(h, seed), grams(h, length)
        owner = owners(woffs)[: len(whole)]
        at = np.flatnonzero(np.arange(len(whole)) + length <= woffs[1:][owner])
        alive = at[doubled(h, at, _levels(length))]
        repeated = alive[repeats.later(whole[alive], order[owner[alive]] << 32 | alive - woffs[owner[alive]])]
        again = np.zeros(len(h), bool)
        again[repeated] = True
        doc, lo, n, anchor = repeats.segments(seeds, woffs, length, seed, again)
        seg = joined(joined(whole[lo], whole[lo + n - 1]), n.astype(np.uint64))
        settled = owner[repeated], repeated - woffs[owner[repeated]], np.ones(len(repeated), np.int64)
        return doc, lo - woffs[doc], n, seeds[anchor], seg, settled

    return find


def _hashes(length: int):
    def hashes(texts: pa.Array, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        data, offs = flat(texts)
        starts, ends, woffs = words(data, offs)
        return grams(word_hashes(data, starts, ends), length)[ragged(woffs[doc] + lo, n.astype(np.int64))]

    return hashes


def _cut(length: int):
    def cut(texts: pa.Array, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.Array:
        data, offs = flat(texts)
        starts, ends, woffs = words(data, offs)
        h = word_hashes(data, starts, ends)
        counts = n.astype(np.int64) + length - 1
        values = h[ragged(woffs[doc] + lo, counts)]
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(values.view(np.int64)))

    return cut


def doubled(h: np.ndarray, starts: np.ndarray, levels: list[int]) -> np.ndarray:
    """Of the windows that begin at ``starts``, those repeated at every level; by their place in starts.

    h holds the unit hashes of all texts one after the other. At each level a window survives if both of its halves
    occur again among the halves of windows that survived the level before.
    """
    level = levels[0]
    hashes = grams(h, level)
    alive = np.arange(len(starts))
    for longer in levels[1:]:
        # A window of the longer length has two halves; both must be repeated at this length.
        half = longer - level
        first, second = hashes[starts[alive]], hashes[starts[alive] + half]
        values, counts = np.unique(np.concatenate([first, second]), return_counts=True)
        often = values[counts > 1]
        alive = alive[np.isin(first, often) & np.isin(second, often)]
        if not len(alive):
            break
        level = longer
        hashes = joined(hashes[:-half], hashes[half:]) if len(hashes) > half else hashes[:0]
    return alive


def _compare(length: int):
    levels = _levels(length)

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        content = batch.column("content")
        h = content.flatten().to_numpy().view(np.uint64)
        sizes = content.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        seg_start = np.cumsum(sizes) - sizes
        n = batch.column("n").to_numpy().astype(np.int64)
        seg = np.repeat(np.arange(len(n)), n)
        starts = ragged(seg_start, n)
        alive = doubled(h, starts, levels)
        if not len(alive):
            return
        seg, starts = seg[alive], starts[alive]
        doc, ties, lo = batch.column("doc_id").to_numpy()[seg], batch.column("tie").to_numpy()[seg], batch.column("lo").to_numpy()[seg] + starts - seg_start[seg]
        anchor = batch.column("anchor").to_numpy()[seg]
        at, first = first_of_equal((anchor, grams(h, length)[starts]), (doc, ties, lo), once=True)
        again = at[~first]
        if not len(again):
            return
        rseg, rlo, rn = repeats.merged(seg[again], lo[again], np.ones(len(again), np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rseg)), batch.column("tie").take(pa.array(rseg)), pa.array(rlo.astype(np.int32)), pa.array(rn.astype(np.int32))], names=["doc_id", "tie", "lo", "n"])

    return compare


def remove_repeated_words(docs: DataFrame, length: int = 20) -> DataFrame:
    """Removes each word covered by a window of ``length`` words whose sequence also starts earlier.

    Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A
    sequence starts earlier in a document of smaller doc_id or further up in the same one; windows are judged on the
    input. Inside a shard of documents, level by level: windows of a quarter of the length, of half, of the whole; a
    window goes on to the next level only if it is repeated at this one. Between shards, the first level is counted
    through anchors (see repeats), and what different surroundings leave is doubled again.

    Returns doc_id, n_words, spans (removed words, begin and end) and kept (the other words joined by one space), one
    row for each row of docs. A null text has no words. Rows equal in doc_id and text count as one document (none
    makes the other repeated); rows that share a doc_id with different texts follow each other by a hash of the text.
    Rows without a doc_id have no place in the order: they are kept whole and make nothing repeated. An empty table
    gives no rows. Columns other than doc_id and text are ignored.
    """
    keyed = repeats.with_tie(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    runs = repeats.repeated_windows(keyed, _find(length), _cut(length), _hashes(length), _compare(length), "array<long>")
    both = repeats.with_runs(keyed, runs, "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in repeats.unpacked(batches):
            data, offs = flat(chunk.column("text"))
            starts, ends, woffs = words(data, offs)
            raw = data.tobytes()
            spans, kept = [], []
            for i, found in enumerate(chunk.column("runs").to_pylist()):
                a, b = woffs[i], woffs[i + 1]
                gone = covered([(r["lo"], r["n"]) for r in found or ()], length)
                spans.append([{"begin": x, "end": y} for x, y in gone])
                stay, at = [], 0
                for x, y in [*gone, (b - a, b - a)]:
                    stay += range(a + at, a + x)
                    at = y
                kept.append(b" ".join([raw[starts[j] : ends[j]] for j in stay]) if gone else b" ".join(raw[offs[i] : offs[i + 1]].split()))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.diff(woffs)), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])

    return both.mapInArrow(remove, SCHEMA)


def removed_count() -> object:
    """How many units the column ``spans`` covers."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
