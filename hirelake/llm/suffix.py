"""Repeated byte strings, found with suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .arrays import eights, flat, joined, padded
from .repeats import covered, first_of_equal, ragged

SEED = 32
#: Bytes of one suffix array; larger groups are cut into several, which are then merged.
SHARD_BYTES = 1 << 20
SCHEMA = "doc_id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary"


def suffix_array(text: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by Larsson and Sadakane's refinement.

    Suffixes are first ordered by eight bytes; each round doubles the order's depth, and looks only at groups of
    suffixes that are still equal. A group's rank is its last place. With ``most``, suffixes equal in that many bytes
    may stay in any order.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    key = eights(padded(text), n).byteswap()
    sa = np.argsort(key).astype(np.int32)
    sorted_keys = key[sa]
    new = np.append(np.append(True, sorted_keys[1:] != sorted_keys[:-1]), True)
    del key, sorted_keys
    # Behind the ranks stand those of what would follow the text's end, the nearer the higher, all below the others.
    ranks = np.concatenate([np.zeros(n, np.int32), -1 - np.arange(min(2 * n, most or 2 * n) + 8, dtype=np.int32)])
    rank = ranks[:n]
    bounds = np.flatnonzero(new)
    rank[sa] = np.repeat((bounds[1:] - 1).astype(np.int32), np.diff(bounds))
    # A suffix shorter than eight bytes goes before the longer ones that start with it and zeros.
    depth = 8
    while depth < min(2 * n, most or 2 * n):
        size = np.diff(bounds)
        open_groups = np.flatnonzero(size > 1)
        if not len(open_groups):
            break
        places = ragged(bounds[open_groups], size[open_groups])
        suffix = sa[places]
        both = np.repeat(open_groups << 32, size[open_groups])
        both |= ranks[suffix + depth] + np.int64(2 * n + 16)
        del size, open_groups
        order = np.argsort(both)
        suffix, both = suffix[order], both[order]
        sa[places] = suffix
        fresh = np.append(True, both[1:] != both[:-1])
        new[places[fresh]] = True
        bounds = np.flatnonzero(new)
        edges = np.append(np.flatnonzero(fresh), len(places))
        rank[suffix] = np.repeat(places[edges[1:] - 1].astype(np.int32), np.diff(edges))
        depth *= 2
    return sa, rank


#: Places of the text that one lane of ``common_prefixes`` goes through.
LANE = 64


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Kasai's lengths: how many bytes each suffix shares with the one before it in the suffix array, up to ``most``.

    A suffix shares at least one byte less than the suffix one place further up in the text did, if what that one was
    before also comes before this one (it may not where the array is sorted by ``most`` bytes only). The text is cut
    into lanes that advance together, one place a step; bytes are compared eight at a time.
    """
    n = len(text)
    lcp = np.zeros(n, np.int16 if most < 32768 else np.int64)
    if n < 2:
        return lcp
    view = eights(np.concatenate([padded(text), np.zeros(most + 8, np.uint8)]), n + most + 8)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    starts = np.arange(0, n, LANE)
    length, other = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    for step in range(LANE):
        at = starts + step
        if at[-1] >= n:
            starts, length, at, other = starts[:-1], length[:-1], at[:-1], other[:-1]
            if not len(at):
                break
        length = np.where((other >= 0) & (rank[np.minimum(other + 1, n - 1)] < rank[at]), length, 0)
        other = before[at]
        room = np.minimum(most, n - np.maximum(at, other))
        now = np.where(other < 0, 0, np.maximum(length - 1, 0))
        go = np.flatnonzero((other >= 0) & (now < room))
        while len(go):
            so_far = now[go]
            x = view[at[go] + so_far] ^ view[other[go] + so_far]
            alike = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # bytes below the lowest bit that differs
            now[go] = so_far = so_far + alike
            go = go[(alike == 8) & (so_far < room[go])]
        length = np.minimum(now, room) if (other >= 0).all() else np.where(other < 0, 0, np.minimum(now, room))
        lcp[rank[at]] = length
    return lcp


#: Counters by which ``repeated_in_shard`` tells seeds that occur once.
COUNTERS = 1 << 22


def repeated_in_shard(text: np.ndarray, seeds: np.ndarray, at: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of the strings of ``length`` bytes from the places ``at`` on, those of which an equal one is less in ``order``.

    seeds are the hashes of the ``SEED`` bytes from each place. A string that holds a seed which occurs once in the
    shard has no equal one; what no other string covers is left out of the suffix array.
    """
    slot = (seeds & np.uint64(COUNTERS - 1)).astype(np.int32)
    # Of the places of a slot the last one stays in ``last``: all others show that it has several.
    last = np.zeros(COUNTERS, np.int32)
    places = np.arange(len(slot), dtype=np.int32)
    last[slot] = places
    several = np.zeros(COUNTERS, bool)
    several[slot[last[slot] != places]] = True
    often = several[slot]
    del last, several, places, slot
    once = np.append(np.int32(0), np.cumsum(~often, dtype=np.int32))
    maybe = np.flatnonzero(once[at + length - SEED + 1] == once[at])
    out = np.zeros(len(at), bool)
    if not len(maybe):
        return out
    edges = np.bincount(at[maybe], minlength=len(text) + 1) - np.bincount(at[maybe] + length, minlength=len(text) + 1)
    keep = np.cumsum(edges[:-1]) > 0
    place = np.cumsum(keep) - 1
    out[maybe] = _repeated(text[keep], place[at[maybe]], order[maybe], length)
    return out


def _repeated(text: np.ndarray, at: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """As ``repeated_in_shard``, by the suffix array of all of text."""
    sa, rank = suffix_array(text, length)
    # Ranks of suffixes equal in so many bytes need not be places: number them by the array itself.
    rank[sa] = np.arange(len(sa), dtype=np.int32)
    classes = np.cumsum(common_prefixes(text, sa, rank, length) < length)[rank[at]]
    many = np.flatnonzero(np.bincount(classes, minlength=1)[classes] > 1)
    out = np.zeros(len(at), bool)
    out[many] = repeats.later(classes[many], order[many])
    return out


class Shard:
    """The windows of some segments, sorted through their suffix array; equal windows share a class."""

    def __init__(self, content: np.ndarray, sizes: np.ndarray, windows: np.ndarray, order: tuple[np.ndarray, ...], length: int):
        # A zero byte ends each segment.
        m = len(sizes)
        text = np.zeros(len(content) + m, np.uint8)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text[ragged(starts, sizes)] = content
        sa, rank = suffix_array(text, length)
        rank[sa] = np.arange(len(sa), dtype=np.int32)
        lcp = common_prefixes(text, sa, rank, length)
        seg = np.repeat(np.arange(m), windows)
        at = ragged(starts, windows)
        sorted_at = np.argsort(rank[at])
        self.seg, at = seg[sorted_at], at[sorted_at]
        self.offset = at - starts[self.seg]
        classes = np.cumsum(lcp < length)[rank[at]]
        order = tuple(x[self.seg] + (self.offset if i == len(order) - 1 else 0) for i, x in enumerate(order))
        # A repeated document brings its windows again, maybe in other segments: they count once.
        rows, self.first = first_of_equal((classes,), order, once=True)
        self.seg, self.offset, at, self.order = self.seg[rows], self.offset[rows], at[rows], tuple(x[rows] for x in order)
        #: The first of each class, in the order of their bytes.
        self.heads = np.flatnonzero(self.first)
        self.text, self.at, self.length = text, at, length

    def keys(self) -> np.ndarray:
        """The bytes of each class, in order, as values that compare as bytes do (a one keeps closing zeros)."""
        rows = self.text[self.at[self.heads][:, None] + np.arange(self.length)]
        return np.ascontiguousarray(np.hstack([rows, np.ones((len(rows), 1), np.uint8)])).view(f"S{self.length + 1}").ravel()

    def merge(self, other: Shard) -> None:
        """Looks up each class here among the other's by binary search; the later of two equal ones isn't first any more."""
        mine, theirs = self.keys(), other.keys()
        if not len(mine) or not len(theirs):
            return
        at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
        same = np.flatnonzero(theirs[at] == mine)
        a, b = self.heads[same], other.heads[at[same]]
        earlier, equal = np.zeros(len(same), bool), np.ones(len(same), bool)
        for x, y in zip(self.order, other.order, strict=True):
            earlier |= equal & (x[a] < y[b])
            equal &= x[a] == y[b]
        other.first[b[earlier]] = False
        self.first[a[~earlier & ~equal]] = False


def _find(length: int):
    def find(texts: pa.Array, order: np.ndarray):
        data, offs = flat(texts)
        seeds = _seeds(data)
        sizes = np.diff(offs)
        valid = np.arange(len(data)) + length <= np.repeat(offs[1:], sizes)
        place = np.repeat((order << 32) - offs[:-1], sizes) + np.arange(len(data))
        again = np.zeros(len(data), bool)
        for begin in range(0, len(data), SHARD_BYTES):  # one text may be longer than a shard
            at, end = begin + np.flatnonzero(valid[begin : begin + SHARD_BYTES]), min(begin + SHARD_BYTES + length - 1, len(data))
            if len(at):
                again[at] = repeated_in_shard(data[begin:end], seeds[begin : max(begin, end - SEED + 1)], at - begin, place[at], length)
        del valid, place
        doc, lo, k, anchor = repeats.segments(seeds, offs, length, SEED, again)
        seg = joined(joined(_window(seeds, lo, length), _window(seeds, lo + k - 1, length)), k.astype(np.uint64))
        at = np.flatnonzero(again)
        owner = np.searchsorted(offs, at, "right") - 1
        return doc, lo - offs[doc], k, seeds[anchor], seg, (owner, at - offs[owner], np.ones(len(at), np.int64))

    return find


def _seeds(data: np.ndarray) -> np.ndarray:
    """The hash of the SEED bytes from each place."""
    n = len(data)
    m = max(0, n - SEED + 1)
    if not m:
        return np.zeros(0, np.uint64)
    view = eights(padded(data), n)
    pair = joined(view[: n - 15], view[8 : n - 7])
    return joined(pair[:m], pair[16 : 16 + m])


def _window(seeds: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` bytes from each of the places."""
    out = seeds[at]
    for step in [*range(SEED, length - SEED, SEED), length - SEED]:
        out = joined(out, seeds[at + step])
    return out


def _hashes(length: int):
    def hashes(texts: pa.Array, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        data, offs = flat(texts)
        return _window(_seeds(data), ragged(offs[doc] + lo, n.astype(np.int64)), length)

    return hashes


def _cut(length: int):
    def cut(texts: pa.Array, doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.Array:
        data, offs = flat(texts)
        counts = n.astype(np.int64) + length - 1
        values = data[ragged(offs[doc] + lo, counts)]
        return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.py_buffer(values)])

    return cut


def _compare(length: int):
    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offs = flat(batch.column("content"))
        sizes = np.diff(offs)
        n = batch.column("n").to_numpy().astype(np.int64)
        ids, ties, lo = batch.column("doc_id").to_numpy(), batch.column("tie").to_numpy(), batch.column("lo").to_numpy()
        anchor = batch.column("anchor").to_numpy()
        # Whole groups make a shard; a group larger than a shard makes several.
        group_end = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
        shards: list[tuple[int, int, bool]] = []
        begin = 0
        for end in group_end:
            while offs[end] - offs[begin] > 2 * SHARD_BYTES:
                cut = max(begin + 1, int(np.searchsorted(offs, offs[begin] + SHARD_BYTES, "right")) - 1)
                shards.append((begin, cut, cut < end))
                begin = cut
            if offs[end] - offs[begin] > SHARD_BYTES or end == len(anchor):
                if end > begin:
                    shards.append((begin, int(end), False))
                begin = int(end)
        open_shards: list[tuple[int, Shard]] = []
        for b, e, more in shards:
            shard = Shard(data[offs[b] : offs[e]], sizes[b:e], n[b:e], (ids[b:e], ties[b:e], lo[b:e]), length)
            for _, earlier in open_shards:
                shard.merge(earlier)
            open_shards.append((b, shard))
            if more:
                continue
            for base, done in open_shards:
                again = ~done.first
                seg = done.seg[again] + base
                rseg, rlo, rn = repeats.merged(seg, lo[seg] + done.offset[again], np.ones(len(seg), np.int64))
                if len(rseg):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rseg)), batch.column("tie").take(pa.array(rseg)), pa.array(rlo.astype(np.int32)), pa.array(rn.astype(np.int32))], names=["doc_id", "tie", "lo", "n"])
            open_shards = []

    return compare


def remove_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """Removes each byte covered by a string of ``length`` UTF-8 bytes that also starts earlier.

    A string starts earlier in a document of smaller doc_id or further up in the same one; matches never cross
    documents, overlaps count, and strings are judged on the input. Every shard of the corpus has a suffix array, which
    settles what repeats inside it; what is left is merged between shards (see repeats): by the hash of whole segments
    and, where surroundings differ, through suffix arrays of the segments, merged by binary search.

    Returns doc_id, n_bytes, spans (maximal removed runs, begin and end) and kept (the other bytes), one row for each
    row of docs. A null text is empty. Rows equal in doc_id and text count as one document; rows that share a doc_id
    with different texts follow each other by a hash of the text. Rows without a doc_id are kept whole and make
    nothing repeated. Columns other than doc_id and text are ignored.
    """
    both = _with_runs(docs.select("doc_id", "text"), length)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in repeats.unpacked(batches):
            sizes, spans, kept = _left_over(chunk, length)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(sizes), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return both.mapInArrow(remove, SCHEMA)


def _with_runs(docs: DataFrame, length: int) -> DataFrame:
    """docs in one struct ``row`` (with ``tie`` as its last field), and the repeated windows of each document."""
    if length < 2 * SEED:
        raise ValueError(f"the length must be at least {2 * SEED}")
    keyed = repeats.with_tie(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    runs = repeats.repeated_windows(keyed, _find(length), _cut(length), _hashes(length), _compare(length), "binary")
    return repeats.with_runs(keyed, runs, "left")


def _left_over(chunk: pa.RecordBatch, length: int) -> tuple[np.ndarray, list, list[bytes]]:
    data, offs = flat(chunk.column("text"))
    raw = data.tobytes()
    spans, kept = [], []
    for i, found in enumerate(chunk.column("runs").to_pylist()):
        text = raw[offs[i] : offs[i + 1]]
        gone = covered([(r["lo"], r["n"]) for r in found or ()], length)
        spans.append([{"begin": x, "end": y} for x, y in gone])
        kept.append(b"".join(text[a:b] for a, b in zip([0, *(y for _, y in gone)], [*(x for x, _ in gone), len(text)], strict=True)) if gone else text)
    return np.diff(offs), spans, kept


def strip_repeated_bytes(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with each text replaced by what ``remove_repeated_bytes`` leaves of it, all other columns as they are.

    A character cut in the middle goes as a whole. Rows of which nothing is left go; texts that were empty stay.
    """
    names = docs.columns
    whole = docs.select(F.col("doc_id").alias("doc_id"), "text", F.struct(*[docs[f"`{c}`"] for c in names if c != "text"]).alias("whole"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in repeats.unpacked(batches):
            sizes, _, kept = _left_over(chunk, length)
            texts = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            texts = pa.compute.if_else(chunk.column("text").is_valid(), texts, pa.scalar(None, pa.string()))
            stay = pa.array([bool(k) or not n for k, n in zip(kept, sizes, strict=True)])
            row = chunk.column("row")
            own = row.field(row.type.get_field_index("whole"))
            yield pa.RecordBatch.from_arrays([texts if c == "text" else own.field(own.type.get_field_index(c)) for c in names], names=names).filter(stay)

    return _with_runs(whole, length).mapInArrow(replace, docs.schema)
