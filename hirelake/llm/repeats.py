"""Finding repeated windows without shuffling every window: anchors.

A window is a run of ``length`` units (words or bytes). A shard, some megabytes of whole documents, first settles its own
windows by what the caller brings (suffix arrays, doubled windows): of equal ones only the first goes on. The rest is
between shards. Of the runs of ``seed`` units inside a window, the one whose hash is least is its anchor, so two equal
windows have equal anchors at the same offset. Neighbouring windows mostly share their anchor: they make one *segment*,
and a segment is all that is shuffled, by the hash of its anchor, which is about two rows for every
``length - seed + 2`` units. Nothing is sampled: an anchor that occurs once proves that none of its windows repeats.

Segments of two shards that are equal as a whole are settled by their hash. What is left, different segments round an
equal anchor, is compared by content, by what the caller brings. An anchor with more than ``HOT`` such segments
(a line in a third of all documents, each time between other texts) would be too much for one task: its windows are
dealt one by one, by the hash of the whole window, and no group of rows is ever held.

Before that, all segments of an anchor would meet to be settled. So one document in ``HINT_SHARE`` is cut first, and
anchors that many of its segments have are dealt by segment as well. That is a hint to the shuffle only: equal segments
meet whether it is right or wrong, and the rows that come out are the same.

Documents are ordered by doc_id, then by a 64-bit hash of the text for rows that share a doc_id. Rows equal in both
count as one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, longs, mix, owners, sliding_min
from .tables import written

#: Segments of one anchor that a task compares by content; windows of an anchor with more are dealt one by one.
HOT = 20_000
#: So many such anchors (16 bytes each) are broadcast; more are joined.
BROADCAST_HOT = 100_000
#: Documents cut to tell which anchors have many segments: one in so many. It changes who meets where, and no result.
HINT_SHARE = 64
#: n > 0: n windows from lo on, to be compared. n < 0: -n windows known to repeat.
ROWS = "route long, seg long, doc_id long, tie long, lo int, n int"
FOUND = "doc_id long, tie long, lo int, n int, anchor long"
#: What a piece is: windows known to repeat, one window told by its hash, a segment with its content.
KNOWN, WINDOW, SEGMENT = 0, 1, 2


def with_tie(docs: DataFrame) -> DataFrame:
    """docs and ``tie``, which tells apart rows that share a doc_id: a hash of the text, or 0 where no doc_id repeats."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return docs.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("long"))


def segments(seeds: np.ndarray, offs: np.ndarray, length: int, seed: int, again: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window, number of windows and anchor's place of each segment; offs counts units.

    A segment of which all windows are marked in ``again`` (settled already) goes; others stay whole, so that equal
    ones of two shards look alike.
    """
    n, w = len(seeds), length - seed + 1
    none = np.zeros(0, np.int64)
    if n < w:
        return none, none, none, none
    places = np.uint64((1 << n.bit_length()) - 1)
    order = (mix(seeds) & ~places) | np.arange(n, dtype=np.uint64)
    least = sliding_min(order, w)
    doc = owners(offs)
    count = len(least)
    valid = np.arange(count) + length <= offs[1:][doc[:count]]
    anchor = (least & places).astype(np.int64)
    new = np.empty(count, bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (doc[1:count] != doc[: count - 1])
    begin = np.flatnonzero(new & valid)
    edge = np.append(np.flatnonzero(new | ~valid), count)
    size = edge[np.searchsorted(edge, begin, "right")] - begin
    done = np.append(0, np.cumsum(again[:count]))
    open_ = done[begin + size] - done[begin] < size
    begin, size = begin[open_], size[open_]
    return doc[begin], begin, size, anchor[begin]


def merged(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that follow each other, put together; doc is any key of the document."""
    order = np.lexsort((lo, doc))
    doc, lo, n = doc[order], lo[order], n[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.add.reduceat(n, at) if len(at) else n


def first_of_equal(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...], once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by keys, then by order; and for each whether it is the first with its keys.

    With ``once``, rows equal in keys and order (what a repeated document brings again) come as one.
    """
    at = np.lexsort(tuple(reversed(keys + order)))
    first = np.ones(len(at), bool)
    for i, key in enumerate(keys):
        changed = key[at][1:] != key[at][:-1]
        first[1:] = changed if i == 0 else first[1:] | changed
    if once:
        own = first.copy()
        for key in order:
            own[1:] |= key[at][1:] != key[at][:-1]
        at, first = at[own], first[own]
    return at, first


def later(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether another row has an equal value and a lesser order."""
    out = np.zeros(len(values), bool)
    if len(values):
        at = np.argsort(values, kind="stable")
        sorted_values, sorted_order = values[at], order[at]
        start = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
        least = np.minimum.reduceat(sorted_order, start)
        out[at] = sorted_order > np.repeat(least, np.diff(np.append(start, len(at))))
    return out


def ranked(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The place of each document in the order of documents; equal for rows that count as one."""
    at, first = first_of_equal((ids, ties), ())
    out = np.empty(len(ids), np.int64)
    out[at] = np.cumsum(first) - 1
    return out


def _map(find: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            ids, ties = longs(chunk.column("doc_id")), longs(chunk.column("tie"))
            doc, lo, n, anchor, seg, settled = find(chunk.column("text"), ranked(ids, ties))
            at, first = first_of_equal((anchor, seg), (ids[doc], ties[doc], lo), once=True)
            kept, again = at[first], at[~first]
            rdoc, rlo, rn = merged(np.concatenate([doc[again], settled[0]]), np.concatenate([lo[again], settled[1]]), np.concatenate([n[again], settled[2]]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([anchor[kept].view(np.int64), mix(ids[rdoc].view(np.uint64)).view(np.int64)])),
                    pa.array(np.concatenate([seg[kept].view(np.int64), np.zeros(len(rdoc), np.int64)])),
                    pa.array(np.concatenate([ids[doc[kept]], ids[rdoc]])),
                    pa.array(np.concatenate([ties[doc[kept]], ties[rdoc]])),
                    pa.array(np.concatenate([lo[kept], rlo]).astype(np.int32)),
                    pa.array(np.concatenate([n[kept], -rn]).astype(np.int32)),
                ],
                names=["route", "seg", "doc_id", "tie", "lo", "n"],
            )

    return run


def by_group(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by key, cut only between groups, of ``least`` rows or more each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
        if cut:
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
            rows = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _changes(columns: list[np.ndarray], before: list | None) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; ``before`` is the last row so far."""
    out = np.zeros(len(columns[0]), bool)
    for i, column in enumerate(columns):
        out[1:] |= column[1:] != column[:-1]
        out[0] |= before is None or column[0] != before[i]
    return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by route, segment, document and place, a batch at a time; of a group no more than one row is held.

    The first of equal segments stays, later ones are known to repeat; a segment that stays goes on if its anchor has
    another one. Of an anchor dealt by segment (a column ``parts``, not null) every segment that stays goes on.
    """

    def rows(ids, ties, lo, n, anchor) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ties), pa.array(lo), pa.array(n), pa.array(anchor)], names=["doc_id", "tie", "lo", "n", "anchor"])

    last: list | None = None
    held: list[np.ndarray] | None = None  # the last segment that stayed, and whether its anchor had one before it
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("route", "seg", "doc_id", "tie", "lo", "n")]
        dealt = batch.column("parts").is_valid().to_numpy(zero_copy_only=False) if "parts" in batch.schema.names else np.zeros(len(columns[0]), bool)
        columns.append(dealt)
        known = columns[5] < 0
        if known.any():
            ids, ties, lo, n = (x[known] for x in columns[2:6])
            yield rows(ids, ties, lo, n, np.zeros(len(n), np.int64))
            columns = [x[~known] for x in columns]
        if not len(columns[0]):
            continue
        other = _changes(columns[:2], last)
        again = ~other & _changes(columns[2:5], last[2:5] if last else None)
        last = [x[-1] for x in columns]
        if again.any():
            ids, ties, lo, n = (x[again] for x in columns[2:6])
            yield rows(ids, ties, lo, -n, np.zeros(len(n), np.int64))
        stay = [columns[i][other] for i in (2, 3, 4, 5, 0, 6)]
        if held is not None:
            stay = [np.concatenate(x) for x in zip(held, stay, strict=True)]
        if not len(stay[0]):
            continue
        same = stay[4][1:] == stay[4][:-1]
        many = stay[5]
        many[1:] |= same
        held = [x[-1:].copy() for x in stay]
        many[:-1] |= same
        go = many[:-1]
        if go.any():
            yield rows(*(x[:-1][go] for x in stay[:5]))
    if held is not None and held[5][0]:
        yield rows(*held[:5])


def _dealt(known_ids: DataFrame, find: Callable) -> DataFrame:
    """The segments of all documents, those of one anchor in one partition, or in several if it seems to have many.

    An anchor of which the hint's documents have more than ``HOT / HINT_SHARE`` segments is dealt in ``parts``, by the
    hash of the segment; so are no more than ``BROADCAST_HOT`` anchors, as each has more than its part of the hint's rows.
    """
    rows = known_ids.mapInArrow(_map(find), ROWS)
    some = known_ids.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(HINT_SHARE)) == 0).mapInArrow(_map(find), ROWS)
    hint = written(some.where("n > 0").groupBy("route").agg(F.count("*").alias("rows")).where(F.col("rows") * HINT_SHARE > HOT), "hint")
    least = max(HOT // HINT_SHARE, (hint.agg(F.sum("rows")).first()[0] or 0) // BROADCAST_HOT if BROADCAST_HOT else 0)
    often = hint.where(F.col("rows") > least).select("route", F.ceil(F.col("rows") * HINT_SHARE / HOT).alias("parts"))
    if not often.limit(1).count():
        return rows.repartition("route")
    return rows.join(F.broadcast(often), "route", "left").repartition("route", F.pmod("seg", F.coalesce("parts", F.lit(1))))


def repeated_windows(docs: DataFrame, find: Callable, cut: Callable, hashes: Callable, compare: Callable, content: str) -> DataFrame:
    """The windows of each document that also start earlier: doc_id, tie, runs array<struct<lo, n>>.

    docs: doc_id, tie, text and any others; rows without a doc_id have no part. find(texts, order of the documents)
    gives document, first window, count, anchor hash and segment hash of each segment, and the windows settled inside
    the shard as (document, first window, count). cut(texts, document, first window, count) gives the content of each
    run and hashes(the same) the hash of each of its windows; compare(batches of anchor, doc_id, tie, lo, n, content;
    sorted by anchor, whole groups) the rows (doc_id, tie, lo, n) that repeat.

    Texts are joined twice, here and by the caller, over the same columns and keys, so that Spark shuffles them once.
    """
    known_ids = docs.where("doc_id IS NOT NULL").select("doc_id", "tie", "text")
    keys = ["route", "seg", "doc_id", "tie", "lo"]
    found = written(_dealt(known_ids, find).sortWithinPartitions(*keys).mapInArrow(_resolve, FOUND), "segments")
    left = found.where("n > 0")
    hot = written(left.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    wanted = left.join(hot, "anchor", "left").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("lo", "n", "anchor", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    pieces = with_runs(docs, wanted, "inner").mapInArrow(_cut(cut, hashes), f"kind int, anchor long, doc_id long, tie long, lo int, n int, content {content}")
    settled = pieces.repartition("kind", "anchor").sortWithinPartitions("kind", "anchor", "doc_id", "tie", "lo").mapInArrow(_settle(compare), "doc_id long, tie long, lo int, n int")
    known = found.where("n < 0").select("doc_id", "tie", "lo", (-F.col("n")).alias("n"))
    return known.unionByName(settled).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))


def with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """docs (all columns, in one struct ``row``) with their ``runs``."""
    own = docs.select("doc_id", "tie", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return own.join(runs, own.doc_id.eqNullSafe(runs.doc_id) & (own.tie == runs.tie), how).select(own.row, runs.runs)


def _cut(cut: Callable, hashes: Callable) -> Callable:
    names = ["kind", "anchor", "doc_id", "tie", "lo", "n", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in unpacked(batches):
            runs = chunk.column("runs")
            flat = runs.flatten()
            doc = np.repeat(np.arange(chunk.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
            lo, n, anchor, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lo", "n", "anchor", "hot"))
            ids, ties, texts = longs(chunk.column("doc_id")), longs(chunk.column("tie")), chunk.column("text")

            def rows(kind: int, anchor: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, content: pa.Array | None = None, ids=ids, ties=ties) -> pa.RecordBatch:
                content = pa.nulls(len(doc), empty.type) if content is None else content
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(anchor), pa.array(ids[doc]), pa.array(ties[doc]), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32)), content], names=names)

            cold = ~hot
            empty = cut(texts, doc[cold], lo[cold], n[cold])
            yield rows(SEGMENT, anchor[cold], doc[cold], lo[cold], n[cold], empty)
            if not hot.any():
                continue
            doc, lo, n = doc[hot], lo[hot], n[hot]
            window = hashes(texts, doc, lo, n)
            doc, lo = np.repeat(doc, n), ragged(lo.astype(np.int64), n.astype(np.int64))
            at, first = first_of_equal((window,), (ids[doc], ties[doc], lo), once=True)
            kept, again = at[first], at[~first]
            yield rows(WINDOW, window[kept].view(np.int64), doc[kept], lo[kept], np.ones(len(kept), np.int64))
            rdoc, rlo, rn = merged(doc[again], lo[again], np.ones(len(again), np.int64))
            yield rows(KNOWN, mix(ids[rdoc].view(np.uint64)).view(np.int64), rdoc, rlo, rn)

    return run


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (row, runs), as ``with_runs`` gives them, in pieces of bounded text with the columns doc_id, tie, text, runs and row."""
    for batch in batches:
        row = batch.column("row")
        fields = [row.field(row.type.get_field_index(c)) for c in ("doc_id", "tie", "text")]
        yield from chunks(iter([pa.RecordBatch.from_arrays([*fields, batch.column("runs"), row], names=["doc_id", "tie", "text", "runs", "row"])]))


def _settle(compare: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "tie", "lo", "n"]
        last: list | None = None
        rest: Iterator[pa.RecordBatch] = iter(())
        for batch in batches:
            low = int(np.searchsorted(batch.column("kind").to_numpy(), SEGMENT))
            head = batch.slice(0, low)
            if low:
                kind, *columns = (head.column(c).to_numpy() for c in ("kind", "anchor", "doc_id", "tie", "lo"))
                # Of the rows of one window, the first in order stays; a repeated row comes again and is told by its place.
                other = _changes([kind, columns[0]], last)
                again = ~other & _changes(columns[1:], last[2:] if last else None)
                last = [kind[-1], *(x[-1] for x in columns)]
                yield head.filter(pa.array((kind == KNOWN) | again)).select(names)
            if low < batch.num_rows:
                rest = chain([batch.slice(low)], batches)
                break
        for group in by_group(rest, "anchor", 4000):
            # The texts of a repeated row are all joined with its runs.
            at, first = first_of_equal(tuple(group.column(c).to_numpy() for c in ("anchor", "doc_id", "tie", "lo")), ())
            yield from compare(group if first.all() else group.take(pa.array(at[first])))

    return run


def covered(runs: list, length: int) -> list[tuple[int, int]]:
    """The units that windows cover, as maximal spans; runs are of (first window, count)."""
    spans: list[tuple[int, int]] = []
    for lo, n in sorted(runs):
        end = lo + n - 1 + length
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
        else:
            spans.append((lo, end))
    return spans


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then from starts[1], ..."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)
