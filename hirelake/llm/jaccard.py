"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

All documents order their shingles alike, rare ones first. Two sets alike enough share at least m shingles among the
first ``n - ceil(t n) + m`` of each (n: a set's size, t: the least likeness). Each document picks its own m: a longer
prefix costs more rows, but asks candidates for more shared shingles. A pair is verified exactly if its shared prefix
shingles reach the lesser m of the two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, flat, grams, joined, longs, lowered, mix, owners, word_hashes, words
from .components import components
from .tables import small_batches, written

#: Counters of the frequency sketch: every shingle of every document is counted in one of them.
BUCKETS = 1 << 18
#: Arrays of counters that a task adds up.
FAN_IN = 64
#: Largest m that a document may pick, and the cost of verifying a candidate in prefix rows.
MOST_MATCHES, VERIFY_COST = 3, 8.0
_B = np.uint64(BUCKETS - 1)
#: Bits of a set's parity bitmap, and the most documents whose ids are broadcast to pick them from the corpus.
BITS, BROADCAST_IDS = 2048, 1_000_000
#: Documents whose bitmaps are made at a time: a bit is a count of eight bytes until its parity is taken.
BITMAP_ROWS = 128
#: Sets of copies that are broadcast at most, and the least copies of one.
HOT_SETS, LEAST_COPIES = 10_000, 1000
#: Sets from this size on have a wide bitmap as well, as a narrow one tells nothing of them.
WIDE_FROM, WIDE_BITS = 1200, 32768


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, sorted; a text of fewer words is one shingle as a whole."""
    data, offs = flat(texts)
    data = lowered(data)
    starts, ends, woffs = words(data, offs)
    h = word_hashes(data, starts, ends)
    counts = np.diff(woffs)
    full = grams(h, size)
    doc = owners(woffs)[: len(full)]
    good = np.arange(len(full)) + size <= woffs[1:][doc]
    docs, tokens = [doc[good]], [full[good]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            docs.append(short)
            tokens.append(joined(grams(h, n)[woffs[short]], np.full(len(short), n, np.uint64)))
    doc, token = np.concatenate(docs), np.concatenate(tokens)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    return doc[new], token[new]


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if len(doc):
        at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[at]] = np.add.reduceat(values, at)
    return out


def _parities(doc: np.ndarray, token: np.ndarray, n: int) -> pa.Array:
    """For each document BITS bits: whether an odd number of its hashes falls on each.

    The bits in which two bitmaps differ are at most as many as the hashes that only one of the sets has.
    """
    bit = (token >> np.uint64(40) & np.uint64(BITS - 1)).astype(np.int64)
    packed = []
    for at in range(0, n, BITMAP_ROWS):
        to = min(at + BITMAP_ROWS, n)
        lo, hi = np.searchsorted(doc, [at, to])
        odd = np.bincount((doc[lo:hi] - at) * BITS + bit[lo:hi], minlength=(to - at) * BITS)
        odd &= 1
        packed.append(np.packbits(odd.astype(np.uint8)))
    return pa.ListArray.from_arrays(np.arange(0, (n + 1) * (BITS // 64), BITS // 64, dtype=np.int32), pa.array(np.concatenate([np.zeros(0, np.uint8), *packed]).view(np.int64)))


def _wide(doc: np.ndarray, token: np.ndarray, n: int) -> pa.Array:
    """The same with WIDE_BITS bits for large sets, null for others."""
    out: list = [None] * n
    at = np.searchsorted(doc, np.arange(n + 1))
    for i in np.flatnonzero(np.diff(at) >= WIDE_FROM):
        bit = (token[at[i] : at[i + 1]] >> np.uint64(40) & np.uint64(WIDE_BITS - 1)).astype(np.int64)
        out[i] = np.packbits((np.bincount(bit, minlength=WIDE_BITS) & 1).astype(np.uint8)).view(np.int64)
    return pa.array(out, pa.list_(pa.int64()))


def _summaries(size: int):
    """One row a document (set size and two set hashes), and one row a task with its counts of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "n", "s1", "s2", "bits", "wide", "counts"]
        for chunk in chunks(batches):
            doc, token = shingle_sets(chunk.column("text"), size)
            m = chunk.num_rows
            counts += np.bincount((token & _B).astype(np.int64), minlength=BUCKETS)
            s1, s2 = _sums(doc, mix(token), m).view(np.int64), _sums(doc, mix(token ^ np.uint64(0x5851F42D4C957F2D)), m).view(np.int64)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.bincount(doc, minlength=m)), pa.array(s1), pa.array(s2), _parities(doc, token, m), _wide(doc, token, m), pa.nulls(m, pa.binary())], names=names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int64())), pa.array([counts.tobytes()], pa.binary())], names=names)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("counts"):
            row = np.frombuffer(value.as_buffer(), np.int64)
            total = row.copy() if total is None else total + row
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


def frequencies(parts: DataFrame) -> np.ndarray:
    """The tasks' counts added up in a tree in which no task adds up more than some ``FAN_IN`` of them, a few at a time.

    What reaches the driver is one array of ``BUCKETS`` numbers.
    """
    rows = parts.count()
    while rows > FAN_IN:
        rows = -(-rows // FAN_IN)
        parts = written(parts.repartition(rows).mapInArrow(_add, "counts binary"), "counts")
    with small_batches(parts.sparkSession):  # else Python gets all of them in one batch
        total = parts.repartition(1).mapInArrow(_add, "counts binary").first()
    return np.frombuffer(bytes(total.counts), np.int64) if total else np.zeros(BUCKETS, np.int64)


def _excess(counts: np.ndarray) -> np.ndarray:
    """For each counter, by how much it stands out above what chance collisions give; 0 where it doesn't."""
    mean = counts.mean()
    return np.where(counts > mean + 6 * np.sqrt(mean) + 2, counts - mean, 0)


def _prefixes(size: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        excess = shared.value
        rank = np.where(excess > 0, 1 + np.log2(np.maximum(excess, 1)), 0).astype(np.uint64) << np.uint64(56)
        for chunk in chunks(batches):
            doc, token = shingle_sets(chunk.column("text"), size)
            m = chunk.num_rows
            if not len(doc):
                continue
            n = np.bincount(doc, minlength=m)
            # Of the documents of this chunk with equal sets, one speaks for all.
            sums = np.stack([_sums(doc, mix(token), m), _sums(doc, mix(token ^ np.uint64(0x5851F42D4C957F2D)), m), n.astype(np.uint64)])
            _, one = np.unique(sums, axis=1, return_index=True)
            speaks = np.zeros(m, bool)
            speaks[one] = True
            speaks &= n > 0
            keep = speaks[doc]
            doc, token = doc[keep], token[keep]
            bucket = (token & _B).astype(np.int64)
            key = (token >> np.uint64(8)) | rank[bucket]
            order = np.lexsort((key, doc))
            doc, token, bucket, key = doc[order], token[order], bucket[order], key[order]
            begin = np.zeros(m, np.int64)
            at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            begin[doc[at]] = at
            place = np.arange(len(doc)) - begin[doc]
            need = -(-n * percent // 100)
            # Cost of each m: its prefix rows, and candidates among the lists these rows meet.
            lists = np.concatenate([[0.0], np.cumsum(excess[bucket])])
            best, matches = np.full(m, np.inf), np.ones(m, np.int64)
            for k in range(1, MOST_MATCHES + 1):
                length = n - need + k
                met = lists[np.minimum(begin + length, len(doc))] - lists[begin]
                cost = np.where(need >= k, length + met + VERIFY_COST * met / (k * k), np.inf)
                matches = np.where(cost < best, k, matches)
                best = np.minimum(best, cost)
            length = np.minimum(n, n - need + matches)
            take = place < length[doc]
            # Rare shingles come first: a prefix that reaches past them holds all that the set has.
            rare = excess[bucket] == 0
            rares = np.bincount(doc[rare], minlength=m)
            info = np.minimum(rares, length)[doc] << 4 | (rares <= length)[doc] << 3 | rare << 2 | (matches - 1)[doc]
            # Where in the common order the prefix ends, to 32 bits.
            last = np.zeros(m, np.int32)
            last[doc[at]] = (key[at + length[doc[at]] - 1] >> np.uint64(32)).astype(np.int32)
            ids = longs(chunk.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(token[take].view(np.int64)), pa.array(ids[doc[take]]), pa.array(info[take].astype(np.int32)), pa.array(last[doc[take]])], names=["token", "doc_id", "info", "last"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            doc, token = shingle_sets(chunk.column("text"), size)
            counts = np.bincount(doc, minlength=chunk.num_rows)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.array(token.view(np.int64)))], names=["doc_id", "tokens"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, bitmaps: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose sets are alike enough: ``shared`` hashes in both, ``both`` in the two together.

    Bitmaps rule most pairs out first: too many differing bits prove too many hashes that only one set has.
    """
    x, y = (bitmaps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits_{c}"), F.col("wide").alias(f"wide_{c}")) for c in ("a", "b"))
    both_wide = F.col("wide_a").isNotNull() & F.col("wide_b").isNotNull()
    one, two = (F.when(both_wide, F.col(f"wide_{c}")).otherwise(F.col(f"bits_{c}")) for c in ("a", "b"))
    differ = F.aggregate(F.zip_with(one, two, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    near = pairs.select("a", "b").join(x, "a").join(y, "b").where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    near = written(near.select("a", "b"), "near")
    ids = written(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(size), "doc_id long, tokens array<long>")
    left, right = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    met = near.join(left, "a").join(right, "b")
    counted = met.select("a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("shared"), (F.size("ta") + F.size("tb")).alias("both"))
    return counted.where(F.col("shared") * 100 >= (F.col("both") - F.col("shared")) * percent)


def _speakers(members: DataFrame) -> DataFrame:
    """doc_id, n, node: of the documents with equal sets the least id speaks for all; no node for an empty set.

    Sets with more copies than one document in ``1 / HOT_SETS`` (1,000 at least) are no more than ``HOT_SETS``: they are
    broadcast, so that no task gets all copies of one. The others are joined.
    """
    keys = ["n", "s1", "s2"]
    some = F.expr("n > 0 AND doc_id IS NOT NULL")
    sets = members.where(some).groupBy(*keys).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    most = max(LEAST_COPIES, members.count() // HOT_SETS)
    hot = F.broadcast(sets.where(F.col("copies") > most).select(*keys, F.col("node").alias("hot")))
    marked = members.where(some).join(hot, keys, "left")
    cold = marked.where("hot IS NULL").select("doc_id", *keys).join(sets.where(F.col("copies") <= most), keys)
    none = members.where(~F.coalesce(some, F.lit(False))).select("doc_id", "n", F.lit(None).cast("long").alias("node"))
    return marked.where("hot IS NOT NULL").select("doc_id", "n", F.col("hot").alias("node")).unionByName(cold.select("doc_id", "n", "node")).unionByName(none)


def link_similar(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of word shingles are alike, as connected by links of at least ``percent`` Jaccard.

    Words are split at ASCII white space after A-Z is lower-cased; a document's set is its distinct shingles of
    ``size`` words, or its whole sequence if shorter. Returns doc_id, n_shingles, component_id (the least doc_id that
    links reach, its own included), one row a document. Texts that are null, empty or without words have no set and
    no links. Rows that share a doc_id count as one document with the greatest of their texts; rows without a doc_id
    come back with their set size and no component. Columns other than doc_id and text are ignored.

    Equal sets are one node. In each shingle's list, every node is first paired with the least one only, a star, so a
    group of k near copies costs k pairs; the pairs left between different components are then all taken, none is
    capped. Shingles that stand out in the sketch come last in prefixes and so have short lists.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lost = docs.where("doc_id IS NULL")
    docs = docs.where("doc_id IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = written(docs.groupBy("doc_id").agg(F.max("text").alias("text")), "docs")
    summary = written(docs.unionByName(lost).mapInArrow(_summaries(size), "doc_id long, n long, s1 long, s2 long, bits array<long>, wide array<long>, counts binary"), "sets")
    excess = _excess(frequencies(summary.where("n < 0").select("counts")))
    members = summary.where("n >= 0").select("doc_id", "n", "s1", "s2")
    bitmaps = summary.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "bits", "wide")
    nodes = written(_speakers(members), "nodes")

    rows = docs.mapInArrow(_prefixes(size, percent, spark.sparkContext.broadcast(excess)), "token long, doc_id long, info int, last int")
    often = rows.groupBy("token").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("token")
    lists = rows.join(often, "token").join(nodes.where("node IS NOT NULL"), "doc_id").groupBy("token", "node").agg(F.min("info").alias("info"), F.min("last").alias("last"), F.min("n").alias("n"))
    lists = written(lists, "lists")
    # A rare shingle that is in no other prefix is in no set whose prefix holds all of its rare ones. The number of
    # these bounds what two nodes can share.
    met_by_others = lists.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("token")
    lists = lists.join(met_by_others, "token")
    lists = lists.select("token", "node", "n", "last", (F.col("info").bitwiseAND(3) + 1).alias("matches"), (F.col("info").bitwiseAND(4) > 0).alias("rare"), (F.col("info").bitwiseAND(8) > 0).alias("whole"), F.shiftright("info", 4).alias("rares"))
    alone = lists.groupBy("node").agg((F.max("rares") - F.count_if("rare")).alias("lone"))
    lists = written(lists.join(alone, "node").select("token", "node", "n", "last", "matches", "whole", "lone"), "lists")

    left_of = lambda n, lone, whole: F.col(n) - F.when(F.col(whole), F.col(lone)).otherwise(0)
    most = F.least("na", "nb", left_of("na", "la", "wb"), left_of("nb", "lb", "wa"))
    fits = most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    pivots = lists.groupBy("token").agg(F.min(F.struct("node", "n", "whole", "lone")).alias("p"))
    stars = lists.join(pivots, "token").where("node != p.node").select(F.col("node").alias("a"), F.col("p.node").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb"), F.col("whole").alias("wa"), F.col("p.whole").alias("wb"), F.col("lone").alias("la"), F.col("p.lone").alias("lb"))
    stars = written(stars.where(fits).select("a", "b").distinct(), "stars")
    links = written(_verified(stars, docs, bitmaps, size, percent).select("a", "b"), "links")
    first = components(links)

    marked = lists.join(first.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    split = marked.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("token")
    marked = written(marked.join(split, "token"), "marked")
    left = marked.select("token", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("whole").alias("wa"), F.col("lone").alias("la"), F.col("matches").alias("ma"), F.col("last").alias("ea"))
    right = marked.select("token", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("whole").alias("wb"), F.col("lone").alias("lb"), F.col("matches").alias("mb"), F.col("last").alias("eb"))
    met = left.join(right, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits)
    # The prefix that ends first in the common order has met all that it shares; the set it leaves over bounds the rest.
    past = lambda n, m: F.greatest(F.ceil(F.col(n) * percent / 100) - F.col(m), F.lit(0))
    open_ = F.when(F.col("ea") < F.col("eb"), past("na", "ma")).when(F.col("eb") < F.col("ea"), past("nb", "mb")).otherwise(F.least("na", "nb"))
    paired = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.min(F.least("ma", "mb")).alias("m"), F.min(open_).alias("open"), F.min(F.col("na") + F.col("nb")).alias("both"))
    rest = paired.where((F.col("k") >= F.col("m")) & ((F.col("k") + F.col("open")) * (100 + percent) >= F.col("both") * percent)).select("a", "b")
    rest = written(rest.join(stars.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, docs, bitmaps, size, percent).select("a", "b")
    final = components(links.unionByName(more))
    out = nodes.join(final, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
