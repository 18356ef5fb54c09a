"""Text search over an inverted index that is a table: segments of documents with the block maxima of each word.

A row of the index is a segment: some documents, their lengths, and for each word the documents that hold it and how often.
Documents of a segment lie in blocks, alike ones together; for each word and block the highest count and the least length
are kept, which bound what the word can add to a score there, whatever the weights. A search reads the words of its queries
only, and works out those (block, query) pairs whose bound reaches the query's k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from ..sources.shared import shared_path
from .blocks import Best, ids

#: Pairs of a word (in a block or document) and a query that asks for it, and numbers of a block of scores, that are worked out at a time.
BLOCK = 1_000_000
SEGMENT_ROWS, SEGMENT_BYTES, BLOCK_ROWS = 1024, 4 << 20, 64
#: Spark decodes a row group at once, and a row is a whole segment: groups are closed at so many bytes, which is looked at after every row.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1"}
#: Words are runs of a-z, 0-9 and the letters from À to U+024F, in lower case. In UTF-8 these letters are two bytes each,
#: the first from C3 to C9, where C9 goes as far as C9 8F.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


def words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of all texts in order, and the text of each; a null text has none."""
    lowered = [(t or "").lower().encode("utf-8", "surrogatepass") + b" " for t in texts.to_pylist()]
    data = np.frombuffer(b"".join(lowered), np.uint8)
    first = (data >= 0xC3) & (data <= 0xC8)
    first[:-1] |= (data[:-1] == 0xC9) & (data[1:] <= 0x8F)
    word = _ALNUM[data] | first
    word[1:] |= first[:-1]
    edges = np.diff(word, prepend=False, append=False).nonzero()[0]
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[word]))
    until = np.searchsorted(starts, np.cumsum([len(x) for x in lowered]))
    return np.repeat(np.arange(len(lowered)), np.diff(until, prepend=0)), flat.dictionary_encode()


def _segment_schema(item: T.DataType) -> T.StructType:
    whole = ("lengths", "counts", "docs", "tfs", "block_counts", "blocks", "top_tfs", "least_lengths")
    return T.StructType([T.StructField("items", T.ArrayType(item)), T.StructField("terms", T.ArrayType(T.StringType())), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in whole)])


def _segment(items: pa.Array, texts: pa.Array, wanted: pa.Array | None) -> pa.RecordBatch:
    doc, dictionary = words(texts)
    n, names, term = len(items), dictionary.dictionary.cast(pa.string()), dictionary.indices.to_numpy()
    lengths = np.bincount(doc, minlength=n)
    if wanted is not None:
        known = pc.is_in(names, value_set=wanted).to_numpy(zero_copy_only=False)
        keep = known[term]
        doc, term = doc[keep], (np.cumsum(known) - 1)[term[keep]]
        names = names.filter(pa.array(known))
    met, tf = np.unique(doc * max(len(names), 1) + term, return_counts=True)
    doc, term = met // max(len(names), 1), met % max(len(names), 1)
    # documents by their most frequent word, then by length: those of one language and kind get into one block
    by_tf = np.lexsort((term, -tf, doc))
    top, head = np.full(n, -1), by_tf[np.flatnonzero(np.diff(doc, prepend=-1))] if len(doc) else by_tf
    top[doc[head]] = term[head]
    order = np.lexsort((lengths, top))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    docs, lengths = place[doc], lengths[order]
    by_term = np.lexsort((docs, term))
    docs, term, tf = docs[by_term], term[by_term], tf[by_term]
    start = np.flatnonzero(np.diff(term * (n // BLOCK_ROWS + 1) + docs // BLOCK_ROWS, prepend=-1))
    best, least = (np.maximum.reduceat(tf, start), np.minimum.reduceat(lengths[docs], start)) if len(start) else (tf, tf)
    count = lambda x: np.bincount(x, minlength=len(names))
    columns = [lengths, count(term), docs, tf, count(term[start]), docs[start] // BLOCK_ROWS, best, least]
    lists = [pa.array([x], pa.list_(pa.int32())) for x in columns]
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(items.take(pa.array(order))), one(names), *lists], names=["items", "terms", "lengths", "counts", "docs", "tfs", "block_counts", "blocks", "top_tfs", "least_lengths"])


def build_index(docs: DataFrame, path: str, terms: DataFrame | pa.Table | None = None) -> DataFrame:
    """Writes the index of docs (item, text) under path and reads it back; each document is cut into words once.

    With terms (a column ``term``, for a standing set of queries) only these words are indexed; they are broadcast. Lengths
    count all words. Rows without an item are left out, a null text has no words. There is no shuffle, and a segment holds
    ``SEGMENT_ROWS`` documents and ``SEGMENT_BYTES`` of texts at most, or one longer text.
    """
    schema = _segment_schema(docs.schema["item"].dataType)
    wanted = None if terms is None else docs.sparkSession.sparkContext.broadcast(terms.column("term").unique() if isinstance(terms, pa.Table) else terms.select("term").distinct().toArrow().column(0).combine_chunks())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).tolist()
            begin = 0
            for i, s in enumerate(sizes):
                if (size + s > SEGMENT_BYTES or sum(x.num_rows for x in held) + i - begin >= SEGMENT_ROWS) and (held or i > begin):
                    yield segment([*held, batch.slice(begin, i - begin)])
                    held, size, begin = [], 0, i
                size += s
            held.append(batch.slice(begin))
        if held and any(x.num_rows for x in held):
            yield segment(held)

    def segment(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        return _segment(table.column("item").combine_chunks(), table.column("text").combine_chunks(), wanted.value if wanted else None)

    docs.where("item IS NOT NULL").select("item", "text").mapInArrow(cut, schema).write.options(**ROW_GROUPS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def query_terms(queries: DataFrame) -> DataFrame:
    """The different (query, term) of queries (query, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, found = words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(query)), found.cast(pa.string())], names=["query", "term"])

    rows = queries.where("query IS NOT NULL").select("query", "text")
    return rows.mapInArrow(cut, T.StructType([rows.schema["query"], T.StructField("term", T.StringType())])).distinct()


class Asked:
    """A block of queries by word, with the weights of the words."""

    def __init__(self, table: pa.Table):
        self.names, query = np.unique(ids(table.column("query").combine_chunks()), return_inverse=True)
        terms = table.column("term").combine_chunks().dictionary_encode()
        self.terms, term = terms.dictionary, terms.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.query, self.count = query[order].astype(np.int32), np.bincount(term, minlength=len(self.terms))
        self.start = np.cumsum(self.count) - self.count
        self.size = np.bincount(query, minlength=len(self.names))  # words of each query

    def weigh(self, docs: int, words: int, df: np.ndarray, k1: float, b: float) -> None:
        self.idf, self.mean, self.k1, self.b = np.log(1 + (docs - df + 0.5) / (df + 0.5)), words / max(docs, 1) or 1, k1, b
        term = np.repeat(np.arange(len(self.terms)), self.count)
        self.rarest_first = term[np.lexsort((df[term], self.query))].astype(np.int32)  # words of each query, the rarest first
        self.first = np.cumsum(self.size) - self.size
        rarest = self.rarest_first[self.first]
        self.by_rarest = np.argsort(rarest, kind="stable")
        self.rarest_count = np.bincount(rarest, minlength=len(self.terms))
        self.rarest_start = np.cumsum(self.rarest_count) - self.rarest_count

    def part(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry's word the queries that ask for it: entry and query of each pair."""
        n = self.count[term]
        entry = np.repeat(np.arange(len(term)), n)
        return entry, self.query[self.start[term][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)]

    def steps(self, term: np.ndarray) -> Iterator[slice]:
        """Entries, some at a time: ``BLOCK`` pairs, or those of one word."""
        pairs, at = np.concatenate([[0], np.cumsum(self.count[term])]), 0
        while at < len(term):
            to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + BLOCK, "right")) - 1)
            yield slice(at, to)
            at = to

    def sums(self, row: np.ndarray, rows: int, query: np.ndarray, value: np.ndarray | None) -> np.ndarray:
        return np.bincount(row.astype(np.int64) * len(self.names) + query, value, rows * len(self.names)).reshape(rows, len(self.names))


class Segment:
    """The words of a segment that some query asks for."""

    def __init__(self, row: dict, asked: Asked):
        get = lambda c: row[c].to_numpy(zero_copy_only=False)
        place = pc.index_in(row["terms"], value_set=asked.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        term, of_block = np.repeat(place, get("counts")), np.repeat(place, get("block_counts"))
        own, own_block = term >= 0, of_block >= 0
        self.asked, self.items, self.lengths = asked, row["items"], get("lengths")
        by_doc = np.argsort(get("docs")[own], kind="stable")
        self.term, self.doc, self.tf = (x[own][by_doc] for x in (term, get("docs"), get("tfs")))
        self.block_term, self.block, self.top_tf, self.least = (x[own_block] for x in (of_block, get("blocks"), get("top_tfs"), get("least_lengths")))

    def bounds(self, mode: str) -> np.ndarray:
        """What a document of each block can score at most for each query; 0 where none can be an answer."""
        a, n = self.asked, -(-len(self.lengths) // BLOCK_ROWS)
        out, met = np.zeros((n, len(a.names))), np.zeros((n, len(a.names)), np.int64)
        value = a.part(self.block_term, self.top_tf, self.least)
        for some in a.steps(self.block_term):
            entry, query = a.spread(self.block_term[some])
            out += a.sums(self.block[some][entry], n, query, value[some][entry])
            if mode == "all":
                met += a.sums(self.block[some][entry], n, query, None)
        return np.where(met < a.size, 0, out) if mode == "all" else out

    def answers(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All documents that hold all words of a query: document, query and score, some at a time.

        A query's rarest word finds its documents; these are held against its other words, one after another.
        """
        a, width = self.asked, max(len(self.asked.terms), 1)
        key = self.doc.astype(np.int64) * width + self.term
        order = np.argsort(key)
        key, value = key[order], a.part(self.term, self.tf, self.lengths[self.doc])[order]
        doc, term = key // width, key % width
        n = a.rarest_count[term]
        pairs, at = np.concatenate([[0], np.cumsum(n)]), 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(pairs, pairs[at] + BLOCK, "right")) - 1)
            here = np.repeat(np.arange(at, to), n[at:to])
            query = a.by_rarest[a.rarest_start[term[here]] + np.arange(len(here)) - (pairs[here] - pairs[at])]
            own, score, step = doc[here], value[here], 1
            while len(own):
                ended = a.size[query] == step
                if ended.any():
                    yield own[ended], query[ended], score[ended]
                    own, query, score = own[~ended], query[~ended], score[~ended]
                wanted = own * width + a.rarest_first[a.first[query] + step]
                place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                there = key[place] == wanted
                own, query, score, step = own[there], query[there], score[there] + value[place[there]], step + 1
            at = to

    def scores(self, alive: np.ndarray, mode: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Documents and their scores for each query, some documents at a time; NaN where they don't meet or block and query aren't alive."""
        a = self.asked
        keep = alive.any(1)[self.doc // BLOCK_ROWS]
        term, doc, tf = self.term[keep], self.doc[keep], self.tf[keep]
        value, pairs = a.part(term, tf, self.lengths[doc]), np.concatenate([[0], np.cumsum(a.count[term])])
        most, at = max(1, BLOCK // max(len(a.names), 1)), 0
        while at < len(doc):
            last = min(doc[at] + most, doc[min(np.searchsorted(pairs, pairs[at] + BLOCK, "right"), len(doc)) - 1])  # this document is left for later
            to = np.searchsorted(doc, max(last, doc[at] + 1)) if last < doc[-1] or last - doc[at] >= most else len(doc)
            entry, query = a.spread(term[at:to])
            here = doc[at:to] - doc[at]
            rows = int(here[-1]) + 1
            live = alive[doc[at:to][entry] // BLOCK_ROWS, query]
            entry, query = entry[live], query[live]
            out = a.sums(here[entry], rows, query, value[at:to][entry])
            if mode == "all":
                out[a.sums(here[entry], rows, query, None) < a.size] = 0
            yield self.items.slice(int(doc[at]), rows), np.where(out > 0, out, np.nan)
            at = to


def search_index(index: DataFrame, terms: DataFrame | pa.Table, k: int | None, mode: str, k1: float, b: float) -> DataFrame:
    """query, item, score of the k best of a task (all that meet, if k is None) for a block of (query, term)."""
    sc = index.sparkSession.sparkContext
    table = terms if isinstance(terms, pa.Table) else terms.toArrow()
    asked = Asked(table)
    known = sc.broadcast(asked.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total = np.zeros(len(known.value), np.int64), 0, 0
        for batch in batches:
            place = pc.index_in(batch.column("terms").flatten(), value_set=known.value).fill_null(-1).to_numpy(zero_copy_only=False)
            n = batch.column("counts").flatten().to_numpy(zero_copy_only=False)
            df += np.bincount(place[place >= 0], n[place >= 0], len(df)).astype(np.int64)
            lengths = batch.column("lengths").flatten().to_numpy(zero_copy_only=False)
            docs, total = docs + len(lengths), total + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-2, len(df))), pa.array(np.concatenate([[docs, total], df]))], names=["term", "n"])

    n = np.zeros(len(asked.terms) + 2)
    for row in index.select("terms", "counts", "lengths").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[row.term + 2] = row.n
    asked.weigh(n[0], n[1], n[2:], k1, b)
    shared = sc.broadcast(asked)
    schema = T.StructType([T.StructField("query", from_arrow_type(table.schema.field("query").type)), T.StructField("item", index.schema["items"].dataType.elementType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = Best(len(asked.names), k or 1, 6)
        for batch in batches:
            for i in range(batch.num_rows if len(asked.names) else 0):
                segment = Segment({c: batch.column(c)[i].values for c in batch.schema.names}, asked)
                if k is None and mode == "all":
                    for doc, query, score in segment.answers():
                        yield pa.RecordBatch.from_arrays([pa.array(asked.names[query]), segment.items.take(pa.array(doc)), pa.array(score)], names=["query", "item", "score"])
                    continue
                bound = segment.bounds(mode)
                alive = (bound > 0) & ((k is None) | (np.floor((bound + 1e-5) * best.unit) >= best.least))
                for items, scores in segment.scores(alive, mode):
                    if k is not None:
                        best.add(ids(items), scores)
                        continue
                    doc, query = np.nonzero(~np.isnan(scores))
                    yield pa.RecordBatch.from_arrays([pa.array(asked.names[query]), items.take(pa.array(doc)), pa.array(scores[doc, query])], names=["query", "item", "score"])
        out = best.batch(asked.names, ["score"])
        if out is not None:
            yield out

    return index.mapInArrow(run, schema).withColumn("score", F.round("score", 6))


#: Documents of less than so many bytes are dealt out evenly before they are cut: their file may be one piece.
SMALL = 256 << 20


def index_for(docs: DataFrame, terms: DataFrame | pa.Table) -> DataFrame:
    """The index of docs for the words of a stated query set, in the shared folder."""
    spark = docs.sparkSession
    if int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        docs = docs.select("item", "text").repartition(spark.sparkContext.defaultParallelism)
    return build_index(docs, shared_path(spark, "lexical-index"), terms)
