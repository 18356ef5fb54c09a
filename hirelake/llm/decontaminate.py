"""Short test items inside long documents: size-partitioned MinHash containment search, in DataFrame functions alone.

Containment is estimated from the small side: an item's signature is its k shingles of least hash, and the share of
them that a document has among its own shingles estimates the share of the item that the document contains. Items are
partitioned by size; a partition's k follows from its largest size so that a document that contains the item must share
at least ``least`` of the k, so the search loses none. Candidates are then verified by their shingles' strings.

Documents have no signatures of their own: an item of 34 shingles held to 0.8 in a document of 1,250 has a Jaccard
likeness of 0.02, so that 99 of 100 would be found only with over 200 hashes a document, and one would be lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

#: A signature table of up to so many rows (16 bytes each) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column | str) -> Column:
    """Words between ASCII white space, A-Z lower-cased; none for null."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _places(words: Column, width: int) -> Column:
    """0 .. number of shingles - 1; no places where there are fewer words than the width."""
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))


def hashed_shingles(words: Column, width: int) -> Column:
    """words must be a column, not an expression: the lambda would evaluate it again for every place."""
    return F.transform(_places(words, width), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))


def shingles(words: Column, width: int) -> Column:
    return F.array_distinct(F.transform(_places(words, width), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(width)])))


def _needed(n: Column, percent: int) -> Column:
    """The least number of n shingles that is ``percent`` of them."""
    return F.ceil(n * percent / 100).cast("int")


def find_items(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of a document and an item of whose distinct shingles the document holds at least ``percent``.

    Returns doc_id, item_id, n_item, n_shared, containment. Shingles are ``size`` words; an item of fewer words is one
    shingle of as many, looked for at that width. Null, empty and wordless texts are in no pair, nor are rows without
    an id. Rows that repeat a doc_id (or item_id) with one text give the same pair once for each pair of rows; empty tables give no
    rows. Columns other than doc_id, item_id and text are ignored.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = items.where("item_id IS NOT NULL").select("item_id", word_array("text").alias("words")).where(F.size("words") > 0)
    split = written(split.withColumn("width", F.least(F.size("words"), F.lit(size))), "items")
    widths = sorted(r.width for r in split.select("width").distinct().collect())
    out = None
    for width in widths:
        own = split.where(F.col("width") == width)
        hashes = own.select("item_id", F.array_sort(F.array_distinct(hashed_shingles(F.col("words"), width))).alias("h")).withColumn("n", F.size("h"))
        largest = F.pow(F.lit(2), F.floor(F.log2(F.col("n"))) + 1) - 1  # of the item's size partition
        k = F.least(F.col("n"), (largest - _needed(largest, percent) + 1).cast("int"))
        signature = hashes.withColumn("k", k).select("item_id", F.greatest(F.lit(1), F.col("k") - (F.col("n") - _needed(F.col("n"), percent))).alias("least"), F.explode(F.slice("h", 1, F.col("k"))).alias("h"))
        if signature.count() <= BROADCAST_ROWS:
            signature = F.broadcast(signature)
        found = docs.select("doc_id", word_array("text").alias("words")).select("doc_id", F.explode(hashed_shingles(F.col("words"), width)).alias("h")).join(signature, "h")
        hits = found.groupBy("doc_id", "item_id", "least").agg(F.count_distinct("h").alias("k")).where("k >= least").select("doc_id", "item_id")
        hits = written(hits, "hits")
        near = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", word_array("text").alias("words")).select("doc_id", shingles(F.col("words"), width).alias("d"))
        pairs = hits.join(own.select("item_id", shingles(F.col("words"), width).alias("i")), "item_id").join(near, "doc_id")
        pairs = pairs.select("doc_id", "item_id", F.size("i").cast("long").alias("n_item"), F.size(F.array_intersect("i", "d")).cast("long").alias("n_shared"))
        pairs = pairs.where(F.col("n_shared") * 100 >= F.col("n_item") * percent).withColumn("containment", F.col("n_shared") / F.col("n_item"))
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long, containment double")
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
p AS (SELECT ds.doc_id, bs.item_id, count(*) AS n_shared FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM p JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 80
"""
