"""Exact vector search, lexical search, fusion and matching."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path
from .blocks import BLOCK, CLUSTERED, Best, ids, meet, unit_vectors
from .filters import location_match
from .lexical import index_for, query_terms, search_index


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), 4)


def _ranked(df: DataFrame, by: str, score: str, k: int, item: str = "item") -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(score), item))
    return df.withColumn("rank", rn).where(F.col("rank") <= k)


#: Queries are a broadcast side, and a task holds the k best of each. More than about so many queries, or rows held by a
#: task, are searched for in blocks, each broadcast by itself; for rows held a block is not made smaller than 1,000 queries.
MOST_QUERIES, MOST_HELD = 10_000, 500_000


def _blocks(queries: DataFrame, k: int | None) -> int:
    """How many blocks the queries of a search for the k best (or for all answers) are put into."""
    return -(-queries.count() // min(MOST_QUERIES, max(1_000, MOST_HELD // max(k or 1, 1))))


def _in_blocks(queries: DataFrame, blocks: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """search(queries), in blocks by a hash of the query, so that a query stays whole."""
    if blocks <= 1:
        return search(queries)
    block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [search(queries.where(block == i)) for i in range(blocks)])


def _schema(queries: DataFrame, items: DataFrame, *scores: str) -> T.StructType:
    return T.StructType([T.StructField("query", queries.schema["query"].dataType), T.StructField("item", items.schema["item"].dataType), *(T.StructField(s, T.DoubleType()) for s in scores)])


def vector_topk_many(items: DataFrame, queries: DataFrame, k: int, newer: tuple[str, str] | None = None) -> DataFrame:
    """query, item, similarity (4 digits), rank: the k nearest items of each query by cosine, exactly.

    Items meet the stated queries in blocks of a matrix product, and each task keeps its k best of a query, so that k rows a
    task and query are shuffled. With many queries a task puts its items into clusters first, and passes over those whose
    centre and radius say that no item of theirs can be among a query's k best. Ties go to the lesser item.
    Vectors that are null, zero, hold a null or have another width than the queries' have no similarity to anything.
    An item or query that comes twice is found twice. With ``newer`` (a time of items, a time of queries) a query meets
    only items of a later time than its own; one without a time meets all. Other columns are ignored.
    """
    return _in_blocks(queries, _blocks(queries, k), lambda block: _topk(items, block, k, newer))


def _topk(items: DataFrame, queries: DataFrame, k: int, newer: tuple[str, str] | None) -> DataFrame:
    never = -(2**63)
    micros = lambda i: F.coalesce(F.unix_micros(F.col(newer[i]).cast("timestamp")), F.lit(never)) if newer else F.lit(never)
    table = queries.where("query IS NOT NULL").select("query", "vector", micros(1).alias("since")).toArrow()
    at, matrix = unit_vectors(table.column("vector"))
    shared = items.sparkSession.sparkContext.broadcast((ids(table.column("query").combine_chunks())[at], matrix, table.column("since").to_numpy()[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, since = shared.value
        best = Best(len(matrix), k, 4)
        rows = max(1, BLOCK // max(len(matrix), 1)) if newer else CLUSTERED
        for batch in batches:
            for begin in range(0, batch.num_rows if len(matrix) else 0, rows):
                part = batch.slice(begin, rows)
                at, vectors = unit_vectors(part.column("vector"), matrix.shape[1])
                if not newer:
                    meet(best, ids(part.column("item"))[at], vectors, matrix)
                    continue
                scores = vectors @ matrix.T
                scores[(part.column("time").to_numpy()[at][:, None] <= since) & (since > never)] = np.nan
                best.add(ids(part.column("item"))[at], scores)
        out = best.batch(names, ["similarity"])
        if out is not None:
            yield out

    found = items.where("item IS NOT NULL").select("item", "vector", micros(0).alias("time")).mapInArrow(run, _schema(queries, items, "similarity"))
    return _ranked(found.withColumn("similarity", F.round("similarity", 4)), "query", "similarity", k)


def vector_topk(items: DataFrame, vector: list[float], k: int) -> DataFrame:
    """item, similarity of the k items nearest to one vector; a zero or null vector is near to nothing."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    return items.withColumn("_q", q).select("item", cosine("vector", "_q").alias("similarity")).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "item").limit(k)


def lexical_search(docs: DataFrame, queries: DataFrame, k: int | None, mode: str = "all", k1: float = 1.2, b: float = 0.75, index: DataFrame | None = None) -> DataFrame:
    """BM25 over (item, text) for (query, text): the k best of each query with rank and score (6 digits).

    mode "all" asks for every query word, "any" for one. Without k every answer is given, with its score and no rank. Texts
    are whole; null ones have no words. Lengths and document frequencies are counted over all documents. Without an index
    (``lexical.build_index``) one of the queries' words is written first; documents are cut into words once. Each task meets
    its segments with the broadcast queries, in blocks of these, passes over what block maxima rule out, and keeps its k
    best of a query, so that a common word meets its queries in no single task. Ties go to the lesser item; a query that
    comes twice counts as one with the words of both.
    """
    blocks = _blocks(queries, k)
    terms = query_terms(queries)
    if blocks <= 1:
        terms = terms.toArrow()  # the words of one block of queries
    else:
        path = shared_path(docs.sparkSession, "query-terms")
        terms.write.parquet(path)
        terms = docs.sparkSession.read.schema(terms.schema).parquet(path)
    known = index_for(docs, terms) if index is None else index
    found = _in_blocks(terms, blocks, lambda block: search_index(known, block, k, mode, k1, b))
    return found if k is None else _ranked(found, "query", "score", k)


def rrf_fuse(rankings: DataFrame, k: int = 60) -> DataFrame:
    """query, item, rrf from any rankings (query, item, rank)."""
    return rankings.groupBy("query", "item").agg(F.round(F.sum(1 / (k + F.col("rank"))), 8).alias("rrf"))


def arm_rank(scored: DataFrame, score: str, pool: int) -> DataFrame:
    """The pool best (query, item, score) of each query in one arm of a search, with their rank in it.

    Ties go to the lesser item, null scores come last. Spark cuts each task's rows to the pool before it shuffles them.
    """
    return _ranked(scored, "query", score, pool)


def _pool(limit: int) -> int:
    """How many of each arm are fused."""
    return min(max(2 * limit, 100), 400)


def hybrid_rrf(dense: DataFrame, lexical: DataFrame, limit: int, k: int = 60) -> DataFrame:
    """Fuses two arms by reciprocal rank, a missing arm counting nothing; both ranks are returned."""
    pool = _pool(limit)
    a = dense.where(F.col("rank") <= pool).select("query", "item", F.col("rank").alias("dense_rank"))
    b = lexical.where(F.col("rank") <= pool).select("query", "item", F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(1 / (k + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query", "item"], "full_outer").withColumn("rrf", F.round(part("dense_rank") + part("lexical_rank"), 8))
    return _ranked(both, "query", "rrf", limit)


def hard_filters(jobs: DataFrame, families: list[str] | None = None, seniority: list[str] | None = None, remote: bool = False, comp_floor: float | None = None, since: str | None = None, target_only: bool = True) -> DataFrame:
    """The hard filters of a search over open postings; a floor on pay leaves out unknown pay, since is strict."""
    rows = jobs.where("closed_at IS NULL")
    if target_only:
        rows = rows.where(~F.col("is_target").eqNullSafe(False))
    if families:
        rows = rows.where(F.col("job_family").isin(families))
    if seniority:
        rows = rows.where(F.col("seniority").isin(seniority))
    if remote:
        rows = rows.where("remote = 'remote'")
    if comp_floor is not None:
        rows = rows.where(F.col("comp_max") >= comp_floor)
    if since:
        rows = rows.where(F.col("first_seen_at") > F.lit(since).cast("timestamp_ntz"))
    return rows


def filtered_search(jobs: DataFrame, queries: DataFrame, k: int, **filters) -> DataFrame:
    """query, item, similarity, rank: the k nearest of the postings (item, vector and filtered columns) that pass.

    Filters go first, so the search is exact however few rows pass.
    """
    return vector_topk_many(hard_filters(jobs, **filters), queries, k)


def hybrid_search(base: DataFrame, queries: DataFrame, limit: int, mode: str = "all", k: int = 60) -> DataFrame:
    """Both arms over one base (item, vector, text; filtered before) for queries (query, vector, text), fused.

    An item or query without a vector is in the lexical arm only, one without a text in the other only.
    """
    pool = _pool(limit)
    return hybrid_rrf(vector_topk_many(base, queries, pool), lexical_search(base, queries, pool, mode), limit, k)


def skill_overlap(query_skills: DataFrame, doc_skills: DataFrame) -> DataFrame:
    """Share of each query's skills that a document lists."""
    size = query_skills.groupBy("query").agg(F.count_distinct("skill").alias("n"))
    return query_skills.distinct().join(doc_skills.distinct(), "skill").groupBy("query", "item").agg(F.count("*").alias("met")).join(size, "query").select("query", "item", F.round(F.col("met") / F.col("n"), 6).alias("overlap"))


def skill_overlap_least(query_skills: DataFrame, doc_skills: DataFrame, least: float) -> DataFrame:
    """``skill_overlap`` of the pairs whose share is ``least`` or more, without meeting all pairs that have a skill in common.

    Queries of equal skills, and documents of equal skills, are one class each; classes meet, and members come last, so that
    what is shuffled grows with the rows and with the pairs of a query and a class, and a pair of members is made where it
    is given. Of n skills, ceil(least * n) must be met, so one of the n - ceil(least * n) + 1 rarest must: only these find
    candidates, a candidate is held against the whole sets at once, and counts by the first of its rare skills alone.
    Skills are counted over all documents, null ones nowhere; pairs without a common skill have no row, whatever ``least`` is.
    """
    whole = lambda rows, key, name: rows.where(f"{key} IS NOT NULL AND skill IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set("skill")).alias(name))
    asked, listed = whole(query_skills, "query", "asked"), whole(doc_skills, "item", "listed")
    kinds = listed.groupBy("listed").agg(F.count("*").alias("n"))
    by_skill = kinds.select("listed", "n", F.explode("listed").alias("skill"))
    rarity = by_skill.groupBy("skill").agg(F.sum("n").alias("df"))
    wanted = asked.select("asked").distinct().select("asked", F.explode("asked").alias("skill"))
    ranked = wanted.join(rarity, "skill", "left").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "skill"))).alias("s"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * F.size("s") - 1e-9)).cast("int")
    own = ranked.select("asked", need.alias("need"), F.slice("s.skill", F.lit(1), F.size("s") - need + 1).alias("rare"))
    found = own.select("*", F.explode("rare").alias("skill")).join(by_skill.select("listed", "skill"), "skill")
    met = F.size(F.array_intersect("asked", "listed"))
    pairs = found.where((met >= F.col("need")) & (F.array_intersect("rare", "listed")[0] == F.col("skill")))
    pairs = pairs.select("asked", "listed", F.round(met / F.size("asked"), 6).alias("overlap"))
    return asked.join(pairs, "asked").select("query", "listed", "overlap").join(listed, "listed").select("query", "item", "overlap")


def minmax_normalize(scores: DataFrame, by: str, score: str) -> DataFrame:
    """``norm``: each score's place between the least and the greatest of its group; 0 where all are equal, null for null."""
    w = Window.partitionBy(by)
    span = F.max(score).over(w) - F.min(score).over(w)
    return scores.withColumn("norm", F.round((F.col(score) - F.min(score).over(w)) / F.when(span == 0, 1.0).otherwise(span), 6))


#: Levels from the lowest to the highest.
LEVELS = ["intern", "junior", "mid", "senior", "staff", "principal", "manager", "director", "exec"]


def seniority_closeness(a: Column, b: Column) -> Column:
    """1 for equal levels, less by an eighth for each level between, 0.5 where one is unknown."""
    at = lambda c: F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.coalesce(c, F.lit(""))), F.lit(0))
    return F.coalesce(1 - F.abs(at(a) - at(b)) / (len(LEVELS) - 1), F.lit(0.5))


def feature_fusion(scored: DataFrame, weights: tuple[float, float, float] = (0.5, 0.4, 0.1)) -> DataFrame:
    """Weighted sum of normalised cosine and skills, and of seniority closeness (columns cos, skills, closeness)."""
    a = minmax_normalize(scored, "query", "cos").withColumnRenamed("norm", "_cos")
    b = minmax_normalize(a, "query", "skills").withColumnRenamed("norm", "_skills")
    return b.select("query", "item", F.round(weights[0] * F.col("_cos") + weights[1] * F.col("_skills") + weights[2] * F.col("closeness"), 8).alias("score"))


def rerank_by_score(pool: DataFrame, scores: DataFrame, top_k: int) -> DataFrame:
    """Reorders a pool by an outer score clamped to 0..100, rows without one last, ties as they were."""
    rows = pool.join(scores.select("query", "item", F.least(F.greatest("score", F.lit(0.0)), F.lit(100.0)).alias("fit")), ["query", "item"], "left")
    rn = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("fit"), "rank"))
    return rows.withColumn("new_rank", rn).where(F.col("new_rank") <= top_k).select("query", "item", "fit", "new_rank")


def pool_union(rankings: DataFrame, k: int) -> DataFrame:
    """The different (query, item) among the first k of any ranking."""
    return rankings.where(F.col("rank") <= k).select("query", "item").distinct()


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Share of k that two rankings have in common, for each query with any."""
    left, right = (x.where(F.col("rank") <= k).select("query", "item") for x in (a, b))
    return left.join(right, ["query", "item"]).groupBy("query").agg((F.count("*") / k).alias("overlap"))


def incremental_match(found: DataFrame, matches: DataFrame) -> DataFrame:
    """Of newly found (campaign, job, score), those not matched before, ranked by score."""
    new = found.join(matches.select("campaign", "job"), ["campaign", "job"], "left_anti")
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("campaign").orderBy(F.desc("score"), "job")))


def campaign_match(campaigns: DataFrame, jobs: DataFrame, matches: DataFrame, k: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """New matches (campaign, job, score, rank) of all active campaigns, and the campaigns with their watermark moved.

    campaigns: campaign, status, last_run_at, vector. jobs: item, vector, first_seen_at and the filtered columns. Jobs
    are open, not known noise, and first seen after the campaign's last run (all, before its first). Each campaign finds
    its k nearest of these; a rank is the place among what it found, and pairs in ``matches`` are not given again.
    One without a vector finds nothing and keeps its watermark, as inactive ones do.
    """
    ready = (F.col("status") == "active") & F.col("vector").isNotNull()
    active = campaigns.where(ready).select(F.col("campaign").alias("query"), "vector", "last_run_at")
    found = vector_topk_many(hard_filters(jobs), active, k, ("first_seen_at", "last_run_at"))
    found = found.select(F.col("query").alias("campaign"), F.col("item").alias("job"), F.col("similarity").alias("score"), "rank")
    moved = campaigns.withColumn("last_run_at", F.when(ready, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_run_at")))
    return found.join(matches.select("campaign", "job"), ["campaign", "job"], "left_anti"), moved


def pointwise_pairs(pool: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query, item, text): query and document text composed for an outer judge."""
    q, d = queries.select("query", F.col("text").alias("qt")), docs.select("item", F.col("text").alias("dt"))
    return pool.join(q, "query").join(d, "item").select("query", "item", F.concat_ws("\n---\n", "qt", "dt").alias("text"))


#: Weights of the labels that count for more or less than others.
FIELD_WEIGHTS = {"required skills": 3.0, "role": 2.0, "preferred skills": 1.5, "team": 1.0, "industry": 1.0, "level": 1.0, "experience": 0.5}


def field_weighted_similarity(items: DataFrame, queries: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """query, item, weighted, plain, rank: means of the cosines of labels that both have, by weight and unweighted.

    Both sides are long tables (item or query, label, vector). Other labels weigh 0.5. Items are gathered by item; the
    stated queries are broadcast in blocks, and the product of each label's vectors, added up by item and by query, adds to the
    sums of all pairs. Each task keeps its k best. A label that comes twice counts twice; unusable vectors count as absent.
    """
    return _in_blocks(queries, _blocks(queries, k), lambda block: _weighted(items, block, k, FIELD_WEIGHTS if weights is None else weights))


def _summed(key: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, the sum of each one's vectors, and how many it has."""
    keys, place = np.unique(key, return_inverse=True)
    total = np.zeros((len(keys), vectors.shape[1]))
    np.add.at(total, place, vectors)
    return keys, total, np.bincount(place, minlength=len(keys)).astype(float)


def label_means(rows: int, item: np.ndarray, label: np.ndarray, vectors: np.ndarray, queries: int, asked: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Means of the cosines of rows of items with all queries, by weight and unweighted; NaN where they have no label in common.

    asked holds for each label ``_summed`` vectors of the queries. Memory is that of some six results, however many labels.
    """
    sums, weight, plain, n = (np.zeros((rows, queries)) for _ in range(4))
    for x, (query, total, times) in asked.items():
        there = label == x
        i, own_total, own_times = _summed(item[there], vectors[there])
        cell = ... if (len(i), len(query)) == (rows, queries) else np.ix_(i, query)
        for value, of_all, weighted in ((own_total @ total.T, plain, sums), (np.outer(own_times, times), n, weight)):
            of_all[cell] += value
            value *= weights.get(x, 0.5)
            weighted[cell] += value
            del value
    with np.errstate(invalid="ignore", divide="ignore"):
        sums /= weight
        plain /= n
    return sums, plain


def _weighted(items: DataFrame, queries: DataFrame, k: int, weights: dict[str, float]) -> DataFrame:
    table = queries.select("query", "label", "vector").where("query IS NOT NULL AND label IS NOT NULL").toArrow()
    at, matrix = unit_vectors(table.column("vector"))
    names, query = np.unique(ids(table.column("query").combine_chunks())[at], return_inverse=True)
    label = ids(table.column("label").combine_chunks())[at]
    asked = {str(x): _summed(query[label == x], matrix[label == x]) for x in np.unique(label)}
    shared = items.sparkSession.sparkContext.broadcast((names, matrix.shape[1], asked))
    fields = items.where("item IS NOT NULL AND label IS NOT NULL").groupBy("item").agg(F.collect_list(F.struct("label", "vector")).alias("fields"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, width, asked = shared.value
        best = Best(len(names), k, 4)
        rows = max(1, BLOCK // max(len(names), 1))
        for batch in batches:
            for begin in range(0, batch.num_rows if len(names) else 0, rows):
                part = batch.slice(begin, rows)
                own = part.column("fields")
                item = np.repeat(np.arange(part.num_rows), own.value_lengths().to_numpy(zero_copy_only=False))
                at, vectors = unit_vectors(own.flatten().field("vector"), width)
                item, label = item[at], ids(own.flatten().field("label"))[at]
                best.add(ids(part.column("item")), *label_means(part.num_rows, item, label, vectors, len(names), asked, weights))
        out = best.batch(names, ["weighted", "plain"])
        if out is not None:
            yield out

    found = fields.mapInArrow(run, _schema(queries, items, "weighted", "plain"))
    return _ranked(found.withColumn("weighted", F.round("weighted", 4)).withColumn("plain", F.round("plain", 4)), "query", "weighted", k)


def location_filtered_match(jobs: DataFrame, vector: list[float], scores: DataFrame, location: str = "", remote: str | None = None, pool: int = 250, keep: int = 40, k: int = 15) -> DataFrame:
    """item, similarity, fit, rank: the nearest jobs, cut by place of work and location, reranked by an outer fit.

    With a filter a pool of 250 is searched, else only the 40 that are kept; a job without a fit comes after all others.
    """
    wanted = remote if remote in ("remote", "hybrid", "onsite") else None
    near = vector_topk(jobs, vector, pool if wanted or location.strip() else keep)
    rows = near.join(jobs.select("item", "location", "remote"), "item")
    rows = location_match(rows if wanted is None else rows.where(F.col("remote") == wanted), "location", location)
    best = rows.orderBy(F.desc("similarity"), "item").limit(keep).join(scores.select("item", F.least(F.greatest("fit", F.lit(0.0)), F.lit(100.0)).alias("fit")), "item", "left")
    order = Window.orderBy(F.desc_nulls_last("fit"), F.desc("similarity"), "item")  # over the 40 kept rows
    return best.select("item", "similarity", "fit", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
