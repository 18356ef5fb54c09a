"""Ranking evaluation over long tables (query, method, item, score) and (query, item, gain)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BY = ["query", "method"]


def ranked(scores: DataFrame) -> DataFrame:
    return scores.withColumn("pos", F.row_number().over(Window.partitionBy(*BY).orderBy(F.desc_nulls_last("score"), "item")))


def ndcg_at_k(scores: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """Linear gain over log2(position + 1), against the best order of all judged items; 0 where that is 0."""
    got = ranked(scores).join(gains, ["query", "item"], "left").where(F.col("pos") <= k)
    dcg = got.groupBy(*BY).agg(F.sum(F.coalesce("gain", F.lit(0.0)) / F.log2(F.col("pos") + 1)).alias("dcg"))
    best = gains.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "item"))).where(F.col("pos") <= k)
    ideal = best.groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("pos") + 1)).alias("ideal"))
    return dcg.join(ideal, "query", "left").select(*BY, F.round(F.coalesce(F.try_divide("dcg", F.nullif("ideal", F.lit(0.0))), F.lit(0.0)), 6).alias("ndcg"))


def mean_gain_at_k(scores: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """Mean gain of the first k; unjudged items are left out."""
    return ranked(scores).where(F.col("pos") <= k).join(gains, ["query", "item"]).groupBy(*BY).agg(F.round(F.avg("gain"), 6).alias("mean_gain"))


def recall_at_k(scores: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """Share of the k best judged items among the first k."""
    best = gains.withColumn("p", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "item"))).where(F.col("p") <= k)
    size = best.groupBy("query").agg(F.count("*").alias("n"))
    met = ranked(scores).where(F.col("pos") <= k).join(best.select("query", "item", F.lit(1).alias("hit")), ["query", "item"], "left").groupBy(*BY).agg(F.sum(F.coalesce("hit", F.lit(0))).alias("met"))
    return met.join(size, "query").select(*BY, F.round(F.col("met") / F.col("n"), 6).alias("recall"))


def spearman(pairs: DataFrame, by: str = "query") -> DataFrame:
    """Rank correlation of a and b (columns item, a, b) on ordinal ranks, ties by item; 0 for fewer than two."""
    ra, rb = (F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), "item")) for c in ("a", "b"))
    sums = pairs.withColumn("d", ra - rb).groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("d2"))
    return sums.select(by, F.round(F.when(F.col("n") < 2, 0.0).otherwise(1 - 6 * F.col("d2") / F.when(F.col("n") < 2, 1).otherwise(F.col("n") * (F.col("n") * F.col("n") - 1))), 6).alias("spearman"))


def separation(scores: DataFrame, k: int = 10) -> DataFrame:
    """Mean of the k best scores less the mean of all."""
    top = F.avg(F.when(F.col("pos") <= k, F.col("score")))
    return ranked(scores).groupBy(*BY).agg(F.round(top, 6).alias("top_mean"), F.round(top - F.avg("score"), 6).alias("separation"))


def judge_ensemble(judgements: DataFrame) -> DataFrame:
    """Mean of the judges that scored a pair."""
    return judgements.groupBy("query", "item").agg(F.round(F.avg("gain"), 6).alias("gain"))


def judge_agreement(judgements: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman over the items that both judges scored."""
    one = lambda j, c: judgements.where(F.col("judge") == j).select("query", "item", F.col("gain").alias(c))
    return spearman(one(a, "a").join(one(b, "b"), ["query", "item"]))


def method_leaderboard(scores: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """Means of NDCG, gain and recall of each method over its queries, the best NDCG first."""
    rows = ndcg_at_k(scores, gains, k).join(mean_gain_at_k(scores, gains, k), BY, "left").join(recall_at_k(scores, gains, k), BY, "left")
    return rows.groupBy("method").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("ndcg", "mean_gain", "recall")]).orderBy(F.desc("ndcg"), "method")


def rank_map(rankings: DataFrame) -> DataFrame:
    """query, item and a map from each method to the item's rank under it; a method that lacks the item lacks the key."""
    return rankings.where("method IS NOT NULL").groupBy("query", "item").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("method", "rank")))).alias("ranks"))


def pipeline_diff(a: DataFrame, b: DataFrame, k: int = 10, fits: DataFrame | None = None) -> DataFrame:
    """Two rankings side by side: which item each has at a rank, how many they share, and each one's mean fit.

    Fits (query, item, fit) are those of an outer judge; an item without one is left out of the mean.
    """
    left, right = (x.where(F.col("rank") <= k).select("query", "rank", F.col("item").alias(c)) for x, c in ((a, "item_a"), (b, "item_b")))
    shared = left.join(right.select("query", F.col("item_b").alias("item_a")), ["query", "item_a"]).groupBy("query").agg(F.count("*").alias("shared"))
    out = left.join(right, ["query", "rank"], "full_outer").join(shared, "query", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    for side, one in () if fits is None else (("a", left), ("b", right)):
        means = one.join(fits.select("query", F.col("item").alias(f"item_{side}"), "fit"), ["query", f"item_{side}"]).groupBy("query").agg(F.round(F.avg("fit"), 4).alias(f"fit_{side}"))
        out = out.join(means, "query", "left")
    return out
