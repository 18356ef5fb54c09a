"""The streaming operators over the driver's tables, each run until all files are read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..streaming import operators as S
from ..streaming.batches import results, start_latest
from .bindings import SQL, bind, with_clause
from .registry import _BLOCK, _PC, _TOP, ORACLES, QUERIES


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. The path is a pattern, as Spark takes a plain one to be a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SQL["probes"], events=table_stream(spark, sf_dir, "events"))


def register(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, shared_path(spark, name))
        ORACLES[name] = f"{with_clause()} {sql}"
        return f

    return add


@register("stream_source_health", f"SELECT ats, date_trunc('day', created_at) AS window_start, count(*) AS probes, count(*) FILTER (WHERE schema_ok) AS ok, count(*) FILTER (WHERE {_BLOCK}) AS blocked, CAST(sum(latency_ms) AS BIGINT) AS latency_sum FROM {_PC} GROUP BY 1, 2")
def _health(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    start_latest(S.stream_source_health(_probes(spark, sf_dir), bind(spark, sf_dir, "companies"), "1 day"), path).awaitTermination()
    return results(spark, path, latest=True).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_RATED = f"SELECT ats, id, created_at, blocks / seen AS rate, CASE WHEN seen < 20 THEN NULL WHEN blocks / seen > 0.05 THEN 'throttle' WHEN blocks / seen < 0.01 THEN 'recover' END AS turn FROM (SELECT ats, id, created_at, sum(CASE WHEN {_BLOCK} THEN 1 ELSE 0 END) OVER w AS blocks, count(*) OVER w AS seen FROM {_PC} WINDOW w AS (PARTITION BY ats ORDER BY created_at, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) q"


@register("stream_rolling_block", f"SELECT ats, id, created_at, round(rate, 4) AS rate, turn FROM (SELECT *, lag(turn, 1, 'recover') OVER (PARTITION BY ats ORDER BY created_at, id) AS last FROM ({_RATED}) r WHERE turn IS NOT NULL) t WHERE turn <> last")
def _rolling(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    sources = bind(spark, sf_dir, "companies").select(F.col("id").alias("company_id"), "ats")
    S.stream_rolling_block(_probes(spark, sf_dir).join(sources, "company_id"), path).awaitTermination()
    return results(spark, path)


@register("stream_archive_dedup", "SELECT company_id, id, content_hash FROM (SELECT *, lag(content_hash) OVER (PARTITION BY company_id ORDER BY created_at, id) AS last FROM (SELECT *, sha256(coalesce(CAST(http_status AS VARCHAR), '')) AS content_hash FROM probes) p) q WHERE last IS DISTINCT FROM content_hash")
def _archive(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    raw = _probes(spark, sf_dir).select("company_id", "id", F.col("created_at").alias("fetched_at"), F.col("http_status").cast("string").alias("body"))
    S.stream_archive_dedup(raw, path).awaitTermination()
    return results(spark, path)


@register("stream_first_seen", "SELECT DISTINCT company_id, run_id AS external_id FROM probes")
def _first(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    listing = _probes(spark, sf_dir).select("company_id", F.col("run_id").alias("external_id"), F.col("created_at").alias("listed_at"))
    first = S.stream_first_seen(listing, "60 days").select("company_id", "external_id")
    first.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{path}/out")


@register("stream_stale_runs", "SELECT run_id, min(created_at) AS started_at, 'failed' AS status FROM probes GROUP BY run_id HAVING NOT bool_or(id % 29 = 0) AND min(created_at) < (SELECT max(created_at) FROM probes) - INTERVAL 45 MINUTE")
def _stale(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    events = _probes(spark, sf_dir).select("run_id", F.col("created_at").alias("at"), (F.col("id") % 29 == 0).alias("ended"))
    S.stream_stale_runs(events, path).awaitTermination()
    return results(spark, path)


#: Runs that list the postings: each leaves out a quarter of the companies and, of the others, a third of the postings.
_RUNS = ["2001-09-01 00:00:00", "2001-09-20 12:00:00", "2001-10-01 00:00:00", "2001-10-01 18:00:00", "2001-10-06 00:00:00"]
_LISTED = "(company_id + {0}) % 4 <> 1 AND (id // 4 + {0} // 2) % 3 <> 0"
_EVENTS = f"""runs_ AS (SELECT unnest(range({len(_RUNS)})) AS r, unnest({_RUNS})::TIMESTAMP AS t),
listed AS (SELECT j.company_id, j.external_id, j.title, r, t, {_LISTED.format("r")} AS l FROM jobs j, runs_),
asked AS (SELECT * FROM listed QUALIFY bool_or(l) OVER (PARTITION BY company_id, r)),
steps AS (SELECT *, min(CASE WHEN l THEN t END) OVER w AS first_seen_at, max(CASE WHEN l THEN t END) OVER w AS last_seen_at, lag(l) OVER (PARTITION BY company_id, external_id ORDER BY r) AS was FROM asked WINDOW w AS (PARTITION BY company_id, external_id ORDER BY r)),
events_ AS (SELECT company_id, external_id, title, first_seen_at, last_seen_at, CASE WHEN NOT l THEN t END AS closed_at, t, CASE WHEN l AND first_seen_at = t THEN 'new' WHEN l AND NOT was THEN 'reopened' WHEN l THEN 'seen' WHEN was THEN 'closed' END AS event FROM steps)"""


def _listings(spark: SparkSession, sf_dir: str, path: str, companies: DataFrame | None = None) -> None:
    """One run after another lists the postings; the stream starts again for each."""
    jobs = bind(spark, sf_dir, "jobs")
    for r, t in enumerate(_RUNS):
        listing = jobs.where(_LISTED.format(r).replace("//", "DIV")).select("company_id", "external_id", "title", F.lit(t).cast("timestamp_ntz").alias("listed_at"))
        listing.write.mode("append").parquet(f"{path}/in")
        S.stream_lifecycle(spark.readStream.schema(listing.schema).parquet(f"{path}/in"), path, companies, buckets=16, most=3).awaitTermination()


def register_run(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, shared_path(spark, name))
        ORACLES[name] = f"{with_clause()}, {_EVENTS} {sql}"
        return f

    return add


@register_run("stream_lifecycle", "SELECT * EXCLUDE (t) FROM events_ WHERE event IS NOT NULL")
def _lifecycle(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    _listings(spark, sf_dir, path)
    return results(spark, path)


@register("stream_incremental_match", f"SELECT query AS campaign, item AS job, similarity AS score, rank FROM ({_TOP}) t")
def _match(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    vectors = bind(spark, sf_dir, "embeddings")
    campaigns = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    postings = table_stream(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    S.stream_incremental_match(postings, campaigns, path, 10).awaitTermination()
    return results(spark, path)


_NEW = ", ".join(f"CAST(count(event) FILTER (WHERE event = 'new' AND t > TIMESTAMP '{_RUNS[-1]}' - INTERVAL {d} DAY) AS BIGINT) AS new_{d}d" for d in (1, 7, 30))


@register_run("totals_snapshot", f"SELECT ats, count(event) FILTER (WHERE event = 'new') AS total, count(event) FILTER (WHERE event IN ('new', 'reopened')) - count(event) FILTER (WHERE event = 'closed') AS active, {_NEW} FROM companies c LEFT JOIN events_ e ON e.company_id = c.id GROUP BY ats")
def _snapshot(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    companies = bind(spark, sf_dir, "companies")
    _listings(spark, sf_dir, path, companies)
    return S.stream_totals(spark, path, companies)
