"""The domain's tables, made from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "companies": "SELECT c_custkey AS id, c_mktsegment AS ats, c_name AS slug, c_acctbal >= 0 AS enabled, CAST(c_custkey % 7 AS INT) AS consecutive_errors, CASE WHEN c_custkey % 5 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_error_at FROM {customer}",
    "probes": "SELECT event_id AS id, user_id AS company_id, event_type <> 'error' AS schema_ok, CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 3 = 1 THEN 503 END AS http_status, CASE WHEN event_type = 'error' AND event_id % 3 = 2 THEN 'timeout: read' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'db_write: duplicate key' END AS error, CAST(floor(value * 10) AS INT) AS latency_ms, ts AS created_at, CAST(CAST(ts AS DATE) AS STRING) || '-' || CAST(CAST(floor(hour(ts) / 6.0) AS INT) AS STRING) || '-' || CAST(user_id % 4 AS STRING) AS run_id FROM {events}",
    "runs": "SELECT run_id AS id, substring(run_id, 1, 12) AS cycle_id, CAST(substring(run_id, 14, 1) AS INT) AS shard_index, started_at, CASE WHEN least_id % 13 = 0 THEN NULL ELSE ended_at END AS ended_at, CASE WHEN least_id % 13 = 0 THEN 'running' WHEN least_id % 11 = 0 THEN 'failed' ELSE 'ok' END AS status, companies_probed, companies_ok, companies_error, companies_write_failed, new_jobs, closed_jobs, active_jobs_after FROM (SELECT run_id, min(id) AS least_id, min(created_at) AS started_at, max(created_at) AS ended_at, count(DISTINCT company_id) AS companies_probed, sum(CASE WHEN schema_ok THEN 1 ELSE 0 END) AS companies_ok, sum(CASE WHEN schema_ok THEN 0 ELSE 1 END) AS companies_error, sum(CASE WHEN id % 17 = 0 THEN 1 ELSE 0 END) AS companies_write_failed, sum(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) AS new_jobs, sum(CASE WHEN id % 6 = 0 THEN 1 ELSE 0 END) AS closed_jobs, sum(id % 100) AS active_jobs_after FROM {probes} GROUP BY run_id) r",
    "jobs": "SELECT o_orderkey AS id, o_custkey AS company_id, CAST(o_orderkey AS STRING) AS external_id, o_orderpriority AS title, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS location, o_orderdate AS first_seen_at, o_orderdate + INTERVAL 20 DAY AS last_seen_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS closed_at, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate - INTERVAL 2 DAY END AS source_published_at, md5(lower(o_orderpriority) || '|' || lower(o_orderstatus)) AS fingerprint, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS comp_max, CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' WHEN 2 THEN 'hybrid' END AS remote, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS is_target, CASE o_orderkey % 6 WHEN 0 THEN 'sales' WHEN 1 THEN 'data_ai' WHEN 2 THEN 'software_engineering' END AS job_family, CASE o_orderkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'junior' END AS seniority, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE md5(CAST(o_totalprice AS STRING)) END AS description_hash FROM {orders}",
}
_NEEDS = {"companies": ["customer"], "probes": ["events"], "runs": ["probes"], "jobs": ["orders"]}
EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, or one of the driver's own tables."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SQL[name].replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), **{n: bind(spark, sf_dir, n) for n in _NEEDS[name]})


def with_clause() -> str:
    """The same tables for DuckDB."""
    return "WITH " + ", ".join(f"{name} AS ({sql.format(customer='customer', events='events', orders='orders', probes='probes')})" for name, sql in SQL.items())
