"""Every registered query over the driver's tables, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import evaluation as E
from ..operators import filters as L
from ..operators import lifecycle as C
from ..operators import retrieval as R
from ..operators import text as T
from ..operators.joins import merge_writer, patch_nonnull
from ..sources.buckets import BucketTable
from ..sources.shared import shared_path
from ..sources.tables import enriched_postings, load_tables, seeds_from_json, seeds_from_sql, snapshot_totals
from .bindings import EVENTS_AS_OF as EV
from .bindings import ORDERS_AS_OF as OR
from .bindings import bind, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None, *tables: str) -> Callable:
    """Registers a function of the named tables under a name, with its SQL over the same tables."""

    def add(f: Callable[..., DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(*[bind(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[name] = f"{with_clause()} {sql}" if not sql.lstrip().startswith("WITH") else with_clause() + ", " + sql.lstrip()[4:]
        return f

    return add


J, P, U, M = "jobs", "probes", "runs", "companies"
_JC = "(SELECT j.*, c.ats, c.slug FROM jobs j JOIN companies c ON c.id = j.company_id)"
_PC = "(SELECT p.*, c.ats, c.slug FROM probes p JOIN companies c ON c.id = p.company_id)"
_BLOCK = "http_status IN (403, 429)"


def _pct(part: str, whole: str, d: int = 2) -> str:
    return f"CAST(round(CAST({part} AS DECIMAL(20,4)) * 100 / nullif({whole}, 0), {d}) AS DOUBLE)"


# --- filters and listings
register("active_postings", f"SELECT id, title, ats, slug FROM {_JC} WHERE closed_at IS NULL", J, M)(lambda j, c: L.active_postings(j, c).select("id", "title", "ats", "slug"))
register("postings_since", f"SELECT id, ats, first_seen_at FROM {_JC} WHERE closed_at IS NULL AND first_seen_at > TIMESTAMP '{OR}' - INTERVAL 30 DAY", J, M)(lambda j, c: L.postings_since(j, c, "30 DAY", OR).select("id", "ats", "first_seen_at"))
register("recent_postings", f"SELECT id, ats, coalesce(source_published_at, first_seen_at) AS posted_at FROM {_JC} WHERE closed_at IS NULL AND is_target IS DISTINCT FROM FALSE ORDER BY posted_at DESC, id LIMIT 100", J, M)(lambda j, c: L.recent_postings(j, c, limit=500).select("id", "ats", "posted_at"))
register("posting_detail", """SELECT id, '{"title":"' || title || '",' || CASE WHEN location IS NULL THEN '' ELSE '"location":"' || location || '",' END || '"company":{"ats":"' || ats || '","slug":"' || slug || '"}}' AS document FROM """ + _JC + " WHERE id = 1", J, M)(lambda j, c: L.posting_detail(j, c, 1))
register("browse_postings", f"SELECT id, title, ats, first_seen_at, (SELECT count(*) FROM {_JC} WHERE title ILIKE '%high%' AND closed_at IS NULL AND comp_max IS NOT NULL) AS total FROM {_JC} WHERE title ILIKE '%high%' AND closed_at IS NULL AND comp_max IS NOT NULL ORDER BY first_seen_at DESC, id LIMIT 50 OFFSET 50", J, M)(lambda j, c: L.browse_postings(j, c, q="high", comp=True, page_number=2))
register("browse_companies", "SELECT id, ats, slug, enabled, consecutive_errors, (SELECT count(*) FROM companies WHERE consecutive_errors > 0) AS total FROM companies WHERE consecutive_errors > 0 ORDER BY consecutive_errors DESC, slug, id LIMIT 50", M)(lambda c: L.browse_companies(c, state="errored"))
for _mode, _where, _order in (("all", "TRUE", "created_at DESC, id"), ("failed", "NOT schema_ok", "created_at DESC, id"), ("blocked", _BLOCK, "created_at DESC, id"), ("slowest", "TRUE", "latency_ms DESC NULLS LAST, id")):
    register(f"browse_probes_{_mode}", f"SELECT id, company_id, http_status, latency_ms, created_at, (SELECT count(*) FROM probes WHERE run_id = '2024-01-17-1-0' AND {_where}) AS total FROM probes WHERE run_id = '2024-01-17-1-0' AND {_where} ORDER BY {_order} LIMIT 5 OFFSET 5", P)(lambda p, m=_mode: L.browse_probes(p, "2024-01-17-1-0", m, page_number=2, size=5))
register("browse_scans", "SELECT id, started_at, status, (SELECT count(*) FROM runs WHERE status = 'ok') AS total FROM runs WHERE status = 'ok' ORDER BY started_at DESC, id LIMIT 30", U)(lambda r: L.browse_scans(r, "ok"))
register("title_search", f"SELECT id, title, slug, first_seen_at FROM {_JC} WHERE closed_at IS NULL AND title ILIKE '%urgent%' ORDER BY first_seen_at DESC, id LIMIT 50", J, M)(lambda j, c: L.title_search(j, c, "urgent"))
register("three_valued_target", "SELECT id, is_target FROM jobs WHERE is_target IS DISTINCT FROM FALSE", J)(lambda j: L.three_valued_target(j).select("id", "is_target"))
register("pending_work", "SELECT id, company_id FROM jobs WHERE closed_at IS NULL AND description_hash IS NULL AND is_target IS DISTINCT FROM FALSE ORDER BY id LIMIT 100", J)(lambda j: L.pending_work(j, "description_hash", 100))
register("failing_companies", "SELECT id, slug, consecutive_errors FROM companies WHERE consecutive_errors >= 3", M)(L.failing_companies)
register("disabled_companies", "SELECT id, slug, last_error_at FROM companies WHERE NOT enabled", M)(L.disabled_companies)
_PLACE = "CASE s_suppkey % 9 WHEN 0 THEN 'Dallas, TX' WHEN 1 THEN 'Remote (US)' WHEN 2 THEN 'campus office' WHEN 3 THEN 'London, Scotland' WHEN 4 THEN 'Berlin' WHEN 5 THEN 'Austin, texas' WHEN 6 THEN 'U.S. remote' WHEN 7 THEN '' END"


def _places(s: DataFrame) -> DataFrame:
    return s.select("s_suppkey", F.expr(_PLACE).alias("place"))


register("location_match", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 9 IN (0, 1, 5, 6)", "supplier")(lambda s: L.location_match(_places(s), "place", "USA").select("s_suppkey"))
register("location_matches", "SELECT unnest(CASE s_suppkey % 9 WHEN 0 THEN ['Texas', 'us', ''] WHEN 1 THEN ['us', ''] WHEN 3 THEN ['UK', ''] WHEN 4 THEN ['berlin', ''] WHEN 5 THEN ['Texas', 'us', ''] WHEN 6 THEN ['us', ''] ELSE [''] END) AS query, s_suppkey FROM supplier", "supplier")(lambda s: L.location_matches(_places(s), "s_suppkey", "place", ["Texas", "us", "UK", "berlin", "(c", ""]))
_POOL = "SELECT ats, slug, id % 13 AS hits, 2015 + id % 9 AS latest_year FROM companies"
register("candidate_backlog", f"SELECT ats, slug, hits, latest_year FROM (SELECT *, row_number() OVER (PARTITION BY ats ORDER BY latest_year DESC, hits DESC, slug) AS rn FROM ({_POOL} WHERE id % 3 <> 0) p) q WHERE rn <= CASE ats WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN 25 ELSE 0 END", M)(lambda c: L.candidate_backlog(_pool(c), c.where("id % 3 = 0"), {"BUILDING": 10, "MACHINERY": 25}).drop("rn"))


def _pool(c: DataFrame) -> DataFrame:
    return c.select("ats", "slug", (F.col("id") % 13).alias("hits"), (F.col("id") % 9 + 2015).alias("latest_year"))


# --- aggregates and windows
_HEALTH = f"""SELECT ats, count(*) AS probes, count(*) FILTER (WHERE schema_ok) AS ok, count(*) FILTER (WHERE {_BLOCK}) AS blocked, count(*) FILTER (WHERE NOT schema_ok AND http_status NOT IN (403, 429)) AS errored,
{_pct(f"count(*) FILTER (WHERE {_BLOCK})", "count(*)")} AS block_pct, {_pct("count(*) FILTER (WHERE schema_ok)", "count(*)")} AS success_pct, round(avg(latency_ms)) AS avg_latency,
round_even(percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms), 0) AS p50_latency, round_even(percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms), 0) AS p95_latency
FROM {_PC} WHERE created_at > TIMESTAMP '{EV}' - INTERVAL 7 DAY GROUP BY ats"""
register("source_health", _HEALTH, P, M)(lambda p, c: A.source_health(p, c, "7 DAY", EV))
register("source_health_spread", _HEALTH, P, M)(lambda p, c: A.source_health_spread(p, c, "7 DAY", EV))
register("company_health", f"SELECT c.id AS company_id, c.slug, count(p.id) AS probes, count(*) FILTER (WHERE schema_ok) AS ok, {_pct('count(*) FILTER (WHERE schema_ok)', 'count(p.id)')} AS success_pct FROM companies c LEFT JOIN (SELECT * FROM probes WHERE created_at > TIMESTAMP '{EV}' - INTERVAL 7 DAY) p ON p.company_id = c.id GROUP BY c.id, c.slug", M, P)(lambda c, p: A.company_health(c, p, EV))
_NEW = ", ".join(f"count(*) FILTER (WHERE first_seen_at > TIMESTAMP '{OR}' - INTERVAL {d} DAY) AS new_{d}d" for d in (1, 7, 30))
_TOTALS = f"SELECT c.ats, count(j.id) AS total, count(j.id) FILTER (WHERE j.closed_at IS NULL) AS active, {_NEW} FROM companies c LEFT JOIN jobs j ON j.company_id = c.id GROUP BY c.ats"
register("totals_by_source", _TOTALS, M, J)(lambda c, j: A.totals_by_source(c, j, OR))
register("totals_rollup", "SELECT c.ats, count(j.id) AS total, count(j.id) FILTER (WHERE j.closed_at IS NULL) AS active, CAST(grouping(c.ats) AS INT) AS is_total FROM companies c LEFT JOIN jobs j ON j.company_id = c.id GROUP BY ROLLUP (c.ats)", M, J)(lambda c, j: A.totals_rollup(c, j, OR))


def _events_as_jobs(p: DataFrame) -> DataFrame:
    return p.select("company_id", F.col("created_at").alias("first_seen_at"))


_CYCLE_NEW = "SELECT w.cycle_id, c.ats, count(*) AS new_jobs FROM (SELECT cycle_id, min(started_at) AS s, max(ended_at) AS e FROM runs WHERE status = 'ok' GROUP BY cycle_id) w JOIN probes p ON p.created_at BETWEEN w.s AND w.e JOIN companies c ON c.id = p.company_id GROUP BY ALL"
register("new_by_cycle_source", _CYCLE_NEW, U, P, M)(lambda r, p, c: A.new_by_cycle_source(r, _events_as_jobs(p), c))
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
register("new_by_cycle_source_pivot", "SELECT cycle_id, " + ", ".join(f"CAST(coalesce(sum(new_jobs) FILTER (WHERE ats = '{s}'), 0) AS BIGINT) AS {s.lower()}" for s in _SEGMENTS) + ", CAST(sum(CASE WHEN ats IN (" + ", ".join(f"'{s}'" for s in _SEGMENTS) + f") THEN new_jobs ELSE 0 END) AS BIGINT) AS total FROM ({_CYCLE_NEW}) n GROUP BY cycle_id", U, P, M)(lambda r, p, c: A.pivot_sources(A.new_by_cycle_source(r, _events_as_jobs(p), c), _SEGMENTS))
_CYCLE = "SELECT cycle_id, arg_min(id, shard_index) AS id, min(started_at) AS started_at, max(ended_at) AS ended_at, CASE WHEN bool_or(status = 'running') THEN 'running' WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'failed' END AS status, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("companies_probed", "companies_ok", "companies_error", "new_jobs", "closed_jobs")) + ", CAST((list(active_jobs_after ORDER BY ended_at DESC NULLS LAST, id DESC))[1] AS BIGINT) AS active_after FROM runs GROUP BY cycle_id"
register("cycle_rollup", _CYCLE, U)(A.cycle_rollup)
_RECENT = f"SELECT cycle_id, status, CAST(floor(epoch(ended_at)) AS BIGINT) - CAST(floor(epoch(started_at)) AS BIGINT) AS duration_s, n AS new_jobs, new_jobs AS new_jobs_reported, closed_jobs, active_before, active_after, CASE WHEN active_before IS NOT NULL THEN greatest(0, active_after - active_before - n + closed_jobs) END AS reopened FROM (SELECT *, CAST(CASE WHEN status = 'ok' THEN (SELECT count(*) FROM probes p WHERE p.created_at BETWEEN r.started_at AND r.ended_at) ELSE new_jobs END AS BIGINT) AS n, CASE WHEN status = 'ok' THEN lag(active_after) OVER w END AS active_before FROM (SELECT * FROM ({_CYCLE}) c ORDER BY started_at DESC, cycle_id DESC LIMIT 30) r WINDOW w AS (PARTITION BY status = 'ok' ORDER BY started_at, cycle_id)) q"
register("recent_cycles", _RECENT, U, P)(lambda r, p: A.recent_cycles(r, _events_as_jobs(p)))
register("active_balance_check", f"SELECT cycle_id, active_after - active_before - new_jobs - reopened + closed_jobs AS residual FROM ({_RECENT}) r WHERE active_before IS NOT NULL AND active_after - active_before - new_jobs - reopened + closed_jobs <> 0", U, P)(lambda r, p: A.active_balance_check(A.recent_cycles(r, _events_as_jobs(p))))
register("scan_rows", "SELECT r.id, r.status, r.shard_index, CAST(CASE WHEN r.status = 'ok' AND r.shard_index = 0 THEN (SELECT count(*) FROM probes p WHERE p.created_at BETWEEN r.started_at AND r.ended_at) ELSE r.new_jobs END AS BIGINT) AS new_jobs, CAST(r.new_jobs AS BIGINT) AS new_jobs_reported FROM runs r", U, P)(lambda r, p: A.scan_rows(r, _events_as_jobs(p)))
register("active_delta", f"SELECT id, CAST(active_jobs_after AS BIGINT) AS active_jobs_after, CAST(previous AS BIGINT) AS previous, CAST(active_jobs_after - previous AS BIGINT) AS delta, {_pct('(active_jobs_after - previous)', 'previous')} AS delta_pct FROM (SELECT *, lag(active_jobs_after) OVER (ORDER BY started_at, id) AS previous FROM (SELECT * FROM runs WHERE status = 'ok' ORDER BY started_at DESC, id DESC LIMIT 3) r) q WHERE previous IS NOT NULL", U)(A.active_delta)
_UNIQUE = f"SELECT company_id, fingerprint, id, first_seen_at, ats FROM (SELECT *, row_number() OVER (PARTITION BY company_id, fingerprint ORDER BY first_seen_at, id) AS rn FROM {_JC} WHERE closed_at IS NULL) q WHERE rn = 1"
register("unique_active", _UNIQUE, J, M)(A.unique_active)
register("unique_since", f"SELECT * FROM ({_UNIQUE}) u WHERE first_seen_at > TIMESTAMP '{OR}' - INTERVAL 90 DAY", J, M)(lambda j, c: A.unique_since(j, c, "90 DAY", OR))
register("duplicate_postings", f"SELECT ats, company_id, fingerprint, count(*) AS copies, string_agg(CAST(id AS VARCHAR), ',' ORDER BY first_seen_at, id) AS ids, min(first_seen_at) AS first_seen, max(first_seen_at) AS last_seen FROM {_JC} WHERE closed_at IS NULL GROUP BY ats, company_id, fingerprint HAVING count(*) > 1", J, M)(A.duplicate_postings)
register("daily_new", f"SELECT CAST(first_seen_at AS DATE) AS day, count(*) AS new_jobs, count(DISTINCT company_id) AS companies FROM jobs WHERE first_seen_at > TIMESTAMP '{OR}' - INTERVAL 60 DAY GROUP BY 1", J)(lambda j: A.daily_new(j, 60, OR))
register("daily_closed", f"SELECT CAST(closed_at AS DATE) AS day, count(*) AS closed_jobs FROM jobs WHERE closed_at > TIMESTAMP '{OR}' - INTERVAL 60 DAY GROUP BY 1", J)(lambda j: A.daily_closed(j, 60, OR))
register("top_employers", f"SELECT slug, ats, count(*) AS open_jobs FROM {_JC} WHERE closed_at IS NULL GROUP BY slug, ats ORDER BY open_jobs DESC, slug LIMIT 20", J, M)(A.top_employers)
register("sla_block", f"SELECT ats, block_pct, CASE WHEN block_pct >= 5 THEN 'RED' WHEN block_pct >= 1 THEN 'AMBER' ELSE 'GREEN' END AS state FROM ({_HEALTH}) h", P, M)(lambda p, c: A.sla_block(A.source_health(p, c, "7 DAY", EV)))
register("sla_volume", f"SELECT count(*) AS unique_active, CASE WHEN count(*) >= 50000 THEN 'GREEN' WHEN count(*) >= 40000 THEN 'AMBER' ELSE 'RED' END AS state FROM ({_UNIQUE}) u", J, M)(lambda j, c: A.sla_volume(A.unique_active(j, c)))
register("sla_freshness", f"SELECT ats, minutes, CASE WHEN minutes > 360 THEN 'RED' WHEN minutes > 240 THEN 'AMBER' ELSE 'GREEN' END AS state FROM (SELECT ats, CAST(floor((epoch(TIMESTAMP '{EV}') - floor(epoch(max(created_at)))) / 60) AS BIGINT) AS minutes FROM {_PC} WHERE schema_ok GROUP BY ats) f", P, M)(lambda p, c: A.sla_freshness(p, c, EV))
register("sla_summary", f"SELECT *, worst_block_pct < 1 AS block_ok, active >= 50000 AS volume_ok FROM (SELECT max(block_pct) AS worst_block_pct FROM ({_HEALTH}) h) a, (SELECT count(*) AS active FROM jobs WHERE closed_at IS NULL) b, (SELECT max(ended_at) AS last_ok_run FROM runs WHERE status = 'ok') c", P, M, J, U)(lambda p, c, j, r: A.sla_summary(A.source_health(p, c, "7 DAY", EV), j, r))
register("headline_counts", f"SELECT count(*) FILTER (WHERE closed_at IS NULL) AS open_jobs, count(*) FILTER (WHERE first_seen_at > TIMESTAMP '{OR}' - INTERVAL 1 DAY) AS new_24h, (SELECT max(ended_at) FROM runs WHERE status = 'ok') AS last_ok_run FROM jobs", J, U)(lambda j, r: A.headline_counts(j, r, OR))
register("write_failure_rate", f"SELECT id, {_pct('companies_write_failed', 'companies_probed')} AS fail_pct, companies_write_failed > 25 AND companies_write_failed > companies_probed * 0.05 AS alarm FROM runs WHERE started_at > TIMESTAMP '{EV}' - INTERVAL 14 DAY", U)(lambda r: A.write_failure_rate(r, "14 DAY", EV))
register("zombie_open", f"SELECT slug, count(*) AS zombies FROM (SELECT j.*, c.slug, c.enabled FROM jobs j JOIN companies c ON c.id = j.company_id) x WHERE closed_at IS NULL AND enabled AND last_seen_at < (SELECT max(started_at) FROM runs WHERE status = 'ok') - INTERVAL 12 HOUR GROUP BY slug", J, M, U)(A.zombie_open)
register("error_breakdown", "SELECT substring(split_part(coalesce(error, 'HTTP ' || http_status, 'unknown'), ':', 1), 1, 60) AS error, count(*) AS n FROM probes WHERE NOT schema_ok GROUP BY 1 ORDER BY n DESC, error LIMIT 12", P)(A.error_breakdown)
register("error_signature_counts", "SELECT run_id, count(*) AS n FROM probes WHERE error LIKE 'db_write:%' GROUP BY run_id", P)(A.error_signature_counts)
register("metric_series", "SELECT id, CAST(value AS BIGINT) AS value, CAST(value - lag(value) OVER (ORDER BY started_at, id) AS BIGINT) AS delta, CAST(min(value) OVER () AS BIGINT) AS least, CAST(max(value) OVER () AS BIGINT) AS greatest, round(avg(value) OVER (), 4) AS mean FROM (SELECT id, started_at, active_jobs_after AS value FROM runs WHERE status = 'ok' ORDER BY started_at DESC, id DESC LIMIT 40) r", U)(lambda r: A.metric_series(r, "active_jobs_after", 40))
register("source_outcomes", f"SELECT ats, count(*) FILTER (WHERE http_status BETWEEN 200 AND 299) AS oks, count(*) FILTER (WHERE {_BLOCK}) AS blocks, count(*) FILTER (WHERE http_status IS NULL OR NOT (http_status BETWEEN 200 AND 299 OR {_BLOCK})) AS errors, {_pct(f'count(*) FILTER (WHERE {_BLOCK})', 'count(*)')} AS block_pct FROM {_PC} GROUP BY ats", P, M)(A.source_outcomes)
register("probe_retention", f"SELECT CAST(created_at AS DATE) AS day, ats, count(*) AS probes, count(*) FILTER (WHERE schema_ok) AS ok FROM {_PC} WHERE created_at <= TIMESTAMP '{EV}' - INTERVAL 14 DAY GROUP BY ALL", P, M)(lambda p, c: A.probe_retention(p, c, 14, EV))
register("rolling_block_rate", f"SELECT ats, id, round(blocks / seen, 4) AS rate, CASE WHEN seen < 20 THEN NULL WHEN blocks / seen > 0.05 THEN 'throttle' WHEN blocks / seen < 0.01 THEN 'recover' END AS flag FROM (SELECT ats, id, sum(CASE WHEN {_BLOCK} THEN 1 ELSE 0 END) OVER w AS blocks, count(*) OVER w AS seen FROM {_PC} WINDOW w AS (PARTITION BY ats ORDER BY created_at, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) q", P, M)(A.rolling_block_rate)
register("slug_merge", f"SELECT ats, slug, CAST(sum(hits) AS BIGINT) AS hits, max(latest_year) AS latest_year FROM ({_POOL} UNION ALL {_POOL} WHERE id % 2 = 0) p GROUP BY ats, slug", M)(lambda c: A.slug_merge(_pool(c), _pool(c.where("id % 2 = 0"))))
register("slug_counts", f"SELECT ats, substring(slug, 1, 12) AS slug, CAST(sum(hits) AS BIGINT) AS hits, max(latest_year) AS latest_year FROM ({_POOL}) p GROUP BY ALL", M)(lambda c: A.slug_counts(_pool(c).withColumn("slug", F.substring("slug", 1, 12))))
register("proportional_allocate", "WITH s AS (SELECT ats, count(*) AS size FROM companies GROUP BY ats), b AS (SELECT *, least(size, CAST(floor(200 * size / sum(size) OVER ()) AS BIGINT)) AS quota FROM s), x AS (SELECT ats, row_number() OVER (ORDER BY r, ats) AS rn FROM (SELECT ats, unnest(range(1, CAST(least(size - quota, 200) AS BIGINT) + 1)) AS r FROM b) z), q AS (SELECT b.ats, quota + (SELECT count(*) FROM x WHERE x.ats = b.ats AND rn <= (SELECT least(200, sum(size)) - sum(quota) FROM b)) AS quota FROM b) SELECT id, ats FROM (SELECT *, row_number() OVER (PARTITION BY ats ORDER BY id) AS rn FROM companies) c JOIN q USING (ats) WHERE rn <= quota", M)(lambda c: A.proportional_allocate(c.select("id", "ats"), "ats", 200, ["id"]).select("id", "ats"))
register("class_coverage", "SELECT job_family, is_target, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM jobs GROUP BY job_family, is_target", J)(A.class_coverage)
register("interval_join", "SELECT r.id AS run, p.id FROM runs r JOIN probes p ON p.created_at BETWEEN r.started_at AND r.ended_at WHERE r.shard_index = 1", U, P)(lambda r, p: A.interval_join(p.select("id", "created_at"), r.where("shard_index = 1").select(F.col("id").alias("run"), "started_at", "ended_at"), "created_at", "started_at", "ended_at").select("run", "id"))

# --- life cycle: the batch is every third posting with a new title, and a few new ones
_LISTING = "SELECT company_id, external_id, 'T ' || title AS title FROM jobs WHERE id % 3 = 0 UNION ALL SELECT company_id, 'n' || external_id, title FROM jobs WHERE id % 50 = 1"


def _listing(j: DataFrame) -> DataFrame:
    seen = j.where("id % 3 = 0").select("company_id", "external_id", F.concat(F.lit("T "), F.col("title")).alias("title"))
    return seen.unionByName(j.where("id % 50 = 1").select("company_id", F.concat(F.lit("n"), F.col("external_id")).alias("external_id"), "title"))


_MERGED = f"SELECT j.* REPLACE (coalesce(l.company_id, j.company_id) AS company_id, coalesce(l.external_id, j.external_id) AS external_id, coalesce(l.title, j.title) AS title, coalesce(j.first_seen_at, TIMESTAMP '{OR}') AS first_seen_at, CASE WHEN l.title IS NOT NULL THEN TIMESTAMP '{OR}' ELSE j.last_seen_at END AS last_seen_at, CASE WHEN l.title IS NULL THEN j.closed_at END AS closed_at) FROM jobs j FULL JOIN ({_LISTING}) l ON l.company_id = j.company_id AND l.external_id = j.external_id"
_CLOSED = f"SELECT m.* REPLACE (CASE WHEN m.company_id % 2 = 0 AND closed_at IS NULL AND last_seen_at < TIMESTAMP '{OR}' THEN TIMESTAMP '{OR}' ELSE closed_at END AS closed_at) FROM ({_MERGED}) m"
_EVENTS = f"SELECT a.company_id, a.external_id, CASE WHEN j.id IS NULL THEN 'new' WHEN j.closed_at IS NOT NULL AND a.closed_at IS NULL THEN 'reopened' WHEN j.closed_at IS NULL AND a.closed_at IS NOT NULL THEN 'closed' WHEN a.last_seen_at = TIMESTAMP '{OR}' THEN 'seen' ELSE 'untouched' END AS event FROM ({_CLOSED}) a LEFT JOIN jobs j ON j.company_id = a.company_id AND j.external_id = a.external_id"


def _merged(j: DataFrame) -> DataFrame:
    return C.lifecycle_merge(j, _listing(j), OR)


def _closed(j: DataFrame) -> DataFrame:
    return C.close_unseen(_merged(j), j.where("company_id % 2 = 0").select("company_id"), OR)


register("lifecycle_merge", _MERGED, J)(_merged)
register("close_unseen", _CLOSED, J)(_closed)
register("lifecycle_events", _EVENTS, J)(lambda j: C.lifecycle_events(j, _closed(j), OR))
register("event_totals", f"SELECT event, count(*) AS n FROM ({_EVENTS}) e GROUP BY event", J)(lambda j: C.event_totals(C.lifecycle_events(j, _closed(j), OR)))
_OUTCOMES = "SELECT run_id, count(*) AS probed, count(*) FILTER (WHERE schema_ok AND NOT w) AS ok, count(*) FILTER (WHERE NOT schema_ok AND NOT w) AS error, count(*) FILTER (WHERE w) AS write_failed FROM (SELECT *, coalesce(error LIKE 'db_write:%', FALSE) AS w, row_number() OVER (PARTITION BY run_id, company_id ORDER BY created_at DESC, id DESC) AS rn FROM probes) p WHERE rn = 1 GROUP BY run_id"
register("run_outcomes", _OUTCOMES, P)(C.run_outcomes)
#: Each company's events belong to the run that probed it last.
_RUN_EVENTS = f"SELECT r.run_id, event FROM ({_EVENTS}) e JOIN (SELECT company_id, arg_max(run_id, (created_at, id)) AS run_id FROM probes GROUP BY company_id) r ON r.company_id = e.company_id"


def _run_totals(j: DataFrame, p: DataFrame) -> DataFrame:
    run = p.groupBy("company_id").agg(F.max_by("run_id", F.struct("created_at", "id")).alias("run_id"))
    return C.run_totals(C.run_outcomes(p), C.lifecycle_events(j, _closed(j), OR).join(run, "company_id"))


register("run_totals", f"SELECT run_id, probed, ok, error, write_failed, coalesce(new_jobs, 0) AS new_jobs, coalesce(closed_jobs, 0) AS closed_jobs FROM ({_OUTCOMES}) o LEFT JOIN (SELECT run_id, count(*) FILTER (WHERE event IN ('new', 'reopened')) AS new_jobs, count(*) FILTER (WHERE event = 'closed') AS closed_jobs FROM ({_RUN_EVENTS}) x GROUP BY run_id) e USING (run_id)", J, P)(_run_totals)
register("changed_descriptions", "SELECT company_id, external_id, h AS description_hash FROM (SELECT *, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 2 = 0 THEN md5(title) ELSE description_hash END AS h FROM jobs) l WHERE h IS NOT NULL AND h IS DISTINCT FROM description_hash", J)(lambda j: C.changed_descriptions(j, j.withColumn("description_hash", F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 2 == 0, F.md5("title")).otherwise(F.col("description_hash")))))
register("invalidate_derived", "SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE job_family END AS job_family FROM jobs", J)(lambda j: C.invalidate_derived(j, j.withColumn("description_hash", F.when(F.col("id") % 2 == 0, F.concat(F.lit("x"), F.col("external_id"))).otherwise(F.col("description_hash"))), ["job_family"]).select("id", "job_family"))
register("source_state_update", "SELECT c.id, c.slug, CAST(CASE WHEN good IS NULL THEN consecutive_errors WHEN good THEN 0 ELSE consecutive_errors + 1 END AS INT) AS consecutive_errors, enabled AND NOT coalesce(NOT good AND consecutive_errors + 1 >= 5, FALSE) AS enabled, CASE WHEN NOT good THEN coalesce(error, 'HTTP ' || http_status, 'unknown') END AS last_error, CASE WHEN NOT good THEN created_at ELSE last_error_at END AS last_error_at, CASE WHEN good THEN created_at END AS last_success_at FROM companies c LEFT JOIN (SELECT *, schema_ok AS good, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, id DESC) AS rn FROM probes) p ON p.company_id = c.id AND rn = 1", M, P)(C.source_state_update)
register("reap_stale_runs", f"SELECT id, started_at, CASE WHEN status = 'running' AND started_at < TIMESTAMP '{EV}' - INTERVAL 45 MINUTE THEN 'failed' ELSE status END AS status FROM runs", U)(lambda r: C.reap_stale_runs(r, EV))
register("constraint_check", "SELECT 'companies_key' AS rule, (SELECT count(*) FROM (SELECT 1 FROM companies GROUP BY ats, slug HAVING count(*) > 1) a) AS violations UNION ALL SELECT 'jobs_key', (SELECT count(*) FROM (SELECT 1 FROM jobs GROUP BY company_id, external_id HAVING count(*) > 1) a) UNION ALL SELECT 'jobs_company', (SELECT count(*) FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM companies c WHERE c.id = j.company_id)) UNION ALL SELECT 'jobs_title', (SELECT count(*) FROM jobs WHERE title IS NULL) UNION ALL SELECT 'jobs_remote', (SELECT count(*) FROM jobs WHERE NOT remote IN ('remote', 'onsite', 'hybrid'))", M, J)(C.constraint_check)
# Payloads: a JSON whose keys come in either order, by the page's id; every fifth is markup. The archive has those of even ids
# of pages; the batch brings every third one.
_SAID = "CASE WHEN page_id % 5 = 0 THEN html ELSE '{\"a\":' || page_id % 7 || ',\"b\":\"x\"}' END"
_A0 = f"SELECT page_id % 100 AS company_id, sha256({_SAID}) AS content_hash, TIMESTAMP '2024-01-22 00:00:00' AS created_at, TIMESTAMP '2024-01-22 00:00:00' AS last_seen_at FROM pages WHERE page_id % 2 = 0 GROUP BY ALL"
_B0 = f"SELECT DISTINCT page_id % 100 AS company_id, sha256({_SAID}) AS content_hash FROM pages WHERE page_id % 3 = 0"
_A1 = f"SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.content_hash, b.content_hash) AS content_hash, coalesce(a.created_at, TIMESTAMP '{EV}') AS created_at, CASE WHEN b.content_hash IS NOT NULL THEN TIMESTAMP '{EV}' ELSE a.last_seen_at END AS last_seen_at FROM ({_A0}) a FULL JOIN (SELECT * FROM ({_B0}) b WHERE (company_id, content_hash) NOT IN (SELECT (company_id, max(content_hash)) FROM ({_A0}) x GROUP BY company_id)) b ON a.company_id = b.company_id AND a.content_hash = b.content_hash"


def _archive(p: DataFrame) -> DataFrame:
    said = F.expr("CASE WHEN page_id % 5 = 0 THEN html WHEN page_id % 2 = 0 THEN '{\"a\": ' || page_id % 7 || ', \"b\": \"x\"}' ELSE '{\"b\":\"x\",\"a\":' || page_id % 7 || '}' END")
    rows = p.select((F.col("page_id") % 100).alias("company_id"), said.alias("body"), "page_id")
    empty = rows.where("false").select("company_id", F.lit("").alias("content_hash"), "body", L.instant(EV).alias("created_at"), L.instant(EV).alias("last_seen_at"))
    first = C.raw_archive_ingest(empty, rows.where("page_id % 2 = 0"), "2024-01-22 00:00:00")
    return C.raw_archive_ingest(first, rows.where("page_id % 3 = 0"), EV)


register("raw_archive_ingest", _A1, "pages")(lambda p: _archive(p).drop("body"))
register("archive_replay", f"SELECT company_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY created_at DESC, content_hash DESC) AS rn FROM ({_A1}) a WHERE created_at <= TIMESTAMP '{EV}') q WHERE rn = 1", "pages")(lambda p: C.archive_replay(_archive(p), EV).select("company_id", "content_hash"))
register("load_source_list", "SELECT coalesce(c.ats, s.ats) AS ats, coalesce(c.slug, s.slug) AS slug, coalesce(enabled, TRUE) AS enabled FROM companies c FULL JOIN (SELECT DISTINCT ats, CASE WHEN id % 3 = 0 THEN slug ELSE slug || '-x' END AS slug FROM companies WHERE id % 2 = 0) s ON s.ats = c.ats AND s.slug = c.slug", M)(lambda c: C.load_source_list(c, c.where("id % 2 = 0").select("ats", F.when(F.col("id") % 3 == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-x"))).alias("slug"))))
_TUPLE = "'VALUES (''' || ats || ''', ''' || slug || ''', ''https://c/' || id || ''', ''https://p/' || id || ''')'"
register("seeds_from_sql", "SELECT ats, slug, 'https://c/' || id AS careers_url, 'https://p/' || id AS probe_url FROM companies", M)(lambda c: seeds_from_sql(c.select(F.expr(_TUPLE).alias("value"))))
register("seeds_from_json", "SELECT ats, slug, CAST(NULL AS VARCHAR) AS careers_url, CASE WHEN k = 1 THEN 'https://p/' || id END AS probe_url FROM companies, (SELECT unnest([1, 2]) AS k) t WHERE k = 1 OR id % 2 = 0", M)(lambda c: seeds_from_json(c.select(F.expr("""'[{"ats":"' || ats || '","slug":"' || slug || '","probe_url":"https://p/' || id || '"}' || CASE WHEN id % 2 = 0 THEN ',{"slug":"' || slug || '","ats":"' || ats || '"}' ELSE ',{"slug":"none"}' END || ']'""").alias("value"))))
register("merge_writer", "SELECT j.id, CASE WHEN j.id % 2 = 0 THEN 'merged' ELSE j.title END AS title, j.location FROM jobs j", J)(lambda j: merge_writer(j.select("id", "title", "location"), j.where("id % 2 = 0").select("id", F.lit("merged").alias("title")), ["id"], ["title"]))
register("patch_nonnull", "SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN job_family END, title) AS title FROM jobs", J)(lambda j: patch_nonnull(j.select("id", "title"), j.where("id % 2 = 0").select("id", F.col("job_family").alias("title")), ["id"]))
_CAND = "SELECT id AS company_id, lower(slug) || CASE WHEN k = 2 THEN CAST(id % 40 AS VARCHAR) ELSE '' END AS slug, k AS kind FROM companies, (SELECT unnest([1, 2, 3]) AS k) ks WHERE k > 1 OR id % 10 = 0"
register("pointer_recovery", f"SELECT company_id, slug, kind FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY kind, company_id) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY kind, slug) AS r1 FROM ({_CAND}) c WHERE slug NOT IN (SELECT lower(slug) FROM companies WHERE id % 20 = 0)) a WHERE r1 = 1) b WHERE r2 = 1", M)(lambda c: C.pointer_recovery(_candidates(c), c.where("id % 20 = 0").select(F.lower("slug").alias("slug"))))


def _candidates(c: DataFrame) -> DataFrame:
    k = c.select("id", "slug", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("kind")).where("kind > 1 OR id % 10 = 0")
    return k.select(F.col("id").alias("company_id"), F.concat(F.lower("slug"), F.when(F.col("kind") == 2, (F.col("id") % 40).cast("string")).otherwise("")).alias("slug"), "kind")


# --- text jobs
register("dedup_keys", r"SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(lang, '')), '[ \t\n]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(coalesce(source, '')), '[ \t\n]+', ' ', 'g'))) AS role_key, CASE WHEN text <> '' THEN md5(text) END AS content_key FROM documents", "documents")(lambda d: T.dedup_keys(d.select("doc_id", F.col("lang").alias("title"), F.col("source").alias("location"), "text")).select("doc_id", "role_key", "content_key"))
register("shard_assign", "SELECT id, CAST(CAST('0x' || substring(md5(CAST(id AS VARCHAR)), 1, 4) AS INT) % 60 AS INT) AS shard FROM companies", M)(lambda c: T.shard_assign(c).select("id", "shard"))
register("shard_ranges", "SELECT c.id, r.i AS owner FROM (SELECT id, CAST('0x' || substring(md5(CAST(id AS VARCHAR)), 1, 4) AS INT) % 60 AS shard FROM companies) c JOIN (SELECT CAST(i AS INT) AS i, i * 60 // 7 AS b, (i + 1) * 60 // 7 AS e FROM range(7) t(i)) r ON shard >= b AND shard < e", M)(lambda c: T.shard_ranges(c, 7).select("id", "owner"))


def _clean_sql() -> str:
    """Written out by itself, so that it can tell a missing entity or rule."""
    named = "&lt;|< &gt;|> &quot;|\" &apos;|'' &mdash;|— &ndash;|– &hellip;|… &rsquo;|’ &lsquo;|‘ &rdquo;|” &ldquo;|“ &trade;|™ &copy;|© &reg;|®".split()
    decode = lambda x: "replace(" * (len(named) + 2) + x + "".join(f", '{e.split('|')[0]}', '{e.split('|')[1]}')" for e in named) + ", '&nbsp;', ' '), '&amp;', '&')"
    out = decode("html")
    for pattern, put in [("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), (r"(?i)<\s*br\s*/?\s*>", "\n"), (r"(?i)</\s*(p|div|li|h1|h2|h3|h4|h5|h6|tr|td|th|section|article)\s*>", "\n"), ("<[^>]+>", "")]:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    out = decode(out)
    for pattern, put in [("&#x[0-9a-fA-F]+;", " "), ("&#[0-9]+;", " "), (r"(?i)\[image:[^\]]*\]", " "), (r"\[https?://[^\]]+\]", " "), (r"\x{00A0}", " "), (r"\r\n?", "\n"), ("[ \t]+", " "), (" ?\n ?", "\n"), ("\n{3,}", "\n\n"), (r"^[ \t\n\r]+|[ \t\n\r]+$", "")]:
        out = f"regexp_replace({out}, '{pattern}', '{put}', 'g')"
    return out


_MARKUP = """CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN '&lt;p&gt;see [https://h/x.png] now [IMAGE: y]&lt;/p&gt;it&#39;s&mdash;<b>x</b>y' || html WHEN 2 THEN html || 'a<br/>b< BR >c&nbsp;&amp;lt;i&amp;gt;d' END"""
register("clean_corpus", f"SELECT page_id, clean, CAST(length(html) AS INT) AS before, CAST(length(clean) AS INT) AS after FROM (SELECT page_id, html, {_clean_sql()} AS clean FROM (SELECT page_id, {_MARKUP} AS html FROM pages) m) p", "pages")(lambda p: T.clean_corpus(p.select("page_id", F.expr(_MARKUP).alias("html"))).select("page_id", "clean", "before", "after"))
register("host_mentions", r"SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS slug, count(*) AS hits FROM pages WHERE regexp_extract(url, '^https?://([^/?#:]+)', 1) <> '' GROUP BY 1", "pages")(T.host_mentions)
_MENTION = "'at https://Jobs.Lever.co/Acme-' || id % 50 || '/x, boards.greenhouse.io/embed/job, job-boards.greenhouse.io/g' || id % 20 || '?a=1 and jobs.ashbyhq.com/q'"
register("slug_mentions", "SELECT ats, slug, count(*) AS hits FROM (SELECT 'lever' AS ats, 'acme-' || id % 50 AS slug FROM companies UNION ALL SELECT 'greenhouse', 'g' || id % 20 FROM companies) m GROUP BY ats, slug", M)(lambda c: T.slug_mentions(c.select(F.expr(_MENTION).alias("said")), "said"))
_OLD = "CASE id % 3 WHEN 0 THEN 'acme' || id || '-hq' WHEN 1 THEN 'acme' || id WHEN 2 THEN 'a-b' || id END"
register("slug_variants", f"SELECT company_id, CAST(place AS INT) AS place, variant FROM (SELECT id AS company_id, unnest(v) AS variant, generate_subscripts(v, 1) - 1 AS place FROM (SELECT id, list_transform(['labs', 'hq', 'careers', 'jobs', 'inc', 'hr', 'global', 'ai', 'io'], lambda x: s || '-' || x) || CASE id % 3 WHEN 0 THEN ['acme' || id, 'acme' || id || 'hq'] WHEN 1 THEN [] ELSE ['ab' || id] END AS v FROM (SELECT id, {_OLD} AS s FROM companies) a) b) c", M)(lambda c: T.slug_variants(c.select(F.col("id").alias("company_id"), F.expr(_OLD).alias("slug"))))
_POSTED = "SELECT id, CASE id % 4 WHEN 0 THEN 'Sr. Engineer' WHEN 1 THEN 'Staff Director' WHEN 2 THEN 'Analyst' END AS title, remote, location, CASE WHEN id % 2 = 0 THEN comp_max - 900 END AS comp_min, comp_max, CASE id % 3 WHEN 1 THEN 'EUR' WHEN 2 THEN 'CHF' END AS comp_currency, CASE WHEN id % 5 = 0 THEN 'year' END AS comp_interval, CASE WHEN id % 7 = 0 THEN 'ask us' END AS comp_text, CASE WHEN id % 6 = 0 THEN 'Sales' END AS department, CASE WHEN id % 10 = 3 THEN 'a summary' END AS description_summary, CASE id % 5 WHEN 3 THEN repeat('word ', 400) WHEN 2 THEN 'short' END AS description FROM jobs"
_K = lambda n: f"CASE WHEN {n} >= 1000 THEN CAST(CAST(round({n} / 1000, 0) AS BIGINT) AS VARCHAR) || 'K' ELSE CAST(CAST(round({n}, 0) AS BIGINT) AS VARCHAR) END"
_PAYS = f"CASE WHEN comp_max IS NOT NULL THEN 'Compensation: ' || CASE WHEN id % 3 = 2 THEN 'CHF ' ELSE '' END || CASE WHEN id % 2 = 0 THEN CASE WHEN id % 3 = 1 THEN '€' ELSE '' END || {_K('(comp_max - 900)')} || ' – ' ELSE '' END || CASE WHEN id % 3 = 1 THEN '€' ELSE '' END || {_K('comp_max')} || CASE WHEN id % 5 = 0 THEN ' /year' ELSE '' END WHEN id % 7 = 0 THEN 'Compensation: ask us' END"
_SIGNALS = f"concat_ws(chr(10), CASE id % 4 WHEN 0 THEN 'Seniority: senior' WHEN 1 THEN 'Seniority: director' END, 'Workplace: ' || remote, {_PAYS}, CASE WHEN id % 6 = 0 THEN 'Department: Sales' END, 'Location: ' || location)"
register("embedding_input", f"SELECT id, input, CAST(ceil(length(input) / 4.0) AS BIGINT) AS tokens FROM (SELECT id, concat_ws(chr(10) || chr(10), coalesce(CASE id % 4 WHEN 0 THEN 'Sr. Engineer' WHEN 1 THEN 'Staff Director' WHEN 2 THEN 'Analyst' END, ''), nullif({_SIGNALS}, ''), CASE WHEN id % 10 = 3 THEN 'a summary' WHEN id % 5 = 3 THEN repeat('word ', 300) || '…' WHEN id % 5 = 2 THEN 'short' END) AS input FROM jobs) j", J)(lambda j: T.embedding_input(j.sparkSession.sql(_POSTED.replace("FROM jobs", "FROM {jobs}"), jobs=j)))
register("enriched_postings", "SELECT j.id, j.title, d.text AS description FROM jobs j LEFT JOIN documents d ON d.doc_id = j.id", J, "documents")(lambda j, d: enriched_postings(j, d.select(F.col("doc_id").alias("job_id"), F.col("text").alias("description"))).select("id", "title", "description"))
register("token_cost_estimate", "SELECT CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, round(sum(ceil(length(text) / 4.0)) * 0.02 / 1e6, 6) AS cost FROM documents", "documents")(lambda d: T.token_cost_estimate(d, "text", 0.02))
#: Titles with department and experience, and the verdict: family, target, level, confidence, by.
_TITLES = [
    ("Software Engineer", None, None, "software_engineering", True, None, "high", "rules"),
    ("Local Account Manager", "Supply Chain", None, "sales", True, "manager", "high", "rules"),
    ("Senior Embedded Software Developer (Audio_PA)", "Manufacturing", None, "software_engineering", True, "senior", "high", "rules"),
    ("BI Analyst", "Production", None, "data_ai", True, None, "high", "rules"),
    ("Project Manager", "Production", None, None, None, "manager", "low", "low"),
    ("High-Speed Digital PCB Layout Engineer", "Manufacturing", None, None, None, None, "low", "low"),
    ("Line Operator", "Production", None, "manual_labor", False, None, "high", "sr_function"),
    ("Line Operator", "Production", "Entry Level", "manual_labor", False, "junior", "high", "sr_function"),
    ("Patient Services Representative", "Health Care Provider", None, "clinical_healthcare", False, None, "high", "sr_function"),
    ("Shift Worker", "Restaurant – Food Service", None, "service_hospitality", False, None, "high", "sr_function"),
    ("Shift Worker", "Restaurant - Food Service", None, "service_hospitality", False, None, "high", "sr_function"),
    ("Account Coordinator", "Customer Service", None, None, None, None, "low", "low"),
    ("Forklift Operator", "Supply Chain", None, "manual_labor", False, None, "high", "rules"),
    ("Software Engineer", None, "Executive", "software_engineering", True, "exec", "high", "rules"),
    ("Senior Data Scientist", None, "Entry Level", "data_ai", True, "senior", "high", "rules"),
    ("Welder", None, "Not Applicable", "skilled_trades", False, None, "high", "rules"),
    ("Dishwasher", None, None, "service_hospitality", False, None, "high", "rules"),
    ("Food and Beverage Attendant", None, None, "service_hospitality", False, None, "high", "rules"),
    ("Licensed Practical Nurse", None, None, "clinical_healthcare", False, None, "high", "rules"),
    ("Practical Nurse", None, None, "clinical_healthcare", False, None, "high", "rules"),
    ("Mental Health Therapist", None, None, "clinical_healthcare", False, None, "high", "rules"),
    ("Diversional Therapist", None, None, "clinical_healthcare", False, None, "high", "rules"),
    ("Spa Therapist", None, None, "service_hospitality", False, None, "high", "rules"),
    ("Auto Body Repair Technician", None, None, "skilled_trades", False, None, "high", "rules"),
    ("Reconditioning Technician", None, None, "skilled_trades", False, None, "high", "rules"),
    ("Distribution Technician", None, None, "manual_labor", False, None, "high", "rules"),
    ("Distribution Engineer", None, None, None, None, None, "low", "low"),
    ("Power Distribution Planner", None, None, None, None, None, "low", "low"),
    ("Reconditioning Program Manager", None, None, "skilled_trades", False, "manager", "high", "rules"),
    ("Head of Things", None, None, None, None, "director", "low", "low"),
    (None, "Production", None, "manual_labor", False, None, "high", "sr_function"),
]


def _titled(p: DataFrame) -> DataFrame:
    pick = lambda i: "CASE p_partkey % " + str(len(_TITLES)) + " " + " ".join(f"WHEN {k} THEN '{t[i]}'" for k, t in enumerate(_TITLES) if t[i]) + " END"
    return p.select(F.col("p_partkey").alias("id"), F.expr(pick(0)).alias("title"), F.expr(pick(1)).alias("org_function"), F.expr(pick(2)).alias("experience"))


def _literal(x: str | bool | None) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'"


_TAGS = "SELECT p_partkey AS id, t.* EXCLUDE (k) FROM part JOIN (VALUES " + ", ".join(f"({k}, {', '.join(map(_literal, t))})" for k, t in enumerate(_TITLES)) + f") t(k, title, org_function, experience, tag_family, tag_target, tag_seniority, tag_confidence, tag_by) ON p_partkey % {len(_TITLES)} = k"
register("tag_titles", _TAGS, "part")(lambda p: T.tag_titles(_titled(p)))
register("tag_summary", f"SELECT tag_family, tag_target, tag_confidence, tag_by, count(*) AS n FROM ({_TAGS}) t GROUP BY ALL", "part")(lambda p: T.tag_summary(T.tag_titles(_titled(p))))
_OPEN = "job_family IS NULL AND is_target IS NULL AND tag_confidence = 'high'"
register("tag_backfill", f"SELECT j.id, CASE WHEN {_OPEN} THEN tag_family ELSE job_family END AS job_family, CASE WHEN {_OPEN} THEN tag_target ELSE is_target END AS is_target, CASE WHEN {_OPEN} THEN tag_seniority ELSE seniority END AS seniority, CASE WHEN {_OPEN} THEN tag_by END AS classified_by FROM jobs j LEFT JOIN ({_TAGS}) t ON t.id = j.id", J, "part")(lambda j, p: T.tag_backfill(j, T.tag_titles(_titled(p))))
#: Pay texts round a number n from 1 to 50 (p_size), and what they say: least, greatest, currency, interval.
_PAYS_OF = [
    ("'$' || n || 'K - $' || (n + 20) || 'K'", "n * 1000", "(n + 20) * 1000", "USD", None),
    ("'€' || n || ' per hour'", "n", "n", "EUR", "hour"),
    ("n || ',000 GBP per year'", "n * 1000", "n * 1000", "GBP", "year"),
    ("'300K to ' || n || 'K USD'", "NULL", "NULL", "USD", None),
    ("'Competitive'", "NULL", "NULL", None, None),
    ("'1' || n || ',000 CAD per  Year'", "CAST('1' || n AS INT) * 1000", "CAST('1' || n AS INT) * 1000", "CAD", "year"),
    ("'EUR ' || n || ' / £' || n", "n", "n", "GBP", "hour"),
    ("'EUROPE ' || n", "n", "n", None, "hour"),
    ("'$' || (n + 40) || ' to $10 per hour'", "CASE WHEN n + 40 <= 20 THEN n + 40 END", "CASE WHEN n + 40 <= 20 THEN 10 END", "USD", "hour"),
    ("'$' || n || '000 / hr'", "n * 1000", "n * 1000", "USD", "hour"),
    ("n || '0,000/yr aud'", "n * 10000", "n * 10000", "AUD", "year"),
    ("'inr ' || n || '.5M annually'", "(n + 0.5) * 1000000", "(n + 0.5) * 1000000", "INR", "year"),
    ("'SGD ' || n || ' - ' || (n + 1) || ' hourly'", "n", "n + 1", "SGD", "hour"),
    ("'chf ' || n || ',000 then nok'", "n * 1000", "n * 1000", "CHF", None),
    ("'NOK ' || n", "n", "n", "NOK", "hour"),
    ("n || ' dkk/HR'", "n", "n", "DKK", "hour"),
    ("'¥' || n || ',000,000 SEK'", "n * 1000000", "n * 1000000", "JPY", None),
    ("'SEK ' || n || '.1.1 or ' || (n + 2000)", "n + 2000", "n + 2000", "SEK", None),
    ("'JPY'", "NULL", "NULL", "JPY", None),
]
_PAY = f"CASE p_partkey % {len(_PAYS_OF)} " + " ".join(f"WHEN {i} THEN {text}" for i, (text, *_) in enumerate(_PAYS_OF)) + " END"
_PAY_SQL = "SELECT p_partkey, text, " + ", ".join(f"CAST(CASE k {' '.join(f'WHEN {i} THEN {row[c]}' for i, row in enumerate(_PAYS_OF))} END AS DOUBLE) AS {name}" for c, name in ((1, "comp_min"), (2, "comp_max"))) + ", " + ", ".join(f"CASE k {' '.join(f'WHEN {i} THEN {_literal(row[c])}' for i, row in enumerate(_PAYS_OF))} END AS {name}" for c, name in ((3, "comp_currency"), (4, "comp_interval"))) + f" FROM (SELECT *, {_PAY} AS text FROM (SELECT p_partkey, p_size AS n, p_partkey % {len(_PAYS_OF)} AS k FROM part) q) p"
register("compensation_table", _PAY_SQL, "part")(lambda p: T.compensation_table(p.withColumn("n", F.col("p_size")).withColumn("pay", F.expr(_PAY)), "p_partkey", "pay"))
_LABELS = "'Source: ' || source || chr(10) || 'Lang: ' || lang || chr(10) || 'Skills: ' || lang || ', ' || source || '/x' || chr(10) || 'Note: unknown' || chr(10) || 'Lang: last'"
register("labelled_fields", "SELECT doc_id, unnest(['source', 'lang', 'skills']) AS label, unnest([source, 'last', lang || ', ' || source || '/x']) AS value FROM documents", "documents")(lambda d: T.labelled_fields(d.withColumn("card", F.expr(_LABELS)), "doc_id", "card"))
register("skill_index", "SELECT doc_id, unnest([lang, source]) AS skill FROM documents", "documents")(lambda d: T.skill_index(d.withColumn("s", F.expr("lang || ', ' || source || '/x'")), "doc_id", "s"))

# --- retrieval: every hundredth vector (document) is a query against all
_SIM = "SELECT a.vec_id AS query, b.vec_id AS item, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"
_TOP = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM ({_SIM}) s) r WHERE rank <= 10"


def _vectors(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    return e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _dense(e: DataFrame) -> DataFrame:
    return R.vector_topk_many(*_vectors(e), 10)


register("vector_topk_many", _TOP, "embeddings")(_dense)
register("vector_topk", f"SELECT item, similarity FROM ({_SIM}) s WHERE query = 0 ORDER BY similarity DESC, item LIMIT 25", "embeddings")(lambda e: R.vector_topk(_vectors(e)[0], [float(x) for x in e.where("vec_id = 0").first().embedding], 25))


def _bm25(docs: str, queries: str, k: int) -> str:
    """BM25 with any term over (item, text) and (query, text)."""
    words = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9À-ɏ]+')"
    return f"""(WITH q AS (SELECT DISTINCT query, unnest({words}) AS term FROM ({queries}) qq), d AS (SELECT item, {words} AS t FROM ({docs}) dd), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d), p AS (SELECT item, len, term, count(*) AS tf FROM (SELECT item, len(t) AS len, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), h AS (SELECT query, item, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT query, item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM h) r WHERE rank <= {k})"""


register("lexical_search", "SELECT * FROM " + _bm25("SELECT doc_id AS item, text FROM documents", "SELECT item_id AS query, text FROM benchmark", 10) + " b", "documents", "benchmark")(lambda d, b: R.lexical_search(d.select(F.col("doc_id").alias("item"), "text"), b.select(F.col("item_id").alias("query"), "text"), 10, mode="any"))
_ALL = "SELECT query, item FROM (SELECT DISTINCT query, unnest(t) AS term, len(list_distinct(t)) AS n FROM (SELECT doc_id AS query, regexp_extract_all(lower(text), '[a-z0-9À-ɏ]+') AS t FROM documents WHERE doc_id % 100 = 0) a) q JOIN (SELECT DISTINCT doc_id AS item, unnest(regexp_extract_all(lower(text), '[a-z0-9À-ɏ]+')) AS term FROM documents) d USING (term) GROUP BY query, item, n HAVING count(*) = n"
register("lexical_search_all", _ALL, "documents")(lambda d: R.lexical_search(d.select(F.col("doc_id").alias("item"), "text"), d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "text"), None).select("query", "item"))


def _embedded(j: DataFrame, e: DataFrame) -> DataFrame:
    return j.join(e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector")), j.id == F.col("item"))


_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4)"
_PASS = "j.closed_at IS NULL AND j.is_target IS DISTINCT FROM FALSE"
register("filtered_search", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM (SELECT a.vec_id AS query, j.id AS item, {_COS} AS similarity FROM embeddings a, embeddings b JOIN jobs j ON j.id = b.vec_id WHERE a.vec_id % 100 = 0 AND {_PASS} AND job_family IN ('software_engineering', 'data_ai') AND seniority = 'senior' AND remote = 'remote' AND comp_max >= 2000 AND first_seen_at > TIMESTAMP '1993-01-01 00:00:00') s) r WHERE rank <= 10", J, "embeddings")(lambda j, e: R.filtered_search(_embedded(j, e), _vectors(e)[1], 10, families=["software_engineering", "data_ai"], seniority=["senior"], remote=True, comp_floor=2000, since="1993-01-01 00:00:00"))
_BASE = "SELECT d.doc_id AS item, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.lang = 'en'"
_ASKED = "SELECT d.doc_id AS query, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 100 = 0"
_NEAR = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, item) AS rank FROM (SELECT query, item, {_COS} AS similarity FROM ({_ASKED}) a, ({_BASE}) b) s) r WHERE rank <= 100)"


def _hybrid(d: DataFrame, e: DataFrame) -> DataFrame:
    both = d.join(e, d.doc_id == e.vec_id).select(F.col("doc_id").alias("item"), "text", F.col("embedding").alias("vector"), "lang")
    return R.hybrid_search(both.where("lang = 'en'"), both.where("item % 100 = 0").select(F.col("item").alias("query"), "text", "vector"), 20, mode="any")


register("hybrid_rrf", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rrf DESC, item) AS rank FROM (SELECT query, item, a.rank AS dense_rank, b.rank AS lexical_rank, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 8) AS rrf FROM {_NEAR} a FULL JOIN {_bm25(_BASE, _ASKED, 100)} b USING (query, item)) f) r WHERE rank <= 20", "documents", "embeddings")(_hybrid)


def _campaign_match(j: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    jobs = _embedded(j, e)
    status = F.when(F.col("vec_id") % 200 == 0, "active").otherwise("paused")
    ran = F.when(F.col("vec_id") != 0, F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"))
    campaigns = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("campaign"), status.alias("status"), ran.alias("last_run_at"), F.when(F.col("vec_id") != 400, F.col("embedding")).alias("vector"))
    matches = jobs.where("id % 3 = 0").select(F.col("id").alias("job")).crossJoin(F.broadcast(campaigns.select("campaign")))
    return R.campaign_match(campaigns, jobs, matches, 8, OR)


register("incremental_match", f"SELECT campaign, job, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY score DESC, job) AS rank FROM (SELECT a.vec_id AS campaign, j.id AS job, {_COS} AS score FROM embeddings a, embeddings b JOIN jobs j ON j.id = b.vec_id WHERE a.vec_id % 200 = 0 AND a.vec_id <> 400 AND {_PASS} AND (a.vec_id = 0 OR j.first_seen_at > TIMESTAMP '1995-01-01 00:00:00')) s) r WHERE rank <= 8 AND job % 3 <> 0", J, "embeddings")(lambda j, e: _campaign_match(j, e)[0])
register("campaign_watermarks", f"SELECT vec_id AS campaign, CASE WHEN vec_id % 200 = 0 AND vec_id <> 400 THEN TIMESTAMP '{OR}' ELSE TIMESTAMP '1995-01-01 00:00:00' END AS last_run_at FROM embeddings WHERE vec_id % 100 = 0", J, "embeddings")(lambda j, e: _campaign_match(j, e)[1].select("campaign", "last_run_at"))
_RANKB = f"SELECT query, item, similarity, row_number() OVER (PARTITION BY query ORDER BY item) AS rank FROM ({_TOP}) t WHERE item % 2 = 0"


def _second(e: DataFrame) -> DataFrame:
    return R.arm_rank(_dense(e).where("item % 2 = 0").withColumn("score", -F.col("item")), "score", 10).drop("score")


register("arm_rank", _RANKB, "embeddings")(_second)
register("rrf_fuse", f"SELECT query, item, round(sum(1 / (60 + rank)), 8) AS rrf FROM (SELECT query, item, rank FROM ({_TOP}) a UNION ALL SELECT query, item, rank FROM ({_RANKB}) b) u GROUP BY query, item", "embeddings")(lambda e: R.rrf_fuse(_dense(e).select("query", "item", "rank").unionByName(_second(e).select("query", "item", "rank"))))
register("minmax_normalize", f"SELECT query, item, round((similarity - min(similarity) OVER (PARTITION BY query)) / CASE WHEN max(similarity) OVER (PARTITION BY query) = min(similarity) OVER (PARTITION BY query) THEN 1 ELSE max(similarity) OVER (PARTITION BY query) - min(similarity) OVER (PARTITION BY query) END, 6) AS norm FROM ({_TOP}) t", "embeddings")(lambda e: R.minmax_normalize(_dense(e), "query", "similarity").select("query", "item", "norm"))
register("pool_union", f"SELECT DISTINCT query, item FROM (SELECT * FROM ({_TOP}) a WHERE rank <= 5 UNION ALL SELECT query, item, similarity, rank FROM ({_RANKB}) b WHERE rank <= 5) u", "embeddings")(lambda e: R.pool_union(_dense(e).select("query", "item", "rank").unionByName(_second(e).select("query", "item", "rank")), 5))
register("overlap_at_k", f"SELECT query, count(*) / 5 AS overlap FROM ({_TOP}) a JOIN ({_RANKB}) b USING (query, item) WHERE a.rank <= 5 AND b.rank <= 5 GROUP BY query", "embeddings")(lambda e: R.overlap_at_k(_dense(e), _second(e), 5))
register("rerank_by_score", f"SELECT query, item, fit, new_rank FROM (SELECT query, item, fit, row_number() OVER (PARTITION BY query ORDER BY fit DESC NULLS LAST, rank) AS new_rank FROM (SELECT *, CASE WHEN item % 3 <> 0 THEN least(greatest(CAST(item % 130 - 10 AS DOUBLE), 0), 100) END AS fit FROM ({_TOP}) t) s) r WHERE new_rank <= 5", "embeddings")(lambda e: R.rerank_by_score(_dense(e), _dense(e).where("item % 3 != 0").select("query", "item", (F.col("item") % 130 - 10).cast("double").alias("score")), 5))
_FUSE = "round(({c} - min({c}) OVER w) / CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1 ELSE max({c}) OVER w - min({c}) OVER w END, 6)"
register("feature_fusion", f"SELECT query, item, round(0.5 * {_FUSE.format(c='similarity')} + 0.4 * {_FUSE.format(c='skills')} + 0.1 * CASE item % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.375 ELSE 0.5 END, 8) AS score FROM (SELECT *, (item * 7 + query) % 5 / 4 AS skills FROM ({_TOP}) t) u WINDOW w AS (PARTITION BY query)", "embeddings")(lambda e: R.feature_fusion(_dense(e).select("query", "item", F.col("similarity").alias("cos"), ((F.col("item") * 7 + F.col("query")) % 5 / 4).alias("skills"), R.seniority_closeness(F.lit("senior"), F.when(F.col("item") % 3 == 0, "junior").when(F.col("item") % 3 == 1, "exec")).alias("closeness"))))
register("pointwise_pairs", f"SELECT query, item, q.text || chr(10) || '---' || chr(10) || d.text AS text FROM ({_TOP}) t JOIN documents q ON q.doc_id = t.query JOIN documents d ON d.doc_id = t.item WHERE rank <= 3", "embeddings", "documents")(lambda e, d: R.pointwise_pairs(R.pool_union(_dense(e), 3), d.select(F.col("doc_id").alias("query"), "text"), d.select(F.col("doc_id").alias("item"), "text")))


register("skill_overlap", "SELECT a.lang AS query, b.doc_id AS item, round(count(*) / 2, 6) AS overlap FROM (SELECT DISTINCT lang, unnest([lang, 'src1']) AS skill FROM documents) a JOIN (SELECT DISTINCT doc_id, unnest([lang, source]) AS skill FROM documents) b USING (skill) GROUP BY ALL", "documents")(lambda d: R.skill_overlap(d.select(F.col("lang").alias("query"), F.explode(F.array("lang", F.lit("src1"))).alias("skill")), d.select(F.col("doc_id").alias("item"), F.explode(F.array("lang", "source")).alias("skill"))))

register("skill_overlap_least", "SELECT doc_id AS query, item, round(count(*) / n, 6) AS overlap FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, unnest([lang, source, 's' || doc_id % 7]) AS skill FROM documents WHERE doc_id % 100 = 0) x WHERE skill IS NOT NULL) a JOIN (SELECT DISTINCT doc_id AS item, unnest([lang, source, 's' || doc_id % 11]) AS skill FROM documents) b USING (skill) GROUP BY doc_id, item, n HAVING count(*) >= 0.9 * n", "documents")(lambda d: R.skill_overlap_least(_skills(d.where("doc_id % 100 = 0"), "query", 7), _skills(d, "item", 11), 0.9))


def _skills(d: DataFrame, key: str, n: int) -> DataFrame:
    return d.select(F.col("doc_id").alias(key), F.explode(F.array("lang", "source", F.concat(F.lit("s"), (F.col("doc_id") % n).cast("string")))).alias("skill")).where("skill IS NOT NULL")


# --- evaluation: two methods rank each query's nearest vectors; a gain is the label they share
_SCORES = f"(SELECT query, 'dense' AS method, item, similarity AS score FROM ({_TOP}) a UNION ALL SELECT query, 'even' AS method, item, CASE WHEN item % 5 <> 0 THEN CAST(-rank AS DOUBLE) END AS score FROM ({_RANKB}) b)"
_GAINS = f"(SELECT query, item, CAST((item * 7 + query) % 11 AS DOUBLE) AS gain FROM ({_TOP}) t)"
_POS = f"(SELECT *, row_number() OVER (PARTITION BY query, method ORDER BY score DESC NULLS LAST, item) AS pos FROM {_SCORES} s)"
_BEST = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, item) AS pos FROM {_GAINS} g)"
_NDCG = f"SELECT query, method, round(coalesce(dcg / nullif(ideal, 0), 0), 6) AS ndcg FROM (SELECT query, method, sum(coalesce(gain, 0) / log2(pos + 1)) AS dcg FROM {_POS} p LEFT JOIN {_GAINS} g USING (query, item) WHERE pos <= 5 GROUP BY ALL) a LEFT JOIN (SELECT query, sum(gain / log2(pos + 1)) AS ideal FROM {_BEST} b WHERE pos <= 5 GROUP BY query) i USING (query)"
_MEAN = f"SELECT query, method, round(avg(gain), 6) AS mean_gain FROM {_POS} p JOIN {_GAINS} g USING (query, item) WHERE pos <= 5 GROUP BY ALL"
_RECALL = f"SELECT query, method, round(count(b.item) / 5, 6) AS recall FROM {_POS} p LEFT JOIN (SELECT * FROM {_BEST} x WHERE pos <= 5) b USING (query, item) WHERE p.pos <= 5 GROUP BY query, method"


def _scores(e: DataFrame) -> DataFrame:
    a = _dense(e).select("query", F.lit("dense").alias("method"), "item", F.col("similarity").alias("score"))
    return a.unionByName(_second(e).select("query", F.lit("even").alias("method"), "item", F.when(F.col("item") % 5 != 0, (-F.col("rank")).cast("double")).alias("score")))


def _gains(e: DataFrame) -> DataFrame:
    return _dense(e).select("query", "item", ((F.col("item") * 7 + F.col("query")) % 11).cast("double").alias("gain"))


register("ndcg_at_k", _NDCG, "embeddings")(lambda e: E.ndcg_at_k(_scores(e), _gains(e), 5))
register("mean_gain_at_k", _MEAN, "embeddings")(lambda e: E.mean_gain_at_k(_scores(e), _gains(e), 5))
register("recall_at_k", _RECALL, "embeddings")(lambda e: E.recall_at_k(_scores(e), _gains(e), 5))
register("method_leaderboard", f"SELECT method, round(avg(ndcg), 4) AS ndcg, round(avg(mean_gain), 4) AS mean_gain, round(avg(recall), 4) AS recall FROM ({_NDCG}) a LEFT JOIN ({_MEAN}) b USING (query, method) LEFT JOIN ({_RECALL}) c USING (query, method) GROUP BY method", "embeddings")(lambda e: E.method_leaderboard(_scores(e), _gains(e), 5))
register("separation", f"SELECT query, method, round(avg(CASE WHEN pos <= 3 THEN score END), 6) AS top_mean, round(avg(CASE WHEN pos <= 3 THEN score END) - avg(score), 6) AS separation FROM {_POS} p GROUP BY query, method", "embeddings")(lambda e: E.separation(_scores(e), 3))
_JUDGED = f"(SELECT query, item, unnest(['a', 'b']) AS judge, unnest([gain, CAST((item * 3) % 7 AS DOUBLE)]) AS gain FROM {_GAINS} g)"


def _judged(e: DataFrame) -> DataFrame:
    g = _gains(e)
    return g.withColumn("judge", F.lit("a")).unionByName(g.select("query", "item", (F.col("item") * 3 % 7).cast("double").alias("gain"), F.lit("b").alias("judge")))


register("judge_ensemble", f"SELECT query, item, round(avg(gain), 6) AS gain FROM {_JUDGED} j GROUP BY query, item", "embeddings")(lambda e: E.judge_ensemble(_judged(e)))
register("judge_agreement", f"SELECT query, round(1 - 6 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)), 6) AS spearman FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY gain DESC, item) AS ra, row_number() OVER (PARTITION BY query ORDER BY (item * 3) % 7 DESC, item) AS rb FROM {_GAINS} g) r GROUP BY query", "embeddings")(lambda e: E.judge_agreement(_judged(e), "a", "b"))
register("rank_map", f"SELECT query, item, '{{' || string_agg('\"' || method || '\":' || rank, ',' ORDER BY method) || '}}' AS ranks FROM (SELECT query, item, 'dense' AS method, rank FROM ({_TOP}) a UNION ALL SELECT query, item, 'even', rank FROM ({_RANKB}) b) u GROUP BY query, item", "embeddings")(lambda e: E.rank_map(_dense(e).select("query", "item", "rank", F.lit("dense").alias("method")).unionByName(_second(e).select("query", "item", "rank", F.lit("even").alias("method")))).withColumn("ranks", F.to_json("ranks")))
_FITTED = "(SELECT query, round(avg(item % 10), 4) AS {0} FROM ({1}) t WHERE rank <= 5 AND item % 4 <> 0 GROUP BY query)"
register("pipeline_diff", f"SELECT query, rank, a.item AS item_a, b.item AS item_b, coalesce(shared, 0) AS shared, fit_a, fit_b FROM (SELECT * FROM ({_TOP}) t WHERE rank <= 5) a FULL JOIN (SELECT * FROM ({_RANKB}) t WHERE rank <= 5) b USING (query, rank) LEFT JOIN (SELECT query, count(*) AS shared FROM ({_TOP}) a JOIN ({_RANKB}) b USING (query, item) WHERE a.rank <= 5 AND b.rank <= 5 GROUP BY query) s USING (query) LEFT JOIN {_FITTED.format('fit_a', _TOP)} fa USING (query) LEFT JOIN {_FITTED.format('fit_b', _RANKB)} fb USING (query)", "embeddings")(lambda e: E.pipeline_diff(_dense(e), _second(e), 5, _dense(e).where("item % 4 != 0").select("query", "item", (F.col("item") % 10).alias("fit"))))


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_tables(spark, sf_dir, ["orders"], {"orders": ["o_orderkey", "o_totalprice"]}, {"orders": "o_orderstatus = 'O' AND o_totalprice > 200000"})["orders"]


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_totals(bind(spark, sf_dir, M), bind(spark, sf_dir, J), shared_path(spark, "totals"), OR)


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in buckets, and three merges into it: keys of a few buckets, half of the others, and new ones."""
    jobs = bind(spark, sf_dir, J).select("id", "title", "location")
    table = BucketTable(spark, shared_path(spark, "buckets"), ["id"], jobs.schema, buckets=16)
    table.merge(jobs)
    table.merge(jobs.where("id % 100 = 7").select("id", F.lit("seventh").alias("title")), ["title"])
    table.merge(jobs.where("id % 2 = 0").select("id", F.lit("merged").alias("title")), ["title"])
    table.merge(jobs.where("id % 10 = 3").select((-F.col("id")).alias("id"), "title", "location"))
    return table.read()


_MERGES = "SELECT id, CASE WHEN id % 2 = 0 THEN 'merged' WHEN id % 100 = 7 THEN 'seventh' ELSE title END AS title, location FROM jobs UNION ALL SELECT -id, title, location FROM jobs WHERE id % 10 = 3"
QUERIES["merge_buckets"], ORACLES["merge_buckets"] = _buckets, f"{with_clause()} {_MERGES}"
QUERIES["snapshot_totals"], ORACLES["snapshot_totals"] = _snapshot, f"{with_clause()} {_TOTALS}"
QUERIES["load_tables"], ORACLES["load_tables"] = _loaded, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000"
