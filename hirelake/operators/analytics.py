"""Operational views: health of sources, totals, cycles, service levels, duplicates."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import instant
from .joins import interval_join


def _count(test: Column | str) -> Column:
    return F.count_if(F.expr(test) if isinstance(test, str) else test)


def _percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part.cast("decimal(20,4)") * 100, whole.cast("decimal(20,0)")), digits).cast("double")


def _sources(companies: DataFrame) -> DataFrame:
    return companies.select(F.col("id").alias("company_id"), "ats", "slug", "enabled")


def source_health(probes: DataFrame, companies: DataFrame, window: str, as_of: str) -> DataFrame:
    """Probes, outcomes and latency of each source over a trailing window; a probe without status is in no outcome.

    One shuffle, in which a task holds a source's different latencies; ``source_health_spread`` holds none.
    """
    rows = probes.where(F.col("created_at") > instant(as_of) - F.expr(f"INTERVAL {window}")).join(_sources(companies), "company_id")
    blocked = "http_status IN (403, 429)"
    return rows.groupBy("ats").agg(
        F.count("*").alias("probes"),
        _count("schema_ok").alias("ok"),
        _count(blocked).alias("blocked"),
        _count("NOT schema_ok AND http_status NOT IN (403, 429)").alias("errored"),
        _percent(_count(blocked), F.count("*")).alias("block_pct"),
        _percent(_count("schema_ok"), F.count("*")).alias("success_pct"),
        F.round(F.avg(F.col("latency_ms").cast("decimal(12,0)")), 0).cast("double").alias("avg_latency"),
        F.expr("bround(percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms), 0)").alias("p50_latency"),
        F.expr("bround(percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms), 0)").alias("p95_latency"),
    )


#: Bins of ``percentiles`` for each doubling of the value.
BINS = 16


def percentiles(counted: DataFrame, by: str, value: str, n: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each group from how often (column n) it has each value: by, one column a share.

    A first pass counts bins of a sixteenth of a doubling; only the bins that hold a wanted rank are then put in order,
    so no task holds a group's values. Values are finite numbers. Null values count as absent; a group with no others is in no row. Nulls of by
    are a group.
    """
    place = F.floor(F.signum(F.col(value)) * F.log1p(F.abs(F.col(value))) * (BINS / math.log(2)))
    rows = counted.where(F.col(value).isNotNull()).select(F.struct(by).alias("_by"), F.col(value).cast("double").alias("_v"), place.alias("_bin"), F.col(n).alias("_n"))
    # A group has as many rows here as bins, some hundreds.
    bins = rows.groupBy("_by", "_bin").agg(F.sum("_n").alias("_in"))
    all_of = Window.partitionBy("_by")
    bins = bins.withColumn("_all", F.sum("_in").over(all_of)).withColumn("_from", F.sum("_in").over(all_of.orderBy("_bin")) - F.col("_in"))
    rank = lambda share: (F.col("_all") - 1) * F.lit(float(share))
    ends = [end for share in shares.values() for end in (F.floor(rank(share)), F.ceil(rank(share)))]
    wanted = bins.where(functools.reduce(Column.__or__, [(end >= F.col("_from")) & (end < F.col("_from") + F.col("_in")) for end in ends]))
    inside = Window.partitionBy("_by", "_bin").orderBy("_v")
    values = rows.join(wanted, ["_by", "_bin"]).groupBy("_by", "_bin", "_v", "_from", "_all").agg(F.sum("_n").alias("_n"))
    values = values.withColumn("_to", F.col("_from") + F.sum("_n").over(inside))
    at = lambda end: F.max(F.when((end >= F.col("_to") - F.col("_n")) & (end < F.col("_to")), F.col("_v")))
    found = values.groupBy("_by").agg(F.first("_all").alias("_all"), *[at(end).alias(f"_{i}") for i, end in enumerate(ends)])
    out = []
    for i, (name, share) in enumerate(shares.items()):
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        between = (F.ceil(rank(share)) - rank(share)) * low + (rank(share) - F.floor(rank(share))) * high
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return found.select(F.col(f"_by.{by}").alias(by), *out)


def source_health_spread(probes: DataFrame, companies: DataFrame, window: str, as_of: str) -> DataFrame:
    """``source_health`` for sources of more different latencies than one task should hold.

    Probes are counted by source and latency in one shuffle; totals, the mean and the exact percentiles follow from these
    counts.
    """
    rows = probes.where(F.col("created_at") > instant(as_of) - F.expr(f"INTERVAL {window}")).join(_sources(companies), "company_id")
    counted = rows.groupBy("ats", "latency_ms").agg(
        F.count("*").alias("n"),
        _count("schema_ok").alias("ok"),
        _count("http_status IN (403, 429)").alias("blocked"),
        _count("NOT schema_ok AND http_status NOT IN (403, 429)").alias("errored"),
    )
    latency = F.sum(F.col("latency_ms").cast("decimal(12,0)") * F.col("n").cast("decimal(18,0)"))
    timed = F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("n"))).cast("decimal(20,0)")
    total = counted.groupBy("ats").agg(
        *[F.sum(c).alias(to) for c, to in [("n", "probes"), ("ok", "ok"), ("blocked", "blocked"), ("errored", "errored")]],
        _percent(F.sum("blocked"), F.sum("n")).alias("block_pct"),
        _percent(F.sum("ok"), F.sum("n")).alias("success_pct"),
        F.round(F.try_divide(latency, timed).cast("decimal(16,4)"), 0).cast("double").alias("avg_latency"),
    )
    half = percentiles(counted, "ats", "latency_ms", "n", {"p50_latency": 0.5, "p95_latency": 0.95}).withColumnRenamed("ats", "_ats")
    return total.join(half, F.col("ats").eqNullSafe(F.col("_ats")), "left").select(*total.columns, F.bround("p50_latency", 0).alias("p50_latency"), F.bround("p95_latency", 0).alias("p95_latency"))


def company_health(companies: DataFrame, probes: DataFrame, as_of: str, window: str = "7 DAY") -> DataFrame:
    """Probes and successes of each company over a trailing window; one without probes has 0 and a null share."""
    recent = probes.where(F.col("created_at") > instant(as_of) - F.expr(f"INTERVAL {window}"))
    counts = recent.groupBy("company_id").agg(F.count("*").alias("n"), _count("schema_ok").alias("good"))
    rows = companies.select(F.col("id").alias("company_id"), "slug").join(counts, "company_id", "left")
    return rows.select("company_id", "slug", F.coalesce("n", F.lit(0)).alias("probes"), F.coalesce("good", F.lit(0)).alias("ok"), _percent(F.col("good"), F.col("n")).alias("success_pct"))


def totals_by_source(companies: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Lifetime, open and new postings of each source; postings are counted by company before the join."""
    new = lambda days: _count(F.col("first_seen_at") > instant(as_of) - F.expr(f"INTERVAL {days} DAY"))
    per = jobs.groupBy("company_id").agg(F.count("*").alias("total"), _count("closed_at IS NULL").alias("active"), new(1).alias("new_1d"), new(7).alias("new_7d"), new(30).alias("new_30d"))
    rows = _sources(companies).join(per, "company_id", "left")
    return rows.groupBy("ats").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "active", "new_1d", "new_7d", "new_30d")])


#: What is kept between batches to tell totals: postings by source and, for the newest 30 days, by when they were first seen.
LEDGER = "ats STRING, at TIMESTAMP_NTZ, total LONG, active LONG"


def totals_ledger(ledger: DataFrame, changes: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """The ledger after a batch of life-cycle changes (company_id, first_seen_at, event), each counted as +1 or -1.

    Only changed postings are read. What was first seen more than 30 days before as_of is one row a source; later
    instants, one a batch, are kept apart. Postings of unknown companies count nowhere.
    """
    event, oldest = F.col("event"), instant(as_of) - F.expr("INTERVAL 30 DAY")
    signed = (_count(event.isin("new", "reopened")) - _count(event == "closed")).alias("active")
    delta = changes.groupBy("company_id", F.when(event == "new", F.col("first_seen_at")).alias("at")).agg(_count(event == "new").alias("total"), signed)
    rows = ledger.unionByName(delta.join(_sources(companies), "company_id").select("ats", "at", "total", "active"))
    return rows.groupBy("ats", F.when(F.col("at") > oldest, F.col("at")).alias("at")).agg(F.sum("total").alias("total"), F.sum("active").alias("active"))


def totals_of_ledger(ledger: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """As ``totals_by_source``, from the ledger alone."""
    new = lambda days: F.sum(F.when(F.col("at") > instant(as_of) - F.expr(f"INTERVAL {days} DAY"), F.col("total")).otherwise(0)).alias(f"new_{days}d")
    sums = ledger.groupBy("ats").agg(F.sum("total").alias("total"), F.sum("active").alias("active"), new(1), new(7), new(30))
    return companies.select("ats").distinct().join(sums, "ats", "left").select("ats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "active", "new_1d", "new_7d", "new_30d")])


def totals_rollup(companies: DataFrame, jobs: DataFrame, as_of: str) -> DataFrame:
    """Totals of each source, and one row for all (is_total 1)."""
    rows = totals_by_source(companies, jobs, as_of)
    return rows.rollup("ats").agg(F.sum("total").alias("total"), F.sum("active").alias("active"), F.grouping("ats").cast("int").alias("is_total"))


def new_by_cycle_source(runs: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """New postings of each (cycle, source): first seen inside the window of an ok run, ends included."""
    windows = runs.where("status = 'ok'").groupBy("cycle_id").agg(F.min("started_at").alias("w_start"), F.max("ended_at").alias("w_end"))
    return interval_join(jobs.select("company_id", "first_seen_at"), windows, "first_seen_at", "w_start", "w_end").join(_sources(companies), "company_id").groupBy("cycle_id", "ats").agg(F.count("*").alias("new_jobs"))


def pivot_sources(counts: DataFrame, sources: list[str]) -> DataFrame:
    """One row a cycle with a column for each of the stated sources (0 where it has none) and their total."""
    wide = counts.groupBy("cycle_id").pivot("ats", sources).agg(F.sum("new_jobs"))
    total = sum((F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in sources), F.lit(0))
    return wide.select("cycle_id", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s.lower()) for s in sources], total.alias("total"))


def cycle_rollup(runs: DataFrame) -> DataFrame:
    """Shards of a run as one cycle; a run without a cycle is its own."""
    keyed = runs.withColumn("cycle_id", F.coalesce("cycle_id", "id"))
    status = F.when(F.bool_or(F.col("status") == "running"), "running").when(F.bool_and(F.col("status") == "ok"), "ok").otherwise("failed")
    sums = [F.sum(c).alias(c) for c in ("companies_probed", "companies_ok", "companies_error", "new_jobs", "closed_jobs")]
    return keyed.groupBy("cycle_id").agg(F.min_by("id", F.struct("shard_index", "id")).alias("id"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"), status.alias("status"), *sums, F.max_by("active_jobs_after", F.struct("ended_at", "id")).alias("active_after"))


def recent_cycles(runs: DataFrame, jobs: DataFrame, n: int = 30) -> DataFrame:
    """The n newest cycles with their duration, new postings, the open count before and re-opened postings.

    New postings of an ok cycle are those first seen inside its window, ends included; of others, what the runs
    reported. The count before is that of the ok cycle before, so that a failed one between isn't taken for it. Where
    there is none, or the cycle isn't ok, re-opened is null. The n cycles are read first; postings meet their windows in
    one scan, a broadcast join and one count by cycle.
    """
    newest = cycle_rollup(runs).orderBy(F.desc("started_at"), F.desc("cycle_id")).limit(n)
    newest = runs.sparkSession.createDataFrame(newest.toArrow(), newest.schema)  # n rows, part of the plan from here on
    windows = newest.where("status = 'ok'").select(F.col("cycle_id").alias("cycle"), "started_at", "ended_at")
    seen = interval_join(jobs.select("first_seen_at"), F.broadcast(windows), "first_seen_at", "started_at", "ended_at").groupBy("cycle").agg(F.count("*").alias("n"))
    ok = F.col("status") == "ok"
    order = Window.partitionBy(ok).orderBy("started_at", "cycle_id")  # over n rows
    rows = newest.join(F.broadcast(seen), newest.cycle_id == seen.cycle, "left").withColumn("active_before", F.when(ok, F.lag("active_after").over(order)))
    rows = rows.withColumnRenamed("new_jobs", "new_jobs_reported").withColumn("new_jobs", F.when(ok, F.coalesce("n", F.lit(0))).otherwise(F.col("new_jobs_reported")))
    seconds = F.unix_timestamp(F.col("ended_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    residual = F.col("active_after") - F.col("active_before") - F.col("new_jobs") + F.col("closed_jobs")
    return rows.select("cycle_id", "status", seconds.alias("duration_s"), "new_jobs", "new_jobs_reported", "closed_jobs", "active_before", "active_after", F.when(ok & F.col("active_before").isNotNull(), F.greatest(F.lit(0), residual)).alias("reopened"))


def active_balance_check(cycles: DataFrame) -> DataFrame:
    """Cycles whose open postings don't add up, with what is missing."""
    residual = F.col("active_after") - F.col("active_before") - F.col("new_jobs") - F.col("reopened") + F.col("closed_jobs")
    return cycles.where("active_before IS NOT NULL").select("cycle_id", residual.alias("residual")).where("residual != 0")


def scan_rows(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs with new postings counted by window for the first shard of ok runs, and as reported for others."""
    first = runs.where("status = 'ok' AND shard_index = 0").select(F.col("id").alias("run"), "started_at", "ended_at")
    counts = interval_join(jobs.select("first_seen_at"), first, "first_seen_at", "started_at", "ended_at").groupBy("run").agg(F.count("*").alias("n"))
    rows = runs.join(counts, runs.id == counts.run, "left")
    windowed = (F.col("status") == "ok") & (F.col("shard_index") == 0)
    return rows.select("id", "status", "shard_index", F.when(windowed, F.coalesce("n", F.lit(0))).otherwise(F.col("new_jobs")).alias("new_jobs"), F.col("new_jobs").alias("new_jobs_reported"))


def active_delta(runs: DataFrame) -> DataFrame:
    """The two newest ok runs with the open count before and the change."""
    ok = runs.where("status = 'ok'").orderBy(F.desc("started_at"), F.desc("id")).limit(3)
    rows = ok.withColumn("previous", F.lag("active_jobs_after").over(Window.orderBy("started_at", "id")))
    return rows.where("previous IS NOT NULL").select("id", "active_jobs_after", "previous", (F.col("active_jobs_after") - F.col("previous")).alias("delta"), _percent(F.col("active_jobs_after") - F.col("previous"), F.nullif("previous", F.lit(0))).alias("delta_pct"))


def unique_active(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """One open posting for each (company, fingerprint): the one seen first, then the least id."""
    first = jobs.where("closed_at IS NULL").groupBy("company_id", "fingerprint").agg(F.min(F.struct("first_seen_at", "id")).alias("f"))
    return first.join(_sources(companies), "company_id").select("company_id", "fingerprint", F.col("f.id").alias("id"), F.col("f.first_seen_at").alias("first_seen_at"), "ats")


def unique_since(jobs: DataFrame, companies: DataFrame, window: str, as_of: str) -> DataFrame:
    """The unique open postings first seen inside a trailing window."""
    return unique_active(jobs, companies).where(F.col("first_seen_at") > instant(as_of) - F.expr(f"INTERVAL {window}"))


def duplicate_postings(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Open postings of a company that share a fingerprint, oldest first."""
    groups = jobs.where("closed_at IS NULL").groupBy("company_id", "fingerprint").agg(F.count("*").alias("copies"), F.array_sort(F.collect_list(F.struct("first_seen_at", "id"))).alias("rows"), F.max("first_seen_at").alias("last_seen"))
    many = groups.where("copies > 1").join(_sources(companies), "company_id")
    return many.select("ats", "company_id", "fingerprint", "copies", F.array_join(F.col("rows.id").cast("array<string>"), ",").alias("ids"), F.col("rows")[0]["first_seen_at"].alias("first_seen"), "last_seen")


def daily_new(jobs: DataFrame, days: int, as_of: str) -> DataFrame:
    """New postings and their companies for each of the last days that has any."""
    rows = jobs.where(F.col("first_seen_at") > instant(as_of) - F.expr(f"INTERVAL {days} DAY"))
    return rows.groupBy(F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("new_jobs"), F.count_distinct("company_id").alias("companies"))


def daily_closed(jobs: DataFrame, days: int, as_of: str) -> DataFrame:
    """Closed postings of each of the last days that has any."""
    rows = jobs.where(F.col("closed_at") > instant(as_of) - F.expr(f"INTERVAL {days} DAY"))
    return rows.groupBy(F.to_date("closed_at").alias("day")).agg(F.count("*").alias("closed_jobs"))


def top_employers(jobs: DataFrame, companies: DataFrame, n: int = 20) -> DataFrame:
    """The companies with most open postings, ties by slug."""
    counts = jobs.where("closed_at IS NULL").groupBy("company_id").agg(F.count("*").alias("open_jobs"))
    return counts.join(_sources(companies), "company_id").select("slug", "ats", "open_jobs").orderBy(F.desc("open_jobs"), "slug").limit(n)


def sla_block(health: DataFrame) -> DataFrame:
    """GREEN, AMBER from 1 % of blocks, RED from 5 %; an unknown share is GREEN."""
    state = F.when(F.col("block_pct") >= 5, "RED").when(F.col("block_pct") >= 1, "AMBER").otherwise("GREEN")
    return health.select("ats", "block_pct", state.alias("state"))


def sla_volume(unique: DataFrame, least: int = 50_000) -> DataFrame:
    """Whether the unique open postings are as many as they should be; AMBER from four fifths of it."""
    n = F.count("*")
    return unique.agg(n.alias("unique_active"), F.when(n >= least, "GREEN").when(n >= least * 0.8, "AMBER").otherwise("RED").alias("state"))


def sla_freshness(probes: DataFrame, companies: DataFrame, as_of: str) -> DataFrame:
    """Minutes since each source's last good probe: a rounded number of seconds, divided as integers."""
    last = probes.where("schema_ok").join(_sources(companies), "company_id").groupBy("ats").agg(F.max("created_at").alias("last_ok"))
    seconds = F.unix_timestamp(instant(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_ok").cast("timestamp"))
    minutes = F.floor(seconds / 60)
    return last.select("ats", minutes.alias("minutes"), F.when(minutes > 360, "RED").when(minutes > 240, "AMBER").otherwise("GREEN").alias("state"))


def sla_summary(health: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """The worst block share of any source, open postings and the end of the last ok run, with whether the first two are in bounds."""
    worst = health.agg(F.max("block_pct").alias("worst_block_pct"))
    active = jobs.agg(_count("closed_at IS NULL").alias("active"))
    last = runs.where("status = 'ok'").agg(F.max("ended_at").alias("last_ok_run"))
    return worst.crossJoin(active).crossJoin(last).withColumn("block_ok", F.col("worst_block_pct") < 1).withColumn("volume_ok", F.col("active") >= 50_000)


def headline_counts(jobs: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """Open postings, those first seen in the last 24 hours, and the end of the last ok run; one row."""
    counts = jobs.agg(_count("closed_at IS NULL").alias("open_jobs"), _count(F.col("first_seen_at") > instant(as_of) - F.expr("INTERVAL 1 DAY")).alias("new_24h"))
    return counts.crossJoin(runs.where("status = 'ok'").agg(F.max("ended_at").alias("last_ok_run")))


def write_failure_rate(runs: DataFrame, window: str, as_of: str) -> DataFrame:
    """Share of failed writes of each run; the alarm needs more than 25 and more than 5 %."""
    recent = runs.where(F.col("started_at") > instant(as_of) - F.expr(f"INTERVAL {window}"))
    rate = _percent(F.col("companies_write_failed"), F.col("companies_probed"))
    return recent.select("id", rate.alias("fail_pct"), ((F.col("companies_write_failed") > 25) & (F.col("companies_write_failed") > F.col("companies_probed") * 0.05)).alias("alarm"))


def zombie_open(jobs: DataFrame, companies: DataFrame, runs: DataFrame, hours: int = 12) -> DataFrame:
    """Open postings of enabled companies, by company, last seen some hours before the newest ok run began."""
    newest = runs.where("status = 'ok'").agg(F.max("started_at").alias("newest"))
    rows = jobs.where("closed_at IS NULL").join(_sources(companies).where("enabled"), "company_id").crossJoin(F.broadcast(newest))
    return rows.where(F.col("last_seen_at") < F.col("newest") - F.expr(f"INTERVAL {hours} HOUR")).groupBy("slug").agg(F.count("*").alias("zombies"))


def error_breakdown(probes: DataFrame, run_id: str | None = None, n: int = 12) -> DataFrame:
    """Failures by the start of their error, whole or up to a colon, 60 characters at most."""
    rows = probes.where("NOT schema_ok") if run_id is None else probes.where((F.col("run_id") == run_id) & ~F.col("schema_ok"))
    said = F.coalesce("error", F.concat(F.lit("HTTP "), F.col("http_status").cast("string")), F.lit("unknown"))
    return rows.groupBy(F.substring(F.substring_index(said, ":", 1), 1, 60).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(n)


def error_signature_counts(probes: DataFrame, prefix: str = "db_write:") -> DataFrame:
    """Facts of each run whose error begins with the prefix."""
    return probes.where(F.col("error").startswith(prefix)).groupBy("run_id").agg(F.count("*").alias("n"))


def metric_series(runs: DataFrame, metric: str, n: int) -> DataFrame:
    """The last n ok runs of a metric, the change from each to the next, and the series' least, greatest and mean."""
    rows = runs.where("status = 'ok'").select("id", "started_at", F.col(metric).alias("value")).orderBy(F.desc("started_at"), F.desc("id")).limit(n)
    order, whole = Window.orderBy("started_at", "id"), Window.partitionBy()
    return rows.select("id", "value", (F.col("value") - F.lag("value").over(order)).alias("delta"), F.min("value").over(whole).alias("least"), F.max("value").over(whole).alias("greatest"), F.round(F.avg(F.col("value").cast("double")).over(whole), 4).alias("mean"))


def source_outcomes(probes: DataFrame, companies: DataFrame) -> DataFrame:
    """Outcomes of each source by status: 2xx is ok, 403 and 429 a block, all else (none included) an error."""
    outcome = F.when(F.col("http_status").between(200, 299), "ok").when(F.col("http_status").isin(403, 429), "block").otherwise("error")
    rows = probes.join(_sources(companies), "company_id").withColumn("outcome", outcome)
    return rows.groupBy("ats").agg(*[_count(F.col("outcome") == o).alias(f"{o}s") for o in ("ok", "block", "error")], _percent(_count(F.col("outcome") == "block"), F.count("*")).alias("block_pct"))


def probe_retention(probes: DataFrame, companies: DataFrame, keep_days: int, as_of: str) -> DataFrame:
    """Facts older than the days to keep, as daily counts of each source."""
    old = probes.where(F.col("created_at") <= instant(as_of) - F.expr(f"INTERVAL {keep_days} DAY")).join(_sources(companies), "company_id")
    return old.groupBy(F.to_date("created_at").alias("day"), "ats").agg(F.count("*").alias("probes"), _count("schema_ok").alias("ok"))


def rolling_block_rate(probes: DataFrame, companies: DataFrame, n: int = 20, days: int = 1) -> DataFrame:
    """Share of blocks in each source's last n outcomes; flags come only once n are known. Ties of time go by id.

    Time is cut into ranges of some days, so that a source's history is ranked in as many tasks as it has ranges. Each
    range also gets the last n - 1 rows before it: of every range at most so many rows, for the few ranges after it that
    hold less than n. A fact without a time comes before all others.
    """
    rows = probes.join(_sources(companies), "company_id").select("ats", "id", "created_at", F.coalesce(F.col("http_status").isin(403, 429), F.lit(False)).cast("int").alias("block"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.unix_date(F.to_date("created_at")) / days), F.lit(-(2**40))))
    by_time = Window.partitionBy("ats").orderBy("range")  # over the ranges of a source
    sizes = rows.groupBy("ats", "range").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("before", F.sum("size").over(by_time) - F.col("size"))
    later = F.collect_list(F.struct(F.col("range").alias("to"), F.col("before"))).over(by_time.rowsBetween(1, n - 1))
    sizes = sizes.select("ats", "range", (F.col("before") + F.col("size")).alias("upto"), later.alias("later"))
    newest = F.row_number().over(Window.partitionBy("ats", "range").orderBy(F.desc_nulls_last("created_at"), F.desc("id")))
    tails = rows.withColumn("place", newest).where(F.col("place") < n).join(sizes, ["ats", "range"]).withColumn("next", F.explode("later"))
    carried = tails.where(F.col("next.before") - F.col("upto") + F.col("place") < n).select("ats", "id", "created_at", "block", F.col("next.to").alias("range"), F.lit(False).alias("own"))
    order = Window.partitionBy("ats", "range").orderBy(F.asc_nulls_first("created_at"), "id").rowsBetween(-(n - 1), 0)
    both = rows.withColumn("own", F.lit(True)).unionByName(carried).select("ats", "id", "own", F.sum("block").over(order).alias("blocks"), F.count("*").over(order).alias("seen")).where("own")
    rate = F.col("blocks") / F.col("seen")
    flag = F.when(F.col("seen") < n, None).when(rate > 0.05, "throttle").when(rate < 0.01, "recover")
    return both.select("ats", "id", F.round(rate, 4).alias("rate"), flag.alias("flag"))


def slug_counts(mentions: DataFrame) -> DataFrame:
    """Mentions of each (source, slug): hits add up, the latest year counts."""
    return mentions.groupBy("ats", "slug").agg(F.sum("hits").alias("hits"), F.max("latest_year").alias("latest_year"))


def slug_merge(pool: DataFrame, found: DataFrame) -> DataFrame:
    """Old pool and new mentions together: hits add up, the latest year wins."""
    return slug_counts(pool.select("ats", "slug", "hits", "latest_year").unionByName(found.select("ats", "slug", "hits", "latest_year")))


def proportional_allocate(pool: DataFrame, group_col: str, target: int, order_cols: list[str]) -> DataFrame:
    """Picks about ``target`` rows over groups by their share; what flooring leaves goes round the groups in turn.

    How many whole rounds that makes follows from the groups' sizes, one row a group; no round is written out. Rows are
    ranked in their group up to the target only. Fewer rows than the target are all taken.
    """
    sizes = pool.groupBy(group_col).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("all"))
    base = sizes.crossJoin(F.broadcast(total)).withColumn("quota", F.least("size", F.floor(F.lit(target) * F.col("size") / F.col("all")))).withColumn("left", F.col("size") - F.col("quota"))
    short = base.agg((F.least(F.lit(target), F.first("all")) - F.sum("quota")).alias("short"), F.count("*").alias("groups"))
    # If every group took as many rounds as this one has rows left, so many rows would go.
    up_to = Window.orderBy("left", group_col)  # over the groups
    levels = base.withColumn("at", F.row_number().over(up_to)).withColumn("taken", F.sum("left").over(up_to.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(short))
    whole = levels.withColumn("level", F.col("taken") + (F.col("groups") - F.col("at")) * F.col("left")).where("level <= short").agg(F.max(F.struct("level", "left", F.col("at").alias("full"))).alias("w"))
    state = short.crossJoin(whole).select("short", F.coalesce("w.left", F.lit(0)).alias("done"), (F.col("groups") - F.coalesce("w.full", F.lit(0))).alias("open"), (F.col("short") - F.coalesce("w.level", F.lit(0))).alias("rest"))
    state = state.select((F.col("done") + F.when(F.col("open") > 0, F.floor(F.col("rest") / F.greatest("open", F.lit(1)))).otherwise(0)).alias("rounds"), F.when(F.col("open") > 0, F.col("rest") % F.greatest("open", F.lit(1))).otherwise(0).alias("over"))
    more = base.crossJoin(F.broadcast(state))
    turn = F.sum((F.col("left") > F.col("rounds")).cast("int")).over(Window.orderBy(group_col))
    extra = F.least("left", "rounds") + ((F.col("left") > F.col("rounds")) & (turn <= F.col("over"))).cast("int")
    quota = more.select(group_col, (F.col("quota") + extra).alias("quota"))
    ranked = pool.withColumn("rn", F.row_number().over(Window.partitionBy(group_col).orderBy(*order_cols))).where(F.col("rn") <= target)
    return ranked.join(quota, group_col).where("rn <= quota").drop("rn", "quota")


def class_coverage(jobs: DataFrame) -> DataFrame:
    """Postings and their share by family and relevance, unknown ones included. The share's window runs over the counts."""
    counts = jobs.groupBy("job_family", "is_target").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))
