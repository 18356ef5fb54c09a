"""Change capture: merging listing batches, closing what is gone, source state, archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import instant

KEYS = ["company_id", "external_id"]


def lifecycle_merge(jobs: DataFrame, listing: DataFrame, as_of: str) -> DataFrame:
    """Applies a listing: new rows first and last seen now, seen rows open and last seen now, others as they are.

    All columns of jobs stay. Those that the listing has too take its values where it has one; those that it lacks are
    null in new rows. A row that the listing repeats counts once, that of greatest values.
    """
    now = instant(as_of)
    fields = [c for c in listing.columns if c in jobs.columns and c not in (*KEYS, "first_seen_at", "last_seen_at", "closed_at")]
    new = listing.repartition(*KEYS).groupBy(*KEYS).agg(F.max(F.struct(F.lit(True).alias("in"), *fields)).alias("_new"))  # dealt first: few rows repeat
    both = jobs.join(new, KEYS, "full_outer")
    seen = F.coalesce("_new.in", F.lit(False))
    put = {"first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")), "closed_at": F.when(seen, None).otherwise(F.col("closed_at"))}
    put |= {c: F.coalesce(F.col("_new")[c], F.col(c)) for c in fields}
    return both.select(*[put.get(c, F.col(c)).alias(c) for c in jobs.columns])


def close_unseen(jobs: DataFrame, ok_companies: DataFrame, run_start: str) -> DataFrame:
    """Closes open rows of companies whose probe and write went well, if they were last seen before the run."""
    marked = jobs.join(ok_companies.select("company_id", F.lit(True).alias("_ok")).distinct(), "company_id", "left")
    gone = F.coalesce("_ok", F.lit(False)) & F.col("closed_at").isNull() & (F.col("last_seen_at") < instant(run_start))
    return marked.withColumn("closed_at", F.when(gone, instant(run_start)).otherwise(F.col("closed_at"))).select(*jobs.columns)


def lifecycle_events(before: DataFrame, after: DataFrame, as_of: str) -> DataFrame:
    """new, seen, closed, reopened or untouched for each row after a batch."""
    old = before.select(*KEYS, F.col("closed_at").alias("_closed"), F.lit(True).alias("_known"))
    rows = after.join(old, KEYS, "left")
    event = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_closed").isNotNull() & F.col("closed_at").isNull(), "reopened")
        .when(F.col("_closed").isNull() & F.col("closed_at").isNotNull(), "closed")
        .when(F.col("last_seen_at") == instant(as_of), "seen")
        .otherwise("untouched")
    )
    return rows.select(*KEYS, event.alias("event"))


def lifecycle_changes(jobs: DataFrame, listing: DataFrame, as_of: str) -> DataFrame:
    """The rows that a run's listing changes, as they are after it, with ``event``: new, seen, closed or reopened.

    A listed row is new, reopened or seen (if anything of it has changed, last_seen_at included); an open row that its
    company no longer lists is closed, if it was last seen before the run. Rows of companies that the listing doesn't hold
    are left alone, so jobs may be without them. The listing must be whole for its companies.

    Jobs and listing meet by key first, and only what would change is held against the listing's companies.
    """
    now = instant(as_of)
    rest = [c for c in jobs.columns if c not in KEYS]
    merged = lifecycle_merge(jobs.select("*", F.struct(*rest).alias("_before")), listing, as_of)
    gone = F.col("closed_at").isNull() & (F.col("last_seen_at") < now)
    after = merged.withColumn("closed_at", F.when(gone, now).otherwise(F.col("closed_at")))
    event = (
        F.when(F.col("_before").isNull(), "new")
        .when(F.col("_before.closed_at").isNotNull() & F.col("closed_at").isNull(), "reopened")
        .when(F.col("_before.closed_at").isNull() & F.col("closed_at").isNotNull(), "closed")
        .when(~F.struct(*rest).eqNullSafe(F.col("_before")), "seen")
    )
    changed = after.select(*jobs.columns, event.alias("event")).where("event IS NOT NULL")
    asked = listing.select("company_id").distinct().withColumn("_asked", F.lit(True))
    return changed.join(asked, "company_id", "left").where("event <> 'closed' OR _asked").select(*jobs.columns, "event")


def event_totals(events: DataFrame) -> DataFrame:
    """How many rows had each event."""
    return events.groupBy("event").agg(F.count("*").alias("n"))


def run_totals(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """A row a run: companies probed, ok, in error and with a failed write (``run_outcomes``), new and closed postings.

    events (run_id, event) are those of ``lifecycle_events`` or ``lifecycle_changes`` with their run. A posting that comes
    back counts as new, as it was not among the open ones. Events are counted by run before the join; a run without any
    has 0, and events of runs that probed nothing are in no row.
    """
    counts = events.groupBy("run_id").agg(F.count_if(F.col("event").isin("new", "reopened")).alias("_new"), F.count_if(F.col("event") == "closed").alias("_closed"))
    rows = outcomes.join(counts, "run_id", "left")
    return rows.select("run_id", "probed", "ok", "error", "write_failed", F.coalesce("_new", F.lit(0)).alias("new_jobs"), F.coalesce("_closed", F.lit(0)).alias("closed_jobs"))


def run_outcomes(probes: DataFrame) -> DataFrame:
    """Companies probed in each run, and of them those ok, in error, and (of those ok) whose write failed.

    A company counts once a run, by its last probe (time, then id). A failed write is told by the error's beginning.
    """
    last = probes.groupBy("run_id", "company_id").agg(F.max_by(F.struct("schema_ok", "error"), F.struct("created_at", "id")).alias("p"))
    failed = F.coalesce(F.col("p.error").startswith("db_write:"), F.lit(False))
    good = F.coalesce("p.schema_ok", F.lit(False))
    return last.groupBy("run_id").agg(F.count("*").alias("probed"), F.count_if(good & ~failed).alias("ok"), F.count_if(~good & ~failed).alias("error"), F.count_if(failed).alias("write_failed"))


def changed_descriptions(snapshot: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed rows whose text hash differs from the snapshot's; no hash means no change, an unknown row is a change."""
    old = snapshot.select(*KEYS, F.col("description_hash").alias("_old"))
    return listing.join(old, KEYS, "left").where(F.col("description_hash").isNotNull() & ~F.col("description_hash").eqNullSafe(F.col("_old"))).select(*KEYS, "description_hash")


def invalidate_derived(old: DataFrame, new: DataFrame, derived: list[str]) -> DataFrame:
    """New rows with the derived columns emptied where the text hash changed."""
    before = old.select(*KEYS, F.col("description_hash").alias("_old"), F.lit(True).alias("_known"))
    rows = new.join(before, KEYS, "left")
    changed = F.col("_known").isNotNull() & ~F.col("description_hash").eqNullSafe(F.col("_old"))
    return rows.select(*[F.when(changed, None).otherwise(F.col(c)).alias(c) if c in derived else F.col(c) for c in new.columns])


def source_state_update(companies: DataFrame, probes: DataFrame, threshold: int = 5) -> DataFrame:
    """A failed probe adds an error, and the threshold disables; a good one resets errors but doesn't enable again.

    A company's last probe decides (time, then id); one without probes stays as it is. last_error is what the failed
    probe says, or else its status; its time, or that of the success, is noted. Columns that companies lack are null.
    """
    fields = F.struct("schema_ok", "created_at", F.coalesce("error", F.concat(F.lit("HTTP "), F.col("http_status").cast("string")), F.lit("unknown")).alias("said"))
    last = probes.groupBy("company_id").agg(F.max_by(fields, F.struct("created_at", "id")).alias("p"))
    rows = companies.join(last.withColumnRenamed("company_id", "id"), "id", "left")
    old = lambda c, t: F.col(c) if c in companies.columns else F.lit(None).cast(t)
    good, known = F.coalesce("p.schema_ok", F.lit(False)), F.col("p").isNotNull()
    bad = known & ~good
    errors = F.when(bad, F.col("consecutive_errors") + 1).when(known, 0).otherwise(F.col("consecutive_errors"))
    return rows.select(
        "id", "slug", errors.cast("int").alias("consecutive_errors"), (F.col("enabled") & ~(bad & (errors >= threshold))).alias("enabled"),
        F.when(bad, F.col("p.said")).otherwise(old("last_error", "string")).alias("last_error"), F.when(bad, F.col("p.created_at")).otherwise(old("last_error_at", "timestamp_ntz")).alias("last_error_at"),
        F.when(known & good, F.col("p.created_at")).otherwise(old("last_success_at", "timestamp_ntz")).alias("last_success_at"),
    )


def reap_stale_runs(runs: DataFrame, as_of: str, minutes: int = 45) -> DataFrame:
    """Runs that have been running for longer than some minutes are failed; one without a start is left alone."""
    stale = (F.col("status") == "running") & (F.col("started_at") < instant(as_of) - F.expr(f"INTERVAL {minutes} MINUTE"))
    return runs.select("id", "started_at", F.when(stale, "failed").otherwise(F.col("status")).alias("status"))


def content_hash(body: Column) -> Column:
    """A hash of what a payload says: of its JSON with keys in order and no blanks, or of the text where it is none."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(body)), body), 256)


def raw_archive_ingest(archive: DataFrame, batch: DataFrame, as_of: str) -> DataFrame:
    """Content-addressed archive of payloads (company_id, body, and any others that the archive has).

    A payload that says what its company's newest one says changes nothing; one known from before moves its
    last_seen_at; a new one is added. Null bodies are left out. Of payloads that say the same the least text is kept.
    """
    now = instant(as_of)
    extra = [c for c in batch.columns if c in archive.columns and c not in ("company_id", "content_hash", "body", "created_at", "last_seen_at")]
    new = batch.where("body IS NOT NULL").withColumn("content_hash", content_hash(F.col("body"))).groupBy("company_id", "content_hash").agg(F.min(F.struct("body", *extra)).alias("_new"))
    newest = archive.groupBy("company_id").agg(F.max_by("content_hash", F.struct("last_seen_at", "created_at", "content_hash")).alias("content_hash"))
    new = new.join(newest, ["company_id", "content_hash"], "left_anti")
    both = archive.join(new, ["company_id", "content_hash"], "full_outer")
    put = {"created_at": F.coalesce("created_at", now), "last_seen_at": F.when(F.col("_new").isNotNull(), now).otherwise(F.col("last_seen_at"))}
    put |= {c: F.coalesce(F.col(c), F.col("_new")[c]) for c in ("body", *extra)}
    return both.select(*[put.get(c, F.col(c)).alias(c) for c in archive.columns])


def archive_replay(archive: DataFrame, as_of: str) -> DataFrame:
    """Each company's payload as of an instant: the newest of those archived by then, with all its columns."""
    known = archive.where(F.col("created_at") <= instant(as_of))
    rest = [c for c in archive.columns if c != "company_id"]
    return known.groupBy("company_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "content_hash")).alias("_a")).select("company_id", "_a.*")


def constraint_check(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows that break declared keys, value sets and references, as counts by rule."""
    unique = lambda df, keys, name: df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
    rules = [
        unique(companies, ["ats", "slug"], "companies_key"),
        unique(jobs, KEYS, "jobs_key"),
        jobs.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_anti").agg(F.count("*").alias("violations")).select(F.lit("jobs_company").alias("rule"), "violations"),
        jobs.where("title IS NULL").agg(F.count("*").alias("violations")).select(F.lit("jobs_title").alias("rule"), "violations"),
        jobs.where("NOT remote IN ('remote', 'onsite', 'hybrid')").agg(F.count("*").alias("violations")).select(F.lit("jobs_remote").alias("rule"), "violations"),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def load_source_list(companies: DataFrame, seeds: DataFrame) -> DataFrame:
    """Upserts seeds on (ats, slug): a known row keeps ``enabled`` and takes the seed's addresses, a new one is enabled.

    Seeds without an ats or slug are left out, and of repeated ones the greatest addresses count. Without the columns
    careers_url and probe_url in seeds, only the key is written.
    """
    urls = [c for c in ("careers_url", "probe_url") if c in seeds.columns]
    new = seeds.where("ats IS NOT NULL AND slug IS NOT NULL").groupBy("ats", "slug").agg(*[F.max(c).alias(f"_{c}") for c in urls], F.count("*").alias("_n")).drop("_n")
    both = companies.select("ats", "slug", "enabled", *[c for c in urls if c in companies.columns]).join(new, ["ats", "slug"], "full_outer")
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in companies.columns else F.col(f"_{c}").alias(c) for c in urls]
    return both.select("ats", "slug", F.coalesce("enabled", F.lit(True)).alias("enabled"), *kept)


def pointer_recovery(candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """The best new slug of each failing source: by kind (1 the best), never an owned one, never one for two sources."""
    free = candidates.join(owned.select("slug").distinct(), "slug", "left_anti")
    one = free.withColumn("rn", F.row_number().over(Window.partitionBy("company_id").orderBy("kind", "slug"))).where("rn = 1")
    return one.withColumn("rn", F.row_number().over(Window.partitionBy("slug").orderBy("kind", "company_id"))).where("rn = 1").select("company_id", "slug", "kind")
