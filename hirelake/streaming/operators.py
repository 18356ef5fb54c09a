"""Streams of probe facts, listings, payloads and postings. Each has a batch operator that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.analytics import LEDGER, totals_ledger, totals_of_ledger
from ..operators.lifecycle import KEYS, lifecycle_changes
from ..operators.retrieval import incremental_match, vector_topk_many
from ..sources.buckets import BucketTable
from ..sources.shared import empty
from .keyed import RollingBlock, StaleRuns, start_keyed


def _blocked() -> Column:
    return F.coalesce(F.col("http_status").isin(403, 429), F.lit(False))


def _zoned(stream: DataFrame, time: str) -> DataFrame:
    """A watermark needs a time with a zone; ours are UTC."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def stream_source_health(probes: DataFrame, companies: DataFrame, width: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Health of each source on tumbling or sliding windows of created_at; facts later than the watermark go.

    Companies are a static side. Facts without a time or of unknown companies are in no window.
    """
    rows = _zoned(probes, "created_at").withWatermark("created_at", watermark).join(companies.select(F.col("id").alias("company_id"), "ats"), "company_id")
    span = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    counted = rows.groupBy("ats", span.alias("w")).agg(F.count("*").alias("probes"), F.count_if("schema_ok").alias("ok"), F.count_if(_blocked()).alias("blocked"), F.sum(F.col("latency_ms").cast("long")).alias("latency_sum"))
    return counted.select("ats", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "probes", "ok", "blocked", "latency_sum")


def stream_first_seen(listing: DataFrame, watermark: str, time: str = "listed_at") -> DataFrame:
    """One row for each (company, external id) within the watermark; which of several in one batch is not said."""
    return _zoned(listing, time).withWatermark(time, watermark).dropDuplicatesWithinWatermark(KEYS)


def stream_rolling_block(probes: DataFrame, path: str, n: int = 20, above: float = 0.05, below: float = 0.01, **trigger) -> StreamingQuery:
    """Turns of a source (column ats) between throttled and not, by the share of blocks in its last n outcomes.

    A full window of more than ``above`` blocks throttles a source that isn't, one of less than ``below`` lets it recover;
    each turn is a row: ats, id, created_at, rate, turn. The state is a ring of n - 1 outcomes a source, so a micro-batch
    touches only the sources that it holds. Outcomes are ordered by (created_at, id) inside a micro-batch (unknown times
    first), and micro-batches follow one another. Outcomes without a source are left out. A task holds 17 bytes or so an
    outcome of its sources in one micro-batch, which the trigger bounds.
    """
    rows = probes.where("ats IS NOT NULL").select("ats", F.col("id").cast("long").alias("id"), "created_at", _blocked().cast("int").alias("block"))
    return start_keyed(rows, "ats", RollingBlock(n, above, below), "ats STRING, id LONG, created_at TIMESTAMP_NTZ, rate DOUBLE, turn STRING", "None", path, **trigger)


def stream_archive_dedup(raw: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Payloads whose content differs from the company's one before (A, B, A are three), written under path/out.

    The state is one hash a company, in the state store: a micro-batch touches only the companies that it holds. What a
    task holds of a company are hashes of one micro-batch, ordered by (fetched_at, id), unknown times first. Payloads
    without a company are left out; a null one is an empty one.
    """
    new = raw.where("company_id IS NOT NULL").select(F.col("company_id").cast("long").alias("company_id"), F.col("id").cast("long").alias("id"), "fetched_at", F.sha2(F.coalesce("body", F.lit("")), 256).alias("content_hash"))

    def changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["fetched_at", "id"], na_position="first")
        before = rows["content_hash"].shift(fill_value=state.get[0] if state.exists else "")
        state.update((rows["content_hash"].iloc[-1],))
        yield rows.loc[rows["content_hash"] != before, ["company_id", "id", "content_hash"]]

    out = new.groupBy("company_id").applyInPandasWithState(changed, "company_id LONG, id LONG, content_hash STRING", "content_hash STRING", "append", GroupStateTimeout.NoTimeout)
    return out.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(**(trigger or {"availableNow": True})).start()


def stream_stale_runs(run_events: DataFrame, path: str, minutes: int = 45, watermark: str = "0 seconds", **trigger) -> StreamingQuery:
    """Runs (run_id, at, ended) without an end for longer than some minutes, as failed: run_id, started_at, status.

    The clock is the watermark: the newest time of the micro-batches so far, less ``watermark``; events older than it come
    too late and are left out, as are those without a run or time. Each run has its start and an event-time timer in the
    state store; when the timer runs out, the run's state goes, failed or ended. An end may come before its start. A failed
    run that goes on later is a new run. Times count in milliseconds.
    """
    rows = _zoned(run_events.where("run_id IS NOT NULL AND at IS NOT NULL"), "at").withWatermark("at", watermark)
    rows = rows.select("run_id", "at", F.coalesce("ended", F.lit(False)).alias("ended"))
    return start_keyed(rows, "run_id", StaleRuns(minutes), "run_id STRING, started_at TIMESTAMP_NTZ, status STRING", "EventTime", path, **trigger)


_JOBS = "company_id LONG, external_id STRING, title STRING, first_seen_at TIMESTAMP_NTZ, last_seen_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ"


def lifecycle_table(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """The life-cycle table that ``stream_lifecycle`` keeps, in buckets by company."""
    return BucketTable(spark, f"{path}/table", KEYS, f"{_JOBS}, event STRING", buckets, ["company_id"])


def stream_lifecycle(listing: DataFrame, path: str, companies: DataFrame | None = None, buckets: int = 64, most: int = 8, **trigger) -> StreamingQuery:
    """What each listing batch (company_id, external_id, title, listed_at) changes, under path/out; keeps the table as a log.

    A batch is a run at its newest listed_at: listed rows are new, seen or reopened, and a company in the batch closes
    what it no longer lists. A batch must hold whole listings of its companies; an empty one changes nothing. It reads
    the buckets of its companies only and adds the changed rows to them; a bucket of more than ``most`` folders is
    rewritten as one. With companies (id, ats), path/totals/batch=n holds the totals ledger after batch n, which reads
    the changes and the ledger before only. The table's manifest names the newest batch that it holds: a repeated batch
    before that point overwrites its own files, after it there is nothing left to do.
    """
    spark = listing.sparkSession
    table = lifecycle_table(spark, path, buckets)

    def each(batch: DataFrame, n: int) -> None:
        note = table.manifest()["note"]
        if note.get("batch", -1) >= n:
            return
        batch = batch.persist()
        try:
            now, touched = batch.agg(F.max("listed_at").cast("string"), F.collect_set(table.bucket())).first()
            if now is None:
                return
            known = table.read(only=touched).drop("event")
            lifecycle_changes(known, batch, now).write.mode("overwrite").parquet(f"{path}/out/batch={n}")
        finally:
            batch.unpersist()
        changes = spark.read.schema(table.schema).parquet(f"{path}/out/batch={n}")
        if companies is not None:
            before = spark.read.schema(LEDGER).parquet(f"{path}/totals/batch={note['batch']}") if "batch" in note else empty(spark, LEDGER)
            totals_ledger(before, changes, companies, now).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals/batch={n}")
        version = table.append(changes, {"batch": n, "as_of": now})["version"]
        if table.compact(most)["version"] > version:
            table.vacuum(keep=most)

    return listing.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def stream_totals(spark: SparkSession, path: str, companies: DataFrame) -> DataFrame:
    """The totals of each source after the newest batch of a ``stream_lifecycle`` with companies."""
    note = lifecycle_table(spark, path).manifest()["note"]
    ledger = spark.read.schema(LEDGER).parquet(f"{path}/totals/batch={note['batch']}") if note else empty(spark, LEDGER)
    return totals_of_ledger(ledger, companies, note.get("as_of", "1970-01-01 00:00:00"))


def match_log(spark: SparkSession, path: str, buckets: int = 64) -> BucketTable:
    """The pairs that ``stream_incremental_match`` has given, in buckets by job."""
    return BucketTable(spark, f"{path}/known", ["campaign", "job"], "campaign LONG, job LONG", buckets, ["job"])


def stream_incremental_match(postings: DataFrame, campaigns: DataFrame, path: str, k: int, buckets: int = 64, most: int = 8, **trigger) -> StreamingQuery:
    """The k nearest postings (item, vector) of a batch for each standing campaign (query, vector), under path/out.

    A pair is given once; ranks are those inside the batch. Known pairs are a log in buckets by job: a batch reads the
    buckets of the jobs that it found, adds what is new, and rewrites a bucket only when it consists of more than ``most``
    folders. A batch that is repeated after its pairs are in the log has nothing left to do.
    """
    spark = postings.sparkSession
    table = match_log(spark, path, buckets)

    def each(batch: DataFrame, n: int) -> None:
        if table.manifest()["note"].get("batch", -1) >= n:
            return
        out = f"{path}/out/batch={n}"
        found = vector_topk_many(batch, campaigns, k).select(F.col("query").alias("campaign"), F.col("item").alias("job"), F.col("similarity").alias("score"))
        found = found.persist()
        try:
            incremental_match(found, table.read(only=table.touched(found))).write.mode("overwrite").parquet(out)
        finally:
            found.unpersist()
        new = spark.read.parquet(out).select("campaign", "job")
        version = table.append(new, {"batch": n})["version"]
        if table.compact(most)["version"] > version:
            table.vacuum(keep=most)

    return postings.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
