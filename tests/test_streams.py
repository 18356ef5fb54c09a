"""Streams over several micro-batches, with late, repeated and empty input, against what they must add up to."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hirelake.streaming import operators as S
from hirelake.streaming.batches import results

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes each list of rows as one file, and gives the stream that reads one file a batch."""

    def make(batches, schema):
        path = str(tmp_path / "in")
        stream = None
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return stream, str(tmp_path / "out")

    return make


def test_archive_keeps_a_return_to_old_content(spark, feed):
    stream, path = feed([[(1, 1, at(0), "a"), (1, 2, at(1), "b")], [(1, 3, at(2), "b"), (2, 4, at(2), None)], [(1, 5, at(3), "a"), (2, 6, at(3), ""), (None, 7, at(3), "z")]], "company_id LONG, id LONG, fetched_at TIMESTAMP_NTZ, body STRING")
    S.stream_archive_dedup(stream, path).awaitTermination()
    assert sorted(r.id for r in results(spark, path).collect()) == [1, 2, 4, 5]
    assert spark.read.format("statestore").load(f"{path}/checkpoint").count() == 2


def turns_of(rows, n=20):
    """By hand: a source is throttled above 5 % of blocks in a full window, and recovers below 1 %."""
    out, throttled = [], False
    for i in range(n - 1, len(rows)):
        rate = sum(r[3] in (403, 429) for r in rows[i - n + 1 : i + 1]) / n
        if rate > 0.05 and not throttled or rate < 0.01 and throttled:
            throttled = not throttled
            out.append((rows[i][0], rows[i][1], round(rate, 4), "throttle" if throttled else "recover"))
    return out


def test_rolling_turns_over_batches_and_restarts(spark, feed):
    rows = [("s", i, at(i), 429 if i in (3, 21, 25, 60, 61, 62, 120, 121) else 200) for i in range(150)]
    other = [("t", 1000 + i, at(i), 403 if i % 7 == 0 else None) for i in range(25)]
    batches = [rows[:7], rows[7:30][::-1] + other[:3], rows[30:31], other[3:] + [(None, 1, at(1), 429)], rows[31:90], rows[90:]]
    want = sorted(turns_of(rows) + turns_of(other))
    assert [t for *_, t in turns_of(rows)] == ["throttle", "recover"] * 3
    stream, path = feed(batches, "ats STRING, id LONG, created_at TIMESTAMP_NTZ, http_status INT")
    S.stream_rolling_block(stream, path).awaitTermination()
    assert sorted((r.ats, r.id, r.rate, r.turn) for r in results(spark, path).collect()) == want
    state = spark.read.format("statestore").option("stateVarName", "outcomes").load(f"{path}/checkpoint")
    assert sorted((r.key.ats, len(r.value.ring)) for r in state.select("key", "value").collect()) == [("s", 19), ("t", 19)]


def test_rolling_goes_on_after_a_restart(spark, tmp_path):
    rows = [("s", i, at(i), 429 if i in (21, 25, 60, 61) else 200) for i in range(100)]
    schema, path = "ats STRING, id LONG, created_at TIMESTAMP_NTZ, http_status INT", str(tmp_path / "in")
    for begin in range(0, 100, 17):  # the query ends after each file, and starts again
        spark.createDataFrame(rows[begin : begin + 17], schema).coalesce(1).write.mode("append").parquet(path)
        S.stream_rolling_block(spark.readStream.schema(schema).parquet(path), str(tmp_path / "out")).awaitTermination()
    assert sorted((r.ats, r.id, r.rate, r.turn) for r in results(spark, str(tmp_path / "out")).collect()) == sorted(turns_of(rows))


def test_stale_runs_fail_once(spark, feed):
    stream, path = feed([[("a", at(0), False), ("b", at(1), False)], [("b", at(30), True), ("c", at(40), False), (None, at(2), False), ("z", None, False)], [("d", at(60), False)], [("e", at(90), None), ("f", at(85), True), ("f", at(84), False)], [("a", at(91), False), ("d", at(105), False)], [("g", at(140), True)]], "run_id STRING, at TIMESTAMP_NTZ, ended BOOLEAN")
    S.stream_stale_runs(stream, path).awaitTermination()
    # e began exactly 50 minutes before the clock, a came back as a new run, and d's start is its first event
    assert sorted((r.run_id, r.started_at) for r in results(spark, path).collect()) == [("a", at(0)), ("a", at(91)), ("c", at(40)), ("d", at(60)), ("e", at(90))]
    assert spark.read.format("statestore").option("stateVarName", "run").load(f"{path}/checkpoint").select("key").collect()[0].key.run_id == "g"


def test_lifecycle_closes_and_reopens(spark, feed):
    stream, path = feed([[(1, "x", "X", at(0)), (1, "y", "Y", at(0)), (2, "z", "Z", at(0))], [(1, "x", "X", at(9))], [(1, "y", "Y2", at(20)), (1, "y", "Y2", at(20))]], "company_id LONG, external_id STRING, title STRING, listed_at TIMESTAMP_NTZ")
    S.stream_lifecycle(stream, path).awaitTermination()
    got = {r.external_id: (r.title, r.first_seen_at, r.last_seen_at, r.closed_at) for r in S.lifecycle_table(spark, path).read().collect()}
    assert got == {"x": ("X", at(0), at(9), at(20)), "y": ("Y2", at(0), at(20), None), "z": ("Z", at(0), at(0), None)}
    said = spark.read.parquet(f"{path}/out")
    assert sorted((r.batch, r.external_id, r.event) for r in said.collect()) == [(0, "x", "new"), (0, "y", "new"), (0, "z", "new"), (1, "x", "seen"), (1, "y", "closed"), (2, "x", "closed"), (2, "y", "reopened")]


def test_lifecycle_log_and_totals_equal_a_recount(spark, tmp_path):
    from hirelake.operators.analytics import totals_by_source

    rng, jobs = random.Random(4), {}
    companies = spark.createDataFrame([(i, f"s{i % 3}", f"c{i}", True) for i in range(12)] + [(99, "none", "c", True)], "id LONG, ats STRING, slug STRING, enabled BOOLEAN")
    schema, path = "company_id LONG, external_id STRING, title STRING, listed_at TIMESTAMP_NTZ", str(tmp_path / "t")
    for n in range(10):
        now = at(n * 60 * 24 * 4)  # four days a batch, so that postings leave the trailing windows
        listed = {(c, str(rng.randrange(15))): f"title {rng.randrange(2)}" for c in rng.sample(range(13), 5) for _ in range(rng.randint(1, 12))}  # company 12 is unknown
        spark.createDataFrame([(*k, title, now) for k, title in listed.items()], schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        S.stream_lifecycle(spark.readStream.schema(schema).parquet(f"{path}/in"), path, companies, buckets=8, most=2).awaitTermination()
        before = dict(jobs)
        for k, title in listed.items():
            jobs[k] = (title, jobs[k][1] if k in jobs else now, now, None)
        for k, (title, first, last, closed) in before.items():
            if k[0] in {c for c, _ in listed} and k not in listed and closed is None:
                jobs[k] = (title, first, last, now)
        if n % 3 == 0 or n == 9:
            table = S.lifecycle_table(spark, path).read()
            assert {(r.company_id, r.external_id): (r.title, r.first_seen_at, r.last_seen_at, r.closed_at) for r in table.collect()} == jobs
            want = totals_by_source(companies, table, str(now))
            assert sorted(map(tuple, S.stream_totals(spark, path, companies).collect())) == sorted(map(tuple, want.collect()))
    changed = {k for k in jobs if jobs[k] != before.get(k)}
    assert {(r.company_id, r.external_id) for r in spark.read.parquet(f"{path}/out").where("batch = 9").collect()} == changed


def test_lifecycle_deals_rows_by_key_once(spark, tmp_path):
    """The log, the listing and nothing else is shuffled by key, none of it put together (and sorted) before that."""
    from hirelake.operators.lifecycle import lifecycle_changes

    table = S.lifecycle_table(spark, str(tmp_path), 1)
    row = lambda c, e, n, closed=None: (c, e, "T", at(0), at(n), closed, "seen")
    table.append(spark.createDataFrame([row(1, "x", 0), row(1, "y", 0), row(1, None, 0), row(None, "x", 0), row(2, "x", 0), row(3, "x", 0), row(3, "y", 0, at(0))], table.schema))
    table.append(spark.createDataFrame([row(1, "y", 1), row(3, "x", 1)], table.schema))
    listing = spark.createDataFrame([(1, "x", "T2", at(9)), (1, "x", "T1", at(9)), (1, None, "T", at(9)), (None, "x", "T", at(9)), (3, "y", "T", at(9))], "company_id LONG, external_id STRING, title STRING, listed_at TIMESTAMP_NTZ")
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        changes = lifecycle_changes(table.read().drop("event"), listing, str(at(9)))
        plan = changes._jdf.queryExecution().sparkPlan().toString() + changes._jdf.queryExecution().executedPlan().toString()
        # null keys meet nothing: such a listed row is new; 2 was not asked, and (null, x) belongs to no company
        want = [(1, "x", "T2", at(9), None, "seen"), (1, "y", "T", at(1), at(9), "closed"), (1, None, "T", at(0), at(9), "closed"), (1, None, "T", at(9), None, "new"), (None, "x", "T", at(9), None, "new"), (3, "x", "T", at(1), at(9), "closed"), (3, "y", "T", at(9), None, "reopened")]
        key = lambda r: tuple(map(str, r))
        assert sorted(((r.company_id, r.external_id, r.title, r.last_seen_at, r.closed_at, r.event) for r in changes.collect()), key=key) == sorted(want, key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)
    by_key = [line for line in plan.splitlines() if "Exchange hashpartitioning(company_id" in line and "external_id" in line]
    assert len({line.split("hashpartitioning")[1].split(")")[0] for line in by_key}) == 2  # a plan may be told twice
    assert all("REPARTITION_BY_COL" in line for line in by_key)


def test_no_rows_are_planned_as_none(spark, tmp_path):
    """An empty list of rows would be read by Python in tasks, in every run that begins without a table."""
    rows = S.lifecycle_table(spark, str(tmp_path)).read()
    assert rows.count() == 0 and rows.schema.simpleString() == S.lifecycle_table(spark, str(tmp_path)).schema.simpleString()
    assert "LocalTableScan" in rows._jdf.queryExecution().executedPlan().toString()


def test_matches_come_once(spark, feed):
    stream, path = feed([[(1, [1.0, 0.0]), (2, [0.0, 1.0])], [(1, [1.0, 0.0]), (3, [1.0, 1.0])]], "item LONG, vector ARRAY<FLOAT>")
    campaigns = spark.createDataFrame([(7, [1.0, 0.0])], "query LONG, vector ARRAY<FLOAT>")
    S.stream_incremental_match(stream, campaigns, path, 2).awaitTermination()
    assert sorted((r.job, r.rank) for r in results(spark, path).collect()) == [(1, 1), (2, 2), (3, 1)]
    log = S.match_log(spark, path)
    assert sorted(r.job for r in log.read().collect()) == [1, 2, 3]
    first, second = log.manifest(1)["parts"], log.manifest()["parts"]
    assert log.versions() == [1, 2] and all(second[b][: len(dirs)] == dirs for b, dirs in first.items())  # nothing was rewritten


def test_late_facts_and_sliding_windows(spark, feed, tmp_path):
    stream, path = feed([[(1, 1, at(5), True, 200, 10)], [(2, 1, at(300), True, 200, 10)], [(6, 1, at(301), True, 200, 10)], [(3, 1, at(6), True, 200, 10)], [(4, 9, at(400), True, 200, 1)], [(5, 1, None, True, 200, 1)]], "id LONG, company_id LONG, created_at TIMESTAMP_NTZ, schema_ok BOOLEAN, http_status INT, latency_ms INT")
    companies = spark.createDataFrame([(1, "s")], "id LONG, ats STRING")
    out = S.stream_source_health(stream, companies, "1 hour", "30 minutes", "10 minutes")
    out.writeStream.format("parquet").option("checkpointLocation", path + "-c").option("path", path).trigger(availableNow=True).start().awaitTermination()
    got = {r.window_start: r.probes for r in spark.read.parquet(path).collect()}
    assert got == {at(-30): 1, at(0): 1, at(270): 2, at(300): 2}


def test_first_seen_over_batches(spark, feed):
    stream, path = feed([[(1, "x", at(0)), (1, "x", at(1))], [(1, "x", at(2)), (2, "x", at(3))]], "company_id LONG, external_id STRING, listed_at TIMESTAMP_NTZ")
    S.stream_first_seen(stream, "1 hour").writeStream.format("parquet").option("checkpointLocation", path + "-c").option("path", path).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.company_id, r.external_id) for r in spark.read.parquet(path).select("company_id", "external_id", F.lit(1)).collect()) == [(1, "x"), (2, "x")]
