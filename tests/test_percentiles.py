"""Exact percentiles by bins, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators.analytics import percentiles, source_health, source_health_spread

SHARES = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def interpolated(values, share):
    values, at = sorted(values), (len(values) - 1) * share
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def test_percentiles_of_any_values(spark):
    rng = random.Random(3)
    groups = {
        "one": [7],
        "two": [1, 1000],
        "ties": [5] * 900 + [6] * 100,
        "signs": [rng.randint(-40, 40) for _ in range(301)],
        "wide": [rng.choice([-1, 1]) * 2 ** rng.randint(0, 50) for _ in range(400)],
        "near": [4096 + rng.randint(0, 3) for _ in range(1000)],
        "parts": [rng.random() * 10 ** rng.randint(-9, 9) for _ in range(500)],
        None: [rng.randint(0, 500) for _ in range(77)],
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None), ("empty", None)]
    counted = spark.createDataFrame(data, "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r.g: r for r in percentiles(counted, "g", "v", "n", SHARES).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for name, share in SHARES.items():
            assert got[g][name] == pytest.approx(interpolated(values, share), rel=1e-12), (g, name)
    assert percentiles(counted.where("false"), "g", "v", "n", SHARES).count() == 0


def test_a_source_without_latency_stays(spark):
    probes = spark.createDataFrame(
        [(1, "2024-01-02 00:00:00", 200, True, None), (2, "2024-01-02 00:00:00", 403, False, 10), (2, "2024-01-02 00:00:00", None, None, 20), (3, "2024-01-02 00:00:00", 500, False, 31)],
        "company_id long, created_at string, http_status int, schema_ok boolean, latency_ms int",
    ).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    companies = spark.createDataFrame([(1, "a", "x", True), (2, "b", "y", True), (3, None, "z", True)], "id long, ats string, slug string, enabled boolean")
    whole, got = ({r.ats: r for r in f(probes, companies, "7 DAY", "2024-01-03 00:00:00").collect()} for f in (source_health, source_health_spread))
    assert got == whole
    assert {k: (r.probes, r.ok, r.blocked, r.errored, r.avg_latency, r.p50_latency, r.p95_latency) for k, r in got.items()} == {
        "a": (1, 1, 0, 0, None, None, None),
        "b": (2, 0, 1, 0, 15.0, 15.0, 20.0),  # 19.5 goes to the even neighbour
        None: (1, 0, 0, 1, 31.0, 31.0, 31.0),
    }


def test_values_are_ordered_within_a_bin_only(spark):
    counted = spark.range(100_000).select(F.lit("a").alias("g"), F.col("id").alias("v"), F.lit(1).cast("long").alias("n"))
    df = percentiles(counted, "g", "v", "n", {"p50": 0.5, "p95": 0.95})
    assert [tuple(r) for r in df.collect()] == [("a", 49999.5, pytest.approx(94999.05))]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan
