"""Interval joins over windows from a second to years, and the plans of the headline queries."""

import datetime as dt
import random
import re

import pytest

from hirelake.operators.joins import _binned, interval_join
from hirelake.plans import registry

T0 = dt.datetime(1969, 12, 1)


@pytest.mark.parametrize("closed", ["both", "left"])
def test_windows_of_any_length(spark, closed):
    rng = random.Random(6)
    time = lambda: T0 + dt.timedelta(seconds=rng.random() * 86400 * 365 * 3)
    points = [(i, time()) for i in range(300)] + [(900, None)]
    windows = [(i, s, s + dt.timedelta(seconds=8**e + d)) for i, (s, e, d) in enumerate((rng.choice(points[:300])[1], rng.randint(0, 9), rng.choice([-1, 0, 0.5])) for _ in range(200))]
    windows += [(500, points[3][1], points[3][1]), (501, points[4][1], points[3][1]), (502, None, points[3][1]), (503, points[3][1], None), (504, T0, T0 + dt.timedelta(days=9999))]
    p, w = spark.createDataFrame(points, "p long, at timestamp_ntz"), spark.createDataFrame(windows, "w long, s timestamp_ntz, e timestamp_ntz")
    want = {(i, j) for i, t in points for j, s, e in windows if t and s and e and s <= t and (t <= e if closed == "both" else t < e)}
    got = interval_join(p, w, "at", "s", "e", closed=closed)
    assert sorted((r.p, r.w) for r in got.collect()) == sorted(want)
    assert got.columns == ["p", "at", "w", "s", "e"]
    assert interval_join(p, w.where("false"), "at", "s", "e").count() == 0


def test_a_window_is_in_two_bins_at_most_however_long(spark):
    rng = random.Random(7)
    starts = [T0 + dt.timedelta(seconds=rng.random() * 86400 * 3650) for _ in range(500)]
    windows = spark.createDataFrame([(i, s, s + dt.timedelta(seconds=rng.choice([0, 1, 8**9 - 1, 8**9, rng.random() * 8 ** rng.uniform(0, 10)]))) for i, s in enumerate(starts)], "w long, s timestamp_ntz, e timestamp_ntz")
    bins = {r.w: r["count"] for r in _binned(windows, "s", "e").groupBy("w").count().collect()}
    assert len(bins) == 500 and set(bins.values()) == {1, 2}


def exchanges(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan)), "NestedLoop" in plan or "Cartesian" in plan


@pytest.mark.parametrize(("name", "most"), [("recent_cycles", 3), ("lexical_search", 1), ("vector_topk_many", 1), ("totals_by_source", 2), ("source_health", 1), ("unique_active", 1)])
def test_shuffles_of_headline_plans(spark, name, most):
    found, nested = exchanges(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert found <= most and not nested
