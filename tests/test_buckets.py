"""Tables in buckets: what a merge rewrites, what readers see, and what a dead or second writer leaves."""

import random

import pytest

from hirelake.sources.buckets import BucketTable, Conflict

SCHEMA = "k LONG, part STRING, v LONG, w STRING"


def content(df):
    return {(r.k, r.part): (r.v, r.w) for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, str(tmp_path / "t"), ["k", "part"], SCHEMA, buckets=16, bucket_by=["k"])


def test_a_merge_rewrites_only_what_it_touches(spark, table):
    assert table.read().count() == 0 and table.versions() == []
    first = table.merge(spark.range(4000).selectExpr("id AS k", "'a' AS part", "id * 2 AS v", "'old' AS w"))
    assert len(first["parts"]) == 16
    few = spark.createDataFrame([(i, "a", -1, "never seen") for i in range(40)] + [(1, "b", 5, "new"), (None, None, 7, "null key")], SCHEMA)
    in_few = few.where(table.bucket().isin([3, 5]) | few.k.isNull() | (few.part == "b"))  # a hundredth of the keys, in few buckets
    second = table.merge(in_few, ["v"])
    changed = {b for b in second["parts"] if second["parts"][b] != first["parts"].get(b)}
    assert changed == set(map(str, table.touched(in_few))) and len(changed) <= 4
    want = {(i, "a"): (i * 2, "old") for i in range(4000)}
    old = dict(want)
    for r in in_few.collect():
        want[r.k, r.part] = (r.v, want[r.k, r.part][1] if (r.k, r.part) in want else None)
    assert content(table.read()) == want
    assert content(table.read(1)) == old  # readers of the version before
    assert table.merge(in_few.where("false"))["version"] == 2


def test_dead_and_second_writers(spark, table, monkeypatch):
    one = spark.createDataFrame([(1, "a", 1, "x"), (2, "a", 2, "y")], SCHEMA)
    table.merge(one)
    before = content(table.read())

    def die(manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", die)
        with pytest.raises(RuntimeError):
            table.merge(spark.createDataFrame([(1, "a", 9, "z")], SCHEMA))
    assert content(table.read()) == before and table.versions() == [1]
    other = BucketTable(spark, table.path, table.keys, SCHEMA, buckets=16, bucket_by=["k"])
    stale = table.manifest()
    other.merge(spark.createDataFrame([(3, "a", 3, "z")], SCHEMA))
    with pytest.raises(Conflict):
        table._commit({**stale, "version": 2})
    assert content(table.read()) == {**before, (3, "a"): (3, "z")}
    gone = table.vacuum(keep=1)
    assert len(gone) >= 1 and content(table.read()) == {**before, (3, "a"): (3, "z")} and table.versions() == [2]


def test_a_log_of_changes_and_its_compaction(spark, table):
    rng, want = random.Random(3), {}
    table.merge(spark.createDataFrame([(i, "a", i, "w") for i in range(200)], SCHEMA))
    want.update({(i, "a"): (i, "w") for i in range(200)})
    for n in range(6):
        rows = {(rng.randrange(260), rng.choice("ab")): (rng.randrange(1000), f"batch {n}") for _ in range(30)}
        table.append(spark.createDataFrame([(*k, *v) for k, v in rows.items()], SCHEMA), {"batch": n})
        want.update(rows)
        assert content(table.read()) == want
    longest = max(map(len, table.manifest()["parts"].values()))
    assert longest > 3 and table.manifest()["note"] == {"batch": 5}
    after = table.compact(3)
    assert max(map(len, after["parts"].values())) <= 3 and after["note"] == {"batch": 5}
    assert content(table.read()) == want and content(table.read(only=table.touched(spark.createDataFrame([(5, "a", 0, "")], SCHEMA))))[5, "a"] == want[5, "a"]
    assert table.compact(100)["version"] == after["version"]
