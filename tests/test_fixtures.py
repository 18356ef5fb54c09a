"""Cases whose results are known by reading: markup, pay, places, rankings; and operators against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import analytics, evaluation, filters, lifecycle, text
from hirelake.sources.postings import replay_postings
from hirelake.sources.tables import merge_version, read_version, write_version


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", column.alias("out")).orderBy("i").collect()]


def test_markup(spark):
    cases = {
        "&lt;p&gt;A &amp; B&lt;/p&gt;": "A & B",
        "<p>x</p><script>bad()</script><p>y</p>": "x\ny",
        "a<br/>b<BR>c": "a\nb\nc",
        "see [https://h/x.png] now": "see now",
        "p1" + "\n" * 5 + "p2": "p1\n\np2",
        "it&#39;s": "it s",
        None: None,
        "<b>x</b>y&mdash;z\u00a0!": "xy—z !",
        "": "",
    }
    assert one(spark, list(cases), text.clean_html("v")) == list(cases.values())


def test_pay(spark):
    cases = {"$120K - $180K": (120000, 180000, "USD", None), "$50/hour": (50, 50, "USD", "hour"), "€90K – €120K": (90000, 120000, "EUR", None), "120,000 GBP per year": (120000, 120000, "GBP", "year"), "300K to 100K USD": (None, None, "USD", None), "Competitive": (None,) * 4, "": (None,) * 4, None: (None,) * 4}
    cases |= {"120,000 CAD per year": (120000, 120000, "CAD", "year"), "EUR 50 / £40": (50, 40, "GBP", "hour"), "EUROPE 50": (50, 50, None, "hour"), "$50 to $10 per hour": (None, None, "USD", "hour"), "$2000 / hr": (2000, 2000, "USD", "hour"), "90,000/yr": (90000, 90000, None, "year"), "$90,000 /yr": (90000, 90000, "USD", None)}
    cases |= {"chf 1.2M annually": (1200000, 1200000, "CHF", "year"), "0 - 100 NOK": (0, 100, "NOK", "hour"), "inr 5 then usd": (5, 5, "INR", "hour"), "1.2.3 or 4000": (4000, 4000, None, None), "¥ 5,000\u00a0k": (5000000, 5000000, "JPY", None), "Competitive $": (None, None, "USD", None), "hourly": (None, None, None, "hour"), "semihourly SEK_9000": (9000, 9000, None, None), "per  Hour 30 - 40 Dkk": (30, 40, "DKK", "hour"), "10 to 4": (None, None, None, "hour"), " \u00a0 ": (None,) * 4}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, v string")
    got = [(r.comp_min, r.comp_max, r.comp_currency, r.comp_interval) for r in text.compensation_table(rows, "i", "v").orderBy("i").collect()]
    assert got == list(cases.values())


PLACES = [("Dallas, TX", "Texas", True), ("Remote (US)", "United States", True), ("campus office", "US", False), ("London, UK", "united kingdom", True), ("London, Scotland", "UK", True), ("Berlin", "", True), (None, "Berlin", False), ("", "Berlin", False), (None, " ", True), ("a (c) b", "(c", True), ("Paris", "\\E.*", False), ("Boise, ID", "idaho", True), ("solid", "id", False)]


def test_places(spark):
    rows = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(PLACES)] + [(0, PLACES[0][0])], "i int, place string")
    many = {(r.query, r.i) for r in filters.location_matches(rows, "i", "place", [q for _, q, _ in PLACES]).collect()}
    for i, (_, query, want) in enumerate(PLACES):
        kept = {r.i for r in filters.location_match(rows, "place", query).collect()}
        assert (i in kept) == want and ((query, i) in many) == want
        assert {i for q, i in many if q == query} == kept


def test_rankings(spark):
    gains = spark.createDataFrame([("q", i, float(g)) for i, g in enumerate([3, 2, 1, 0])] + [("z", 0, 0.0)], "query string, item int, gain double")
    scores = [("q", "ideal", i, 9.0 - i) for i in range(4)] + [("q", "back", i, float(i)) for i in range(4)] + [("q", "null", 0, None), ("q", "null", 1, 1.0), ("z", "ideal", 0, 1.0)]
    got = {(r.query, r.method): r.ndcg for r in evaluation.ndcg_at_k(spark.createDataFrame(scores, "query string, method string, item int, score double"), gains, 3).collect()}
    assert got["q", "ideal"] == 1 and got["q", "back"] < 1 and got["z", "ideal"] == 0 and got["q", "null"] < 1
    judged = spark.createDataFrame([("q", 1, "a", 4.0), ("q", 1, "b", 2.0), ("q", 2, "a", 5.0), ("q", 3, "a", None)], "query string, item int, judge string, gain double")
    assert {r.item: r.gain for r in evaluation.judge_ensemble(judged).collect()} == {1: 3.0, 2: 5.0, 3: None}
    assert [r.spearman for r in evaluation.judge_agreement(judged, "a", "b").collect()] == [0.0]


@pytest.mark.parametrize("days", [1, 4, 1000])
def test_rolling_rate_over_ranges_of_time(spark, days):
    rng = random.Random(days)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, 9]), rng.choice([200, 200, 429, 403, None]), None if i % 50 == 7 else t0 + dt.timedelta(hours=int(rng.expovariate(1 / 200)))) for i in range(400)]
    probes = spark.createDataFrame(rows, "id long, company_id int, http_status int, created_at timestamp_ntz")
    companies = spark.createDataFrame([(1, "a", "x", True), (2, "b", "y", True)], "id int, ats string, slug string, enabled boolean")
    want = {}
    for ats, company in (("a", 1), ("b", 2)):
        own = sorted((r for r in rows if r[1] == company), key=lambda r: (r[3] is not None, r[3] or t0, r[0]))
        for k, r in enumerate(own):
            last = [x[2] in (403, 429) for x in own[max(0, k - 6) : k + 1]]
            rate = round(sum(last) / len(last), 4)
            want[ats, r[0]] = (rate, None if len(last) < 7 else "throttle" if rate > 0.05 else "recover" if rate < 0.01 else None)
    got = analytics.rolling_block_rate(probes, companies, 7, days).collect()
    assert len(got) == len(want) and {(r.ats, r.id): (r.rate, r.flag) for r in got} == want


def test_allocation_goes_round_the_groups(spark):
    rng = random.Random(4)
    for sizes, target in [({"a": 50, "b": 3, "c": 1}, 10), ({"a": 5, "b": 5}, 100), ({"a": 1, "b": 1, "c": 1, "d": 90}, 7), ({x: rng.randint(1, 9) for x in "abcdefg"}, 11)]:
        rows = [(g, i) for g, n in sizes.items() for i in range(n)]
        quota = {g: min(n, target * n // len(rows)) for g, n in sizes.items()}
        short = min(target, len(rows)) - sum(quota.values())
        while short:
            for g in sorted(sizes):
                if short and quota[g] < sizes[g]:
                    quota[g], short = quota[g] + 1, short - 1
        got = analytics.proportional_allocate(spark.createDataFrame(rows, "g string, i int"), "g", target, ["i"])
        assert sorted(tuple(r) for r in got.collect()) == sorted((g, i) for g, i in rows if i < quota[g])
        assert analytics.proportional_allocate(spark.createDataFrame([], "g string, i int"), "g", target, ["i"]).count() == 0


def test_a_listing_keeps_other_columns_and_counts_repeats_once(spark):
    jobs = spark.createDataFrame([(1, "x", "X", "keep", None, None, None), (1, "y", "Y", None, None, None, None)], "company_id int, external_id string, title string, note string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, closed_at timestamp_ntz")
    listing = spark.createDataFrame([(1, "x", None, 5), (1, "x", "X2", 1), (2, "n", "N", 1)], "company_id int, external_id string, title string, other int")
    got = lifecycle.lifecycle_merge(jobs, listing, "2024-01-01 00:00:00")
    assert got.columns == jobs.columns and sorted((r.external_id, r.title, r.note) for r in got.collect()) == [("n", "N", None), ("x", "X2", "keep"), ("y", "Y", None)]
    assert lifecycle.lifecycle_merge(jobs.where("false"), listing.where("false"), "2024-01-01 00:00:00").count() == 0


def test_an_unchanged_payload_is_not_archived_again(spark):
    empty = spark.createDataFrame([], "company_id int, content_hash string, body string, created_at timestamp_ntz, last_seen_at timestamp_ntz")
    bodies = ['{"a": 1, "b": [1, 2]}', '{"b":[1,2],"a":1}', "{not json", None, '{"a": 1, "b": [1, 2]}']
    archive = empty
    for day, body in enumerate(bodies, 1):
        archive = lifecycle.raw_archive_ingest(archive, spark.createDataFrame([(7, body)], "company_id int, body string"), f"2024-01-0{day} 00:00:00")
    rows = sorted((r.body, r.created_at.day, r.last_seen_at.day) for r in archive.collect())
    assert rows == [(bodies[0], 1, 5), (bodies[2], 3, 3)]
    assert [r.body for r in lifecycle.archive_replay(archive, "2024-01-02 00:00:00").collect()] == [bodies[0]]


def test_versions_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        assert write_version(spark.range(n), path) == n + 1
    assert read_version(spark, path).count() == 3 and read_version(spark, path, 3).count() == 2
    with pytest.raises(Exception, match="version=1"):
        read_version(spark, path, 1)
    with pytest.raises(FileNotFoundError):
        read_version(spark, path + "-none")


def test_titles_come_back_to_repeated_and_null_rows(spark):
    rows = spark.createDataFrame([(1, "Welder", "x"), (2, "Welder", "x"), (3, None, "y"), (4, " ", "y")], "id int, title string, tag_x string")
    got = {r.id: (r.tag_family, r.tag_x, r.tag_by) for r in text.tag_titles(rows).collect()}
    assert got == {1: ("skilled_trades", "x", "rules"), 2: ("skilled_trades", "x", "rules"), 3: (None, "y", "low"), 4: (None, "y", "low")}
    assert text.tag_titles(rows.where(F.lit(False))).count() == 0


def test_batches_merge_into_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 9), (3, "d", 9)], []):
        merge_version(path, spark.createDataFrame(rows, "id int, x string, y int"), ["id"], ["x"])
    assert sorted(map(tuple, read_version(spark, path).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", None)]


@pytest.mark.parametrize("shards", [1, 4, 7, 60, 61])
def test_shard_ranges_are_disjoint_and_complete(spark, shards):
    got = text.shard_ranges(spark.createDataFrame([(i,) for i in range(500)] + [(None,)], "id long"), shards).collect()
    for r in got:
        if r.id is not None:
            assert [i for i in range(shards) if i * 60 // shards <= r.shard < (i + 1) * 60 // shards] == [r.owner]
    assert len(got) == 501 and [r.owner for r in got if r.id is None] == [None]


def test_archived_payloads_are_mapped_again(spark):
    body = '{"jobs": [{"id": 5, "title": "T", "location": {"name": "Berlin"}}]}'
    archive = spark.createDataFrame([("greenhouse", 7, "h1", body, dt.datetime(2024, 1, 1)), ("greenhouse", 7, "h2", "{}", dt.datetime(2024, 1, 9))], "ats string, company_id long, content_hash string, body string, created_at timestamp_ntz")
    assert [(r.external_id, r.title) for r in replay_postings(archive, "2024-01-05 00:00:00").collect()] == [("5", "T")]
    assert replay_postings(archive, "2024-01-10 00:00:00").count() == replay_postings(archive, "2023-01-01 00:00:00").count() == 0
