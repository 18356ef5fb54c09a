"""Searches against plain Python: several blocks of queries, unusable vectors, ties, nulls, repeated and empty input."""

import math
import random

import pytest

from hirelake.operators import blocks, filters, lexical, retrieval


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


@pytest.mark.parametrize("most", [10_000, 5])
def test_nearest_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    rng = random.Random(1)
    vectors = {i: [float(rng.randint(-2, 2)) for _ in range(3)] for i in range(80)}
    odd = [(100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    items = spark.createDataFrame([*vectors.items(), *odd], "item long, vector array<double>").repartition(3)
    queries = spark.createDataFrame([*[(i, v) for i, v in vectors.items() if i % 7 == 0], (103, None)], "query long, vector array<double>")
    good = {i: v for i, v in vectors.items() if any(v)}
    want = set()
    for q, v in good.items():
        if q % 7 == 0:
            near = sorted((-round(cosine(v, w), 4) + 0.0, i) for i, w in good.items())[:5]
            want |= {(q, i, -s + 0.0, k) for k, (s, i) in enumerate(near, 1)}
    assert {tuple(r) for r in retrieval.vector_topk_many(items, queries, 5).collect()} == want
    assert retrieval.vector_topk_many(items.where("false"), queries, 5).count() == 0
    assert retrieval.vector_topk_many(items, queries.where("false"), 5).count() == 0


def test_clusters_are_passed_over_and_nothing_is_lost():
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    near = lambda n: centres[rng.integers(0, 40, n)] + 0.1 * rng.normal(size=(n, 24))
    unit = lambda x: x / np.sqrt((x * x).sum(1))[:, None]
    for items, queries in ((unit(near(6000)), unit(near(300))), (unit(rng.normal(size=(3000, 24))), unit(rng.normal(size=(300, 24)))), (np.repeat(unit(near(10)), 300, axis=0), unit(near(200)))):
        met, best, plain = [0, 0], blocks.Best(len(queries), 5, 4), blocks.Best(len(queries), 5, 4)
        for at in range(0, len(items), 1500):
            blocks.meet(best, np.arange(at, min(at + 1500, len(items))), items[at : at + 1500], queries, met)
        plain.add(np.arange(len(items)), items @ queries.T)
        assert (best.query == plain.query).all() and (best.item == plain.item).all() and (best.rounded == plain.rounded).all()
        assert met[1] == len(items) * len(queries)
        share = met[0] / met[1]
        assert share < 0.35 if len(items) == 6000 else share <= 1


def test_only_newer_items_are_met(spark):
    import datetime as dt

    day = lambda n: None if n is None else dt.datetime(2024, 1, n)
    items = spark.createDataFrame([(i, [1.0, float(i)], day(d)) for i, d in enumerate([1, 2, 3, None], 1)], "item long, vector array<double>, seen timestamp_ntz")
    queries = spark.createDataFrame([(7, [1.0, 1.0], day(2)), (8, [1.0, 1.0], None), (9, [1.0, 1.0], day(9))], "query long, vector array<double>, ran timestamp_ntz")
    got = retrieval.vector_topk_many(items, queries, 9, ("seen", "ran")).collect()
    assert {(r.query, r.item) for r in got} == {(7, 3), (8, 1), (8, 2), (8, 3), (8, 4)}


def test_labelled_vectors_by_brute_force(spark):
    rng = random.Random(2)
    rows = lambda n, key: [(i, label, [rng.random() for _ in range(4)]) for i in range(n) for label in ("role", "team", "x") if rng.random() < 0.7] + [(0, "role", None)]
    a, b = rows(30, "item"), rows(12, "query")
    a.append((1, "role", [0.5, 0.1, 0.2, 0.9]))  # a label that comes twice
    got = retrieval.field_weighted_similarity(spark.createDataFrame(a, "item long, label string, vector array<double>"), spark.createDataFrame(b, "query long, label string, vector array<double>"), 100)
    want = {}
    for q, lq, v in b:
        for i, li, w in a:
            if lq == li and v and w:
                want.setdefault((q, i), []).append(({"role": 2.0, "team": 1.0}.get(li, 0.5), cosine(v, w)))
    rows = {(r.query, r.item): (r.weighted, r.plain) for r in got.collect()}
    assert rows.keys() == want.keys()
    for k, pairs in want.items():
        assert abs(rows[k][0] - sum(w * s for w, s in pairs) / sum(w for w, _ in pairs)) < 1e-4 and abs(rows[k][1] - sum(s for _, s in pairs) / len(pairs)) < 1e-4


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("mode", ["any", "all"])
def test_words_by_brute_force(spark, monkeypatch, few, mode):
    if few:  # several blocks of queries, segments, and steps of a segment
        monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
        monkeypatch.setattr(lexical, "SEGMENT_ROWS", 7)
        monkeypatch.setattr(lexical, "BLOCK_ROWS", 2)
        monkeypatch.setattr(lexical, "BLOCK", 9)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    docs = [(i, text(rng.randint(0, 12))) for i in range(40)] + [(90, None), (91, ""), (92, "AB, ab")]
    queries = [(i, text(3)) for i in range(8)] + [(8, None), (9, "never")]
    split = {i: (t or "").lower().replace(",", "").split() for i, t in docs}
    n, mean = len(docs), sum(map(len, split.values())) / len(docs)
    want = set()
    for q, t in queries:
        terms = set((t or "").split())
        hits = []
        for i, w in split.items():
            met = [x for x in terms if x in w]
            if met and (mode == "any" or len(met) == len(terms)):
                score = 0
                for x in met:
                    df, tf = sum(x in v for v in split.values()), w.count(x)
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
                hits.append((-round(score, 6), i))
        want |= {(q, i, -s, k) for k, (s, i) in enumerate(sorted(hits)[:4], 1)}
    got = retrieval.lexical_search(spark.createDataFrame(docs, "item long, text string").repartition(3), spark.createDataFrame(queries, "query long, text string"), 4, mode)
    assert {tuple(r) for r in got.collect()} == want
    every = retrieval.lexical_search(spark.createDataFrame(docs, "item long, text string").repartition(3), spark.createDataFrame(queries, "query long, text string"), None, mode)
    assert {(r.query, r.item) for r in every.collect()} >= {w[:2] for w in want}
    assert retrieval.lexical_search(spark.createDataFrame([], "item long, text string"), spark.createDataFrame(queries, "query long, text string"), 4, mode).count() == 0
    assert retrieval.lexical_search(spark.createDataFrame(docs, "item long, text string"), spark.createDataFrame([], "query long, text string"), 4, mode).count() == 0


def test_words_are_cut_as_by_the_pattern():
    import re

    import pyarrow as pa

    rng = random.Random(8)
    texts = [None, "", "İstanbul KELVIN \u212a ẞ", "Ȿɏɐ ÷ × ÿ Ā"] + ["".join(rng.choice("aZ9 é-ÀɏɐȾ語_\n😀ß") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    doc, found = lexical.words(pa.array(texts))
    assert list(zip(doc.tolist(), found.to_pylist())) == [(i, w) for i, t in enumerate(texts) for w in re.findall("[a-z0-9À-ɏ]+", (t or "").lower())]


def test_block_maxima_bound_scores_and_rule_out(spark, tmp_path):
    import numpy as np

    rng = random.Random(9)
    tongues = [[f"{a}{b}" for b in "abcdefghij"] for a in "wxyz"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(tongues[i % 4]) for _ in range(30)) + (" rare" if i % 97 == 0 else "")) for i in range(1000)], "item long, text string").coalesce(1)
    index = lexical.build_index(docs, str(tmp_path / "index"))
    assert index.count() == 1
    asked = lexical.Asked(lexical.query_terms(spark.createDataFrame([(1, "wa wb rare"), (2, "xa"), (3, "never")], "query long, text string")).toArrow())
    asked.weigh(1000, 30000, np.full(len(asked.terms), 50.0), 1.2, 0.75)
    batch = index.toArrow().combine_chunks().to_batches()[0]
    segment = lexical.Segment({c: batch.column(c)[0].values for c in batch.schema.names}, asked)
    bound = segment.bounds("any")
    scores = np.full((1000, len(asked.names)), np.nan)
    for items, part in segment.scores(bound > 0, "any"):
        scores[[segment.items.to_pylist().index(i) for i in items.to_pylist()]] = part
    best = np.array([np.nan_to_num(scores[i : i + lexical.BLOCK_ROWS]).max(0) for i in range(0, 1000, lexical.BLOCK_ROWS)])
    assert (bound >= best - 1e-9).all()
    assert (bound[:, 1] == 0).mean() > 0.5  # blocks of other languages
    found = retrieval.lexical_search(docs, spark.createDataFrame([(7, "wa rare")], "query long, text string"), 3, "any", index=index).collect()
    assert len(found) == 3 and all(r.item % 97 == 0 for r in found)


@pytest.mark.parametrize("least", [0.01, 0.5, 0.67, 1.0])
def test_skills_by_brute_force(spark, least):
    rng = random.Random(12)
    pick = lambda n: [rng.choice("hot hot hot hot a b c d e f g".split()) for _ in range(n)]
    q, d = {i: pick(rng.randint(1, 5)) for i in range(20)}, {i: pick(rng.randint(1, 8)) for i in range(60)}
    rows = lambda x: [(i, s) for i, ss in x.items() for s in ss]
    got = retrieval.skill_overlap_least(spark.createDataFrame(rows(q), "query long, skill string"), spark.createDataFrame(rows(d), "item long, skill string"), least)
    want = {(i, j): len(set(a) & set(b)) / len(set(a)) for i, a in q.items() for j, b in d.items() if set(a) & set(b) and len(set(a) & set(b)) >= least * len(set(a)) - 1e-9}
    assert {(r.query, r.item): r.overlap for r in got.collect()} == {k: round(v, 6) for k, v in want.items()}


def test_places_of_ten_thousand_queries(spark):
    rng = random.Random(13)
    names = ["".join(rng.choice("abcde .") for _ in range(rng.randint(1, 6))) for _ in range(10_000)] + ["us", "Texas", "", " "]
    places = ["".join(rng.choice("abcde .,") for _ in range(rng.randint(0, 12))) for _ in range(30)] + [None, "Austin, TX"]
    df = spark.createDataFrame(list(enumerate(places)), "i int, place string")
    got = {(r.query, r.i) for r in filters.location_matches(df, "i", "place", names).collect()}
    for query in [*names[:60], "us", "Texas", "", " "]:
        assert {i for q, i in got if q == query} == {r.i for r in filters.location_match(df, "place", query).collect()}, query


def test_pairs_of_words_and_queries_are_worked_out_some_at_a_time(spark, monkeypatch, tmp_path):
    import numpy as np

    rng = random.Random(21)
    docs = [(i, " ".join(rng.choice("abcdefghijkl") for _ in range(12))) for i in range(300)]
    queries = [(i, " ".join(sorted(set(t.split()))[: 3 + i % 5])) for i, t in docs[:60]] + [(900, "a never"), (901, None)]
    index = lexical.build_index(spark.createDataFrame(docs, "item long, text string").coalesce(1), str(tmp_path / "index"))
    asked = lexical.Asked(lexical.query_terms(spark.createDataFrame(queries, "query long, text string")).toArrow())
    asked.weigh(300, 3600, np.full(len(asked.terms), 50.0), 1.2, 0.75)
    batch = index.toArrow().combine_chunks().to_batches()[0]
    segment = lexical.Segment({c: batch.column(c)[0].values for c in batch.schema.names}, asked)
    whole, met, spread = {m: segment.bounds(m) for m in ("any", "all")}, [], asked.spread
    monkeypatch.setattr(lexical, "BLOCK", 100)
    monkeypatch.setattr(asked, "spread", lambda term: met.append(len(spread(term)[0])) or spread(term))
    for mode, bound in whole.items():
        assert abs(segment.bounds(mode) - bound).max() < 1e-9
    assert max(met) <= 100 < sum(met) / 2
    got = [(int(q), segment.items[int(d)].as_py(), s) for part in segment.answers() for d, q, s in zip(*part, strict=True)]
    assert {(int(asked.names[q]), d) for q, d, _ in got} == {(q, d) for q, t in queries if t for d, u in docs if set(t.split()) <= set(u.split())}
    assert len({(q, d) for q, d, _ in got}) == len(got)
    scores = {(int(q), items[int(d)].as_py()): part[d, q] for items, part in segment.scores(whole["all"] > 0, "all") for d, q in zip(*(~np.isnan(part)).nonzero(), strict=True)}
    assert scores.keys() == {(q, d) for q, d, _ in got} and all(abs(scores[q, d] - s) < 1e-9 for q, d, s in got)


def test_row_groups_of_an_index_are_small(spark, monkeypatch, tmp_path):
    """Spark's reader decodes a row group at once, so a file of many segments must not be one group."""
    import glob

    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical, "SEGMENT_ROWS", 50)
    monkeypatch.setitem(lexical.ROW_GROUPS, "parquet.block.size", "20000")
    rng = random.Random(22)
    docs = spark.createDataFrame([(i, " ".join(str(rng.randrange(5000)) for _ in range(100))) for i in range(400)], "item long, text string").coalesce(1)
    assert lexical.build_index(docs, str(tmp_path / "index")).count() == 8
    (file,) = glob.glob(str(tmp_path / "index" / "*.parquet"))
    assert pq.ParquetFile(file).metadata.num_row_groups == 8


def test_means_of_labels_take_the_memory_of_a_few_results():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(23)
    unit = lambda n: (lambda v: v / np.sqrt((v * v).sum(1))[:, None])(rng.normal(size=(n, 8)))
    labels = np.array([f"l{i}" for i in range(6)])
    item, label, vectors = np.repeat(np.arange(300), 6), np.tile(labels, 300), unit(1800)
    there = rng.random(6000) < 0.8
    query, query_label, matrix = np.repeat(np.arange(1000), 6)[there], np.tile(labels, 1000)[there], unit(6000)[there]
    asked = {str(x): retrieval._summed(query[query_label == x], matrix[query_label == x]) for x in labels}
    tracemalloc.start()
    weighted, plain = retrieval.label_means(300, item, label, vectors, 1000, asked, {"l1": 3.0})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * weighted.nbytes
    for i, q in ((0, 0), (7, 500), (299, 999)):
        w = np.array([3.0 if x == "l1" else 0.5 for x in query_label[query == q]])
        s = np.array([vectors[item == i][label[item == i] == x][0] @ v for x, v in zip(query_label[query == q], matrix[query == q])])
        assert abs(weighted[i, q] - (w * s).sum() / w.sum()) < 1e-9 and abs(plain[i, q] - s.mean()) < 1e-9


def test_equal_skills_meet_as_classes(spark):
    """300,000 pairs are given; none of them is shuffled."""
    rows = lambda n: [(i, s) for i in range(n) for s in ("hot", f"k{i % 3}")]
    queries, docs = spark.createDataFrame([*rows(300), (0, None)], "query long, skill string"), spark.createDataFrame(rows(3000), "item long, skill string")
    store, gateway, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway, spark.sparkContext._jvm

    def shuffled():
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        assert retrieval.skill_overlap_least(queries, docs, 0.9).agg({"overlap": "sum"}).first()[0] == 300_000
        assert sum(n for s, n in shuffled().items() if s not in before) < 40_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_blocks_of_queries_follow_what_a_task_holds(spark):
    """A task holds k rows a query: 30,000 queries for their 100 best are not 10,000 at a time."""
    queries = spark.range(30_000)
    assert [retrieval._blocks(queries, k) for k in (None, 10, 50, 100, 100_000)] == [3, 3, 3, 6, 30]
    assert retrieval._blocks(spark.range(0), 100) == 0
