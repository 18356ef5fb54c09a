"""The numbered operators against brute force, on small tables with nulls, empty texts, copies and clashing columns."""

import hashlib
import random
import re
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("hirelake.llm")
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from hirelake.llm import bpe, components, decontaminate, fingerprints, html, jaccard, langid, lm, quality, substring, suffix  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(45))
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 4 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage.split()
        if i % 5 == 1 and out:
            words = (out[rng.randrange(len(out))][1] or "").split()
            if words and i % 2:
                words[rng.randrange(len(words))] = "edited"
        out.append((i * 3, (" " if i % 3 else "\n").join(words)))
    out += [(1, None), (2, ""), (4, " \t "), (5, "x" * 5000), (7, "one two"), (8, "ONE two")]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "en" if i % 2 else None, 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, n int, h int, tokens int").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_fingerprints(docs, rows, empty):
    got = collected(fingerprints.fingerprint_with_next(docs, partitions=4))
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    prints = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert got[i].n_chars == n
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (text == edited)
        assert got[i].common_prefix == next((j for j, (a, b) in enumerate(zip(text, after)) if a != b), min(n, len(after)))
        assert 0 <= got[i].near_next <= 1 and (got[i].near_next == 1) == (text == after)
    assert fingerprints.fingerprint_with_next(empty, partitions=4).count() == 0


def test_prefix_hashes_answer_span_equality():
    rng = np.random.default_rng(1)
    points = rng.integers(97, 99, 400).astype(np.uint32)
    h = fingerprints.PrefixHashes(points)
    i, j = rng.integers(0, 300, 300), rng.integers(0, 300, 300)
    most = np.full(300, 80)
    want = [next((k for k in range(80) if points[a + k] != points[b + k]), 80) for a, b in zip(i, j)]
    assert h.extension(i, j, most).tolist() == want


def removed(units, length):
    """Units kept by brute force; units is a list of (id, sequence)."""
    seen, out = set(), {}
    for i, seq in sorted(units):
        gone = [False] * len(seq)
        for s in range(len(seq) - length + 1):
            key = tuple(seq[s : s + length])
            if key in seen:
                gone[s : s + length] = [True] * length
            seen.add(key)
        out[i] = gone
    return out


@pytest.mark.parametrize("length", [10, 20])
def test_substring(docs, rows, empty, length):
    got = collected(substring.remove_repeated_words(docs, length))
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    gone = removed(words, length)
    for i, w in words:
        assert got[i].n_words == len(w)
        assert got[i].kept == " ".join(x for x, g in zip(w, gone[i]) if not g)
    assert substring.remove_repeated_words(empty, length).count() == 0


def test_suffix_array(docs, rows, empty):
    got = collected(suffix.remove_repeated_bytes(docs, 64))
    texts = [(i, (t or "").encode()) for i, t in rows]
    gone = removed(texts, 64)
    for i, b in texts:
        assert bytes(got[i].kept) == bytes(x for x, g in zip(b, gone[i]) if not g)
        assert len(got[i].spans) == len(re.findall("1+", "".join("01"[g] for g in gone[i])))
    assert suffix.strip_repeated_bytes(empty, 64).count() == 0
    left = collected(suffix.strip_repeated_bytes(docs, 64))
    assert left[1].text is None and left[2].text == "" and left[0].lang is None


@pytest.mark.parametrize("parts", [1, 7])
def test_a_repeated_row_does_not_erase_itself(spark, rows, parts):
    """Every row twice, in one task or in several: both copies keep what a single one keeps."""
    once = spark.createDataFrame(rows, "doc_id long, text string")
    twice = once.union(once).repartition(parts)
    for run in (lambda d: substring.remove_repeated_words(d, 20), lambda d: suffix.remove_repeated_bytes(d, 64)):
        want = {r.doc_id: r.kept for r in run(once).collect()}
        got = [(r.doc_id, r.kept) for r in run(twice).collect()]
        assert len(got) == 2 * len(rows) and all(want[i] == kept for i, kept in got)


@pytest.mark.parametrize("hot, sent, share", [(1, 100_000, 64), (1, 100_000, 1), (1, 0, 2), (20_000, 100_000, 64)])
def test_repeats_with_null_and_repeated_ids_and_hot_anchors(spark, rows, monkeypatch, hot, sent, share):
    """Rows that share a doc_id follow each other by the hash of their text; a null one has no part."""
    monkeypatch.setattr(substring.repeats, "HINT_SHARE", share)
    xxhash = pytest.importorskip("xxhash")
    monkeypatch.setattr(substring.repeats, "HOT", hot)
    monkeypatch.setattr(substring.repeats, "BROADCAST_HOT", sent)
    line = " ".join(f"common{k}" for k in range(14))  # between other words each time, so that segments differ
    table = rows + [(i, f"{w} {line} {w}{i} " + " ".join(f"{w}{k}" for k in range(30))) for i, w in enumerate(["uu", "vv", "uu", "ww", "vv"], 9)] + [(9, rows[0][1]), (3, line * 3), (3, rows[4][1]), (None, rows[0][1]), (None, None)]
    docs = spark.createDataFrame([(t, 5, i, "x") for i, t in table], "text string, tie int, doc_id int, runs string").repartition(6)
    as_signed = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    order = lambda i, t: (i, as_signed(t or ""))
    words = [(order(i, t), WORD.findall(t or "")) for i, t in table if i is not None]
    gone = removed(words, 20)
    want = sorted([(i[0], " ".join(x for x, g in zip(w, gone[i]) if not g)) for i, w in words] + [(-1, " ".join(WORD.findall(t or ""))) for i, t in table if i is None])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.kept) for r in substring.remove_repeated_words(docs, 20).collect()) == want
    texts = [(order(i, t), (t or "").encode()) for i, t in table if i is not None]
    gone = removed(texts, 64)
    want = sorted([(i[0], bytes(x for x, g in zip(b, gone[i]) if not g)) for i, b in texts] + [(-1, (t or "").encode()) for i, t in table if i is None])
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept)) for r in suffix.remove_repeated_bytes(docs, 64).collect()) == want
    left = suffix.strip_repeated_bytes(docs, 64)
    assert left.columns == docs.columns and {(r.tie, r.runs) for r in left.collect()} == {(5, "x")}


def test_one_text_longer_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1000)
    rng = random.Random(9)
    part = "".join(rng.choice("abcd") for _ in range(900))
    table = [(1, part + "x" * 300 + part), (2, "".join(rng.choice("abcd") for _ in range(700)) + part)]
    gone = removed([(i, t.encode()) for i, t in table], 100)
    got = collected(suffix.remove_repeated_bytes(spark.createDataFrame(table, "doc_id long, text string"), 100))
    for i, t in table:
        assert bytes(got[i].kept) == bytes(x for x, g in zip(t.encode(), gone[i]) if not g)


def test_the_pipeline_keeps_repeated_rows(spark):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60))
    table = [(1, text, len(text)), (1, text, len(text)), (2, text + " more", len(text) + 5)]
    docs = spark.createDataFrame(table, "doc_id long, text string, n_chars long").repartition(3)
    left = corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, text), (1, text), (2, " more")]


def test_suffix_array_sorts_and_merges():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 3, 500).astype(np.uint8)
    sa, rank = suffix.suffix_array(text)
    raw = text.tobytes()
    assert sa.tolist() == sorted(range(500), key=lambda i: raw[i:])
    lcp = suffix.common_prefixes(text, sa, rank, 50)
    for k in range(1, 500):
        a, b = raw[sa[k] :], raw[sa[k - 1] :]
        assert lcp[k] == min(50, next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b))))

    def shard(start):
        part = text[start : start + 250]
        return suffix.Shard(part, np.array([250]), np.array([241]), (np.array([start]), np.array([0]), np.array([0])), 10)

    one, two = shard(0), shard(250)
    two.merge(one)
    early = {raw[i : i + 10] for i in range(241)}
    assert [bool(f) for f in two.first] == [raw[250 + o : 260 + o] not in early and raw[250 + o : 260 + o] not in {raw[250 + p : 260 + p] for p in range(o)} for o in two.offset]


def test_jaccard(spark, docs, rows, empty):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = collected(jaccard.link_similar(docs, 4, 85))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard.link_similar(empty, 4, 85).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (9, "a b c d e"), (None, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in jaccard.link_similar(twice, 4, 85).collect())[1:] == [(1, 1), (9, 1)]


@pytest.mark.parametrize("change", [{"LEAST_COPIES": 1, "HOT_SETS": 1000}, {"BROADCAST_IDS": 0}, {"WIDE_FROM": 5}, {"FAN_IN": 2}, {"BUCKETS": 8, "_B": np.uint64(7)}])
def test_jaccard_by_every_plan(docs, monkeypatch, change):
    """Copies by broadcast, ids by a join, wide bitmaps, counts added up in a tree of many levels, a sketch that tells nothing: the groups stay the same."""
    want = {r.doc_id: tuple(r) for r in jaccard.link_similar(docs, 4, 85).collect()}
    for name, value in change.items():
        monkeypatch.setattr(jaccard, name, value)
    assert {r.doc_id: tuple(r) for r in jaccard.link_similar(docs, 4, 85).collect()} == want


def test_jaccard_counts_a_few_at_a_time(spark, monkeypatch):
    """No batch of the last sum holds more than a few of the tasks' arrays of counters, however many tasks there were."""
    add = jaccard._add

    def bounded(batches):
        def checked():
            for batch in batches:
                assert batch.nbytes < 8_000_000
                yield batch

        return add(checked())

    monkeypatch.setattr(jaccard, "_add", bounded)
    n = 20
    parts = spark.range(n).select(F.expr(f"CAST(repeat(decode(X'0100000000000000', 'ISO-8859-1'), {jaccard.BUCKETS}) AS BINARY)").alias("counts"))
    got = jaccard.frequencies(parts)
    assert len(got) == jaccard.BUCKETS and (got == n).all()


def test_jaccard_bitmaps_of_many_short_texts():
    """Bitmaps of a chunk of 2,000 short texts are made some at a time; they are the same as made one by one."""
    texts = [f"w{i} a b c d e" if i % 7 else "" for i in range(2000)]
    doc, token = jaccard.shingle_sets(pa.array(texts), 4)
    jaccard._parities(doc, token, len(texts))
    tracemalloc.start()
    got = jaccard._parities(doc, token, len(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16_000_000
    for i in (0, 1, 127, 128, 129, 1000, 1999):
        bits = np.bincount((token[doc == i] >> np.uint64(40) & np.uint64(jaccard.BITS - 1)).astype(np.int64), minlength=jaccard.BITS) & 1
        assert got[i].as_py() == np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def test_decontaminate_by_joins(spark, docs, rows, monkeypatch):
    table = spark.createDataFrame([(0, " ".join(rows[8][1].split()[5:40])), (1, "one two")], "item_id long, text string")
    want = sorted(decontaminate.find_items(docs, table).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    assert sorted(decontaminate.find_items(docs, table).collect()) == want and want


def test_likeness_is_near_the_share_of_common_windows(spark):
    """Against the sets of windows themselves; the sketch's error is some 0.1 at most in 128 slots."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200")
    texts = dict(docs.select("doc_id", "text").collect())
    order = sorted(texts)
    dice = lambda a, b: 2 * len(a & b) / max(1, len(a) + len(b))
    windows = lambda t: {t[k : k + 16] for k in range(len(t) - 15)}
    errors = []
    for r in fingerprints.fingerprint_with_next(docs, partitions=4).collect():
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        errors += [abs(r.near_next - dice(windows(text), windows(after))), abs(r.near_edited - dice(windows(text), windows(edited)))]
    assert max(errors) < 0.25 and sum(errors) / len(errors) < 0.05


def test_short_texts_have_a_likeness(spark):
    table = [(1, "Short text, 30 points at most."), (2, "Another one of few code points"), (3, "Another one of few code pOints"), (4, "abc"), (5, "abd"), (6, ""), (7, "x" * 90), (8, "x" * 90)]
    got = collected(fingerprints.fingerprint_with_next(spark.createDataFrame(table, "doc_id long, text string"), partitions=1))
    assert 0.2 < got[1].near_edited < 0.9 and got[1].near_next < 0.3 and 0.6 < got[2].near_next < 1
    assert 0 < got[4].near_next < 1 and got[6].near_edited == 1 and got[7].near_next == 1
    assert len(set(got[i].fingerprint for i in range(1, 8))) == 7 and got[7].fingerprint == got[8].fingerprint == got[7].edited_fingerprint


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_decontaminate(spark, docs, rows, empty):
    some = [t for i, t in rows if t and len(t.split()) > 60][:3]
    items = [(0, " ".join(some[0].split()[5:40])), (1, " ".join(some[1].split()[:20]) + " zz zz zz"), (2, None), (3, "one two"), (4, "not there at all in any of these")]
    table = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.find_items(docs, table).collect()}
    want = {}
    for k, item in items:
        w = WORD.findall((item or "").lower())
        width = min(5, len(w))
        q = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if w else set()
        for i, t in rows:
            v = WORD.findall((t or "").lower())
            shared = len(q & {tuple(v[j : j + width]) for j in range(len(v) - width + 1)}) if w else 0
            if q and shared * 100 >= len(q) * 80:
                want[i, k] = (len(q), shared)
    assert got == want and (7, 3) in got and (8, 3) in got
    assert decontaminate.find_items(empty, table).count() == 0
    assert decontaminate.find_items(docs, table.where("false")).count() == 0


def test_language(spark, empty):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    words = {"aa": ["the", "and", "with", "this"], "bb": ["der", "und", "nicht", "eine"]}
    table = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x) for i in range(60) for x in words] + [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None), (903, "zzq xqj qxz jjq " * 9, None), (904, "the and with", None)]
    docs = spark.createDataFrame([(*r, "own", 0.5) for r in table], "doc_id long, text string, lang string, score string, cosine double")
    model = langid.fit(docs, F.col("doc_id") % 4 != 2)
    truth = {i: set() for i, _, _ in table}
    for i, t, x in table:
        truth[i].add((t, x))
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(table)
    for r in rows:
        if r.doc_id < 60:
            assert r.nearest in words and 0 < r.cosine <= 1
    told = {(t, x): langid.identify(docs.where(F.col("text") == t), model).first() for t, x in [(t, x) for i, t, x in table if i % 4 == 2 and i < 12]}
    assert all(r.nearest == x for (_, x), r in told.items())
    got = {r.doc_id: r for r in rows if r.doc_id >= 900}
    assert all(got[i].lang_pred == got[i].nearest == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred == "und" and got[903].nearest in words
    assert got[904].nearest == "aa" and all(0 <= r.score <= 1 for r in rows)
    # Of a language's own training texts about one in a hundred is too far.
    assert sum(r.rejected for r in rows if r.doc_id < 60) <= 12
    none = langid.identify(docs, langid.fit(empty, F.lit(True))).collect()
    assert {r.lang_pred for r in none} == {"und"} and all(r.rejected for r in none)
    assert langid.fit(docs, F.lit(True), sample_rows=5).languages == model.languages
    assert langid.identify(empty, model).count() == 0


def test_language_by_a_plain_loop(spark):
    """Nearest centroid and rejection from the model's own numbers, one text at a time; and held-out accuracy."""
    import zlib

    import pyarrow as pa

    from hirelake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, queries._remainder(4) != 2)
    lang = {r.doc_id: (r.text, r.lang) for r in docs.collect()}
    held = right = 0
    for r in queries.op5_language_id(spark, sf).collect():
        text, truth = lang[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = np.log1p(langid.counts(pa.array([text]))[0]) * model.idf
        best = {x: max(float(v @ c / np.linalg.norm(v)) for c in centroids) for x, centroids in zip(model.languages, model.centroids)}
        assert best[r.lang_pred] > max(best.values()) - 1e-5 and abs(r.cosine - max(best.values())) < 1e-4
        least = model.least[model.languages.index(r.lang_pred)]
        assert r.rejected == (r.cosine < least) or abs(r.cosine - least) < 1e-4
        assert abs(r.score - 1 / sum(np.exp(20 * (x - max(best.values()))) for x in best.values())) < 1e-3
        if r.held_out and truth is not None:
            held, right = held + 1, right + (r.lang_pred == truth)
    assert held and right / held > 0.95


def test_any_number_of_languages_is_learned(spark):
    rng = random.Random(11)
    words = {x: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3)] for x in range(600)}
    rows = [(i, " ".join(rng.choice(words[i % 600]) for _ in range(12)), f"l{i % 600:03d}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, langid.F.lit(True))
    assert len(model.languages) == 600
    import pyarrow as pa

    assert model.predict(pa.array([" ".join(words[599]), " ".join(words[3])]))[0] == ["l599", "l003"]


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>x  y\n<b>z<p>second<br>line<script>var t='</p>'</script><div id='comments'><p>me too</p></div></article><footer>f</footer></body></html>"
    assert html.main_text(page) == "A & B\nx y z\nsecond\nline"
    assert html.main_text("") == "" and html.main_text("plain <i>te</i>xt") == "plain text"


@pytest.mark.parametrize("around", ["<body class='has-sidebar'>%s", "<div class='layout with-sidebar'>%s</div>", "<article class='post no-comments'>%s</article>", "<article class='widget'>%s</article>", "<div id='social-science'>%s</div>", "<div class='widget'><main>%s</main></div>"])
def test_html_keeps_what_holds_the_text(around):
    assert html.main_text(around % "<p>the text</p><div class='share'>share</div><div class='x cookie-banner'>ok?</div>") == "the text"


BODY = "<article><h1>Title</h1><p>the main text of this page</p></article>"
AFTER = [
    '<div id="comments"><article class="comment-body"><p>a long comment of a reader, longer than the text</p></article></div>',
    '<section class="related"><article><h2>Other</h2><p>teaser</p></article></section>',
    '<aside><article><p>another teaser that is longer than the main text is</p></article></aside>',
    "<article><p>a second one</p></article>",
    *[f'<div class="{c}"><p>nice!</p></div>' for c in ("comment-list", "post-comments", "reader-comments", "comments-area", "related-posts", "shareButtons")],
    '<div id="disqus_thread"><p>loading</p></div>',
]


@pytest.mark.parametrize("after", AFTER)
def test_html_leaves_out_what_stands_round_an_article(after):
    for page in (BODY + after, f"<body>{after}{BODY}</body>", f"<main>{BODY}{after}</main>", BODY.replace("</article>", after + "</article>") if "second" not in after else BODY + after):
        assert html.main_text(page) == "Title\nthe main text of this page"
    if "article" not in after:  # without a marked article too
        assert html.main_text(f"<body><h1>Title</h1><p>the main text of this page</p>{after}</body>") == "Title\nthe main text of this page"


def test_html_keeps_forms_round_all_and_headings_in_headers():
    assert html.main_text(f'<body><form id="aspnetForm"><nav>menu</nav>{BODY}<input value="x"></form></body>') == "Title\nthe main text of this page"
    assert html.main_text('<body><form id="aspnetForm"><div><p>some text</p><nav>menu</nav></div></form></body>') == "some text"
    assert html.main_text("<body><p>text</p><form><p>search</p></form></body>") == "text"
    assert html.main_text("<body><header><h1>Site</h1></header><article><header><h1>Title</h1><nav>menu</nav></header><p>text</p><footer>by</footer></article></body>") == "Title\ntext"
    assert html.main_text("<article><header><p>no heading</p></header><p>text</p></article>") == "text"
    assert html.main_text("<div class='banner'><article><p>text</p></article></div>") == "text"
    kept = "<article><p>text</p>" + "".join(f'<div class="{c}"><p>kept</p></div>' for c in ("has-sidebar", "no-comments", "social-science", "related-work", "share-price", "post-content")) + "</article>"
    assert html.main_text(kept) == "\n".join(["text"] + ["kept"] * 6)


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<a " * 350_000, "<b>" * 100_000, "<p " + "a" * 500_000 + ">x", "<div class='" + "promo_" * 3000 + "!'>x", "<!" * 300_000, "<div>" * 30_000 + "<article>x</article>" * 30_000])
def test_html_is_linear_and_takes_any_depth(page):
    import time

    began = time.time()
    html.main_text(page)
    assert time.time() - began < 20


def site(n=12, host="h.example"):
    """Pages of one host: a menu with other links on each, a dated footer, a notice inside the article, a quote on three."""
    out = []
    for i in range(n):
        menu = "".join(f"<li><a href='/{i}/{k}'>{'abcdefgh'[(i + k) % 8]}{k}</a></li>" for k in range(3 + i % 4))
        quote = "<p>to be or not to be</p>" if i < 3 else ""
        body = f"<h1>Title {chr(97 + i)}</h1><p>{chr(97 + i) * 40} is what this page says</p>{quote}<p>Share this with all your friends</p>"
        out.append((i, f"http://{host}/{i}", f"<html><body><div class=x1><ul>{menu}</ul></div><article>{body}</article><div>Seen {i} times, all rights reserved</div></body></html>"))
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_site_templates(spark, monkeypatch, most):
    """By a broadcast of all templates, and by a join."""
    monkeypatch.setattr(html, "BROADCAST_ROWS", most)
    pages = site() + [(50, None, None), (51, "http://g.example/", "<div>Seen 4 times, all rights reserved</div>"), (52, "http://h.example/b", ""), *site()[:2]]
    table = spark.createDataFrame([(i, u, h, "own", i) for i, u, h in pages], "page_id long, url string, html string, host string, templates long").repartition(4)
    rows = html.extract(table).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    for i in range(12):
        want = [f"Title {chr(97 + i)}", f"{chr(97 + i) * 40} is what this page says"] + ["to be or not to be"] * (i < 3)
        assert got[i].text == "\n".join(want) and got[i].n_templates == 3
    assert got[50].text == "" and got[52].text == "" and got[51].text == "Seen 4 times, all rights reserved"
    assert html.extract(table.where("false")).count() == 0


def test_copies_of_an_article_are_no_template(spark):
    """Twenty copies of one text among other pages, each with an advert of its own, and twelve equal pages."""
    text = "<p>one</p><p>" + "the longest block of the text " * 3 + "</p><p>three</p>"
    pages = site() + [(100 + i, f"http://h.example/c{i}", f"<div>advert {chr(97 + i)}</div><div>{text}</div>") for i in range(20)]
    pages += [(200 + i, "http://e.example/", "<div>always<p>the same</p></div>") for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[100 + i].split("\n")[1:] == ["one", "the longest block of the text " * 2 + "the longest block of the text", "three"] for i in range(20))
    assert all(got[200 + i] == "always\nthe same" for i in range(12))


def test_templates_by_brute_force(spark):
    """The table of templates against counts in plain Python."""
    pages = site(9) + site(7, "g.example") + site(9)[:4]
    rows = {}
    for i, u, h in {p[2] + p[1].split("/")[2]: p for p in pages}.values():
        content, lead, trees = html.hash_subtrees(html.parse(h))
        for tree, text in trees.items():
            rows.setdefault((u.split("/")[2], tree), []).append((content, lead, text))
    leads = {h: len({x[1] for k, v in rows.items() if k[0] == h for x in v}) for h in ("h.example", "g.example")}
    want = set()
    for (host, tree), seen in rows.items():
        n, different = len({x[0] for x in seen}), len({x[1] for x in seen})
        text = any(x[2] for x in seen)
        if n >= 5 and different >= 5 and (not text or different >= leads[host] * html.TEXT_SHARE):
            want.add(tree)
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.tree for r in html.site_templates(table).collect()} == want and len(want) >= 3


def test_lm(docs, empty):
    got = collected(lm.pseudo_likelihood(docs))
    assert got[1].n_tokens == 0 and got[1].log_likelihood == 0 and got[1].mean_log_prob is None
    assert all(r.log_likelihood < 0 for r in got.values() if r.n_tokens)
    assert lm.pseudo_likelihood(empty).count() == 0
    rng = np.random.default_rng(0)
    net, past, context, target = lm.start(), [np.full(p.shape, 1e-8, np.float32) for p in lm.start()], rng.integers(0, 9, (512, 4)), rng.integers(0, 99, 512)
    before = lm.forward(net, context, target)[-1].mean()
    for _ in range(60):
        lm.train_step(net, past, context, target, 0.1)
    assert lm.forward(net, context, target)[-1].mean() > before + 1


def test_lm_scores_as_a_plain_loop_does(docs, rows):
    counts = lm.vocabulary(docs)
    (hashes, order), net, totals = lm.train(docs, counts)
    e, w1, b1, wg, bg, wm, bm = (p.astype(float) for p in net)
    n = {np.int64(r.word).view(np.uint64): r.n for r in counts.collect()}

    def word(w):
        from hirelake.llm.arrays import word_hashes

        return word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]

    def of_class(h):
        at = np.flatnonzero(hashes == h)
        return int(lm.class_of(order[at[0]] if len(at) else lm.FREQUENT + h % np.uint64(lm.CLASSES - 1 - lm.FREQUENT)))

    softmax = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    got = collected(lm.score(docs, counts, (hashes, order), net, totals))
    for i, t in rows[:12]:
        found = [word(w) for w in WORD.findall(t or "")]
        c = [of_class(h) for h in found]
        want = 0.0
        for k, h in enumerate(found):
            around = [c[j] if 0 <= j < len(c) else lm.EDGE for j in (k - 2, k - 1, k + 1, k + 2)]
            hidden = np.tanh(e[around].ravel() @ w1 + b1)
            g, m = divmod(c[k], lm.MEMBERS)
            want += np.log(softmax(hidden @ wg + bg)[g]) + np.log(softmax(hidden @ wm[g] + bm[g])[m]) + np.log(n[h]) - np.log(totals[c[k]])
        assert abs(got[i].log_likelihood - want) < 1e-3 * max(1, len(found)) and got[i].n_tokens == len(found)


def test_lm_learns_alike_from_any_partitions(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = docs.where("doc_id % 5 = 0")
    learned = []
    for parts in (1, 8):
        own = docs.where("doc_id % 5 != 0").repartition(parts)
        counts = lm.vocabulary(own)
        frequent, net, totals = lm.train(own, counts, shard_tokens=10_000)
        learned.append(lm.score(held, counts, frequent, net, totals).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0])
        share = np.log(np.maximum(totals, 0.5) / totals.sum())
        plain = lm.score(held, counts, frequent, [np.zeros_like(p) for p in net], totals).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
        # A network of zeros gives each class an equal chance.
        assert learned[-1] > plain + 0.5 and share.min() > -20
    assert abs(learned[0] - learned[1]) < 1e-3


def test_lm_tells_words_of_a_class_apart_and_learns_from_small_partitions(spark, docs):
    rng = random.Random(6)
    often, seldom = [f"often{i}" for i in range(1200)], [f"seldom{i}" for i in range(390)]
    table = [(i, " ".join(rng.choice(often) for _ in range(30))) for i in range(3000)] + [(5000 + i, " ".join(seldom[30 * i : 30 * i + 30])) for i in range(13)]
    own = spark.createDataFrame(table + table[:1], "doc_id long, text string").repartition(3)
    counts = lm.vocabulary(own)
    model = lm.train(own, counts)
    assert model[2].sum() == sum(len(t.split()) for _, t in table + table[:1]) and counts.count() == 1590
    got = lm.score(own, counts, *model).collect()
    mean = lambda rows: sum(r.log_likelihood for r in rows) / sum(r.n_tokens for r in rows)
    assert len(got) == len(table) + 1
    # A word seen once is one in some 75 of what an often seen word of its class is.
    assert mean([r for r in got if r.doc_id < 5000]) > mean([r for r in got if r.doc_id >= 5000]) + 3
    joined = sorted((r.doc_id, r.log_likelihood) for r in lm.score(own, counts, *model, common=1).collect())
    assert np.allclose([x for _, x in joined], [x for _, x in sorted((r.doc_id, r.log_likelihood) for r in got)], atol=1e-3)
    small = docs.limit(40).repartition(40)
    assert not np.array_equal(lm.train(small, lm.vocabulary(small))[1][3], lm.start()[3])


def test_quality(spark, empty):
    rng = random.Random(8)
    good = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(60)) + "."
    table = [(i, good() if i % 3 else "BUY!! " * rng.randint(20, 60)) for i in range(300)] + [(999, None)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1000, None, 1)], "doc_id long, quality int, toxic int")
    got = collected(quality.score(docs, labels))
    held = [i for i in range(300) if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.3) == (i % 3 > 0) for i in held) / len(held) > 0.95
    assert 0 <= got[999].score <= 1
    assert quality.score(empty, labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert quality.reject(docs, labels).columns == docs.columns
    # The rules' column against the rules themselves, and a filter that keeps what scores enough.
    import pyarrow as pa

    sample = quality.labelled_sample(labels, quality.learnable())
    model = quality.fit(quality.with_statistics(docs), sample)
    stats = quality.statistics(pa.array([t for _, t in table]))
    total = model.bias + sum(w * quality.holds(rule, stats) for rule, w in model.rules)
    want = {i: 1 / (1 + np.exp(-z)) for (i, _), z in zip(table, total)}
    assert model.rules and all(abs(got[i].score - want[i]) < 1e-9 for i in want)
    clash = docs.selectExpr("doc_id", "text", "1 AS _quality_n_words", "2 AS `n words`", "3 AS y")
    clash = clash.union(clash.where("doc_id = 1"))
    kept = quality.reject(clash, labels)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i in want if want[i] >= 0.3] + [1] * int(want[1] >= 0.3))
    assert quality.labelled_sample(labels, quality.learnable(), most=50).count() == 50
    assert quality.reject(empty, labels).count() == 0
    twice = labels.union(labels.selectExpr("doc_id", "1 - quality", "toxic").where("doc_id < 5"))
    assert quality.labelled_sample(twice, quality.learnable()).count() > sample.count()


def test_bpe(docs, rows, empty):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = collected(bpe.encode_documents(docs, path, P.PATTERN))
    for i, t in rows:
        assert got[i].ids == want.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    assert bpe.encode_documents(empty, path, P.PATTERN).count() == 0
    encoder = bpe.Encoder(ranks)
    rng = random.Random(4)
    piece = bpe.Piece(encoder, bytes(rng.choice(b"theinga") for _ in range(900)))
    for _ in range(30):
        at, by = rng.randrange(800), bytes(rng.choice(b"theq") for _ in range(rng.randrange(6)))
        assert piece.replace(at, at + rng.randrange(6), by) < 500
        assert piece.ids() == encoder.encode(piece.piece)
    piece.append(b"ing then")
    assert piece.ids() == encoder.encode(piece.piece) and encoder.decode(piece.ids()) == piece.piece


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert sorted(map(str, last.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_the_pipeline_by_brute_force(spark, rows, tmp_path):
    """Stages 2 to 5 on a small corpus with nulls, copies, repeated rows and clashing columns, each in plain Python."""
    import corpus_pipeline

    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    table = [(i, t, len(t or ""), i % 3) for i, t in rows] + [(None, "no id at all", 12, 7), (0, rows[0][1], len(rows[0][1]), 5), (3000, "lead in " + rows[8][1] + " out", 1, 1)]
    docs = spark.createDataFrame(table, "doc_id long, text string, n_chars long, runs int")
    spark.createDataFrame([(0, " ".join((rows[12][1] or "").split()[:30])), (1, "two words"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def shingles(t, size):
        w = WORD.findall((t or "").lower())
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    # near duplicates: the least id of each group stays
    sets = {i: shingles(t, 5) for i, t, _, _ in table if i is not None}
    root = {i: i for i in sets}
    find = lambda a: a if root[a] == a else find(root[a])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    table = [r for r in table if r[0] is None or find(r[0]) == r[0]]
    docs = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, table))
    # repeated bytes go; cut characters go as a whole
    gone = removed(sorted({(i, (t or "").encode()) for i, t, _, _ in table if i is not None}), 100)
    cut = []
    for i, t, n, x in table:
        kept = t if t is None or i is None else bytes(c for c, g in zip(t.encode(), gone[i]) if not g).decode("utf-8", "ignore")
        if kept or not t:
            cut.append((i, kept, None if kept is None else len(kept), x))
    docs = stages["suffix-array dedup"](spark, docs, str(tmp_path))
    assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, cut))
    # benchmark items
    items = [(" ".join((rows[12][1] or "").split()[:30])), "two words"]
    hit = lambda t: any((k := min(5, len(q.split()))) and len(shingles(q, k) & shingles(t, k)) * 100 >= len(shingles(q, k)) * 80 for q in items)
    clean = [r for r in cut if r[0] is None or not hit(r[1])]
    docs = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, clean)) and len(clean) < len(cut)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((str(i), own.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in clean)
    assert sorted((str(r.doc_id), r.ids, r.decoded_sha256) for r in stages["byte-level BPE"](spark, docs, str(tmp_path)).collect()) == want
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.where("false") if "text" in docs.columns else docs, str(tmp_path)).count() == 0, name


def test_masked_network_learns_more_from_more_text(spark):
    from pyspark.sql import functions as F

    assert [lm.rounds_of(n) for n in (1, 2, 3, 4, 16, 1 << 20)] == [1, 2, 2, 3, 5, 21]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    held, own = docs.where("doc_id % 10 = 0"), docs.where("doc_id % 10 != 0")
    gains = []
    for part in (own.where("doc_id % 10 = 3"), own):
        counts = lm.vocabulary(part)
        frequent, net, totals = lm.train(part, counts, shard_tokens=20_000)
        with_net, without = (lm.score(held, counts, frequent, n, totals).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0] for n in (net, [np.zeros_like(p) for p in net]))
        gains.append(with_net - without)
    assert gains[1] > gains[0] + 0.02


def test_networks_add_up_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 3)
    rows = spark.createDataFrame([(np.array([i, 1.0]).tobytes(),) for i in range(40)], "sums binary").repartition(40)
    assert np.frombuffer(bytes(lm._added(rows).sums), np.float64).tolist() == [sum(range(40)), 40.0]
    assert lm._added(rows.where("false")) is None


def test_strings_left_out_of_the_suffix_array_are_not_repeated():
    from hirelake.llm import suffix

    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(100, 4000))
        text = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        for _ in range(int(rng.integers(0, 6))):
            size = min(int(rng.integers(50, 300)), n // 2)
            a, b = rng.integers(0, n - size, 2)
            text[b : b + size] = text[a : a + size].copy()
        at = np.flatnonzero(rng.random(n - 99) < rng.random())
        order = rng.permutation(len(at))
        first = {}
        for i in np.argsort(order):
            first.setdefault(text[at[i] : at[i] + 100].tobytes(), order[i])
        want = [bool(order[i] > first[text[at[i] : at[i] + 100].tobytes()]) for i in range(len(at))]
        assert suffix.repeated_in_shard(text, suffix._seeds(text), at, order, 100).tolist() == want


def test_scoring_cuts_texts_into_words_once(spark):
    """Rare words are written with the sums of the known ones, so the joins read no texts."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, None), (3, "c d"), (3, "c d")], "doc_id long, text string")
    counts = lm.vocabulary(docs)
    scored = lm.score(docs, counts, *lm.train(docs, counts), common=2)
    assert "MapInArrow" not in scored._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.n_tokens) for r in scored.collect()) == [(1, 4), (2, 0), (3, 2), (3, 2)]


def test_a_training_step_is_the_gradient_of_every_row_and_batches_lie_by_columns():
    rng = np.random.default_rng(8)
    net = [p.astype(np.float64) + rng.normal(0, 0.1, p.shape) for p in lm.start()]
    context, target = rng.integers(0, lm.CLASSES, (60, 4)), rng.integers(0, lm.CLASSES, 60)
    target[:9] = 5

    def loss(net: list) -> float:
        e, w1, b1, wg, bg, wm, bm = net
        total = 0.0
        for c, t in zip(context, target, strict=True):
            h = np.tanh(e[c].ravel() @ w1 + b1)
            g, m = divmod(int(t), lm.MEMBERS)
            for z, at in ((h @ wg + bg, g), (h @ wm[g] + bm[g], m)):
                total -= z[at] - np.log(np.exp(z).sum())
        return total / len(target)

    single = [p.astype(np.float32) for p in net]
    *_, pg, pm, logs = lm.forward(single, context, target)
    assert pg.shape == (lm.GROUPS, 60) and pm.shape == (lm.MEMBERS, 60)  # softmax runs along columns, not short rows
    assert np.allclose(pg.sum(0), 1, atol=1e-5) and np.allclose(pm.sum(0), 1, atol=1e-5)
    assert abs(-logs.mean() - loss(net)) < 1e-4
    # With squares so large that a step is rate * gradient / 1000.
    lm.train_step(single, [np.full(p.shape, 1e6, np.float32) for p in single], context, target, 1e6)
    spots = [(0, (context[3, 1], 7)), (1, (40, 3)), (2, (5,)), (3, (9, 0)), (4, (0,)), (5, (0, 4, 5)), (6, (0, 5)), (6, (target[20] // lm.MEMBERS, 2))]
    for i, at in spots:
        up, down = [p.copy() for p in net], [p.copy() for p in net]
        up[i][at] += 1e-5
        down[i][at] -= 1e-5
        slope = (loss(up) - loss(down)) / 2e-5
        moved = (net[i][at] - single[i][at]) / 1000
        assert abs(moved - slope) < 1e-5 + 1e-3 * abs(slope), (i, at, moved, slope)


def test_written_tables_meet_python_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from hirelake.llm.tables import written

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    # A projection of rows of a kilobyte, so that both limits are told apart.
    wide = spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    long = spark.range(0, 1500, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    for docs, n in ((wide, 9000), (long, 1500)):
        got = written(docs.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
        assert sum(r.rows for r in got) == n
        assert max(r.rows for r in got) <= 2000 and max(r.bytes for r in got) < 6 << 20
    assert spark.conf.get(key) == before


def test_a_shard_of_repeated_bytes_is_settled_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    part = rng.integers(97, 123, 1 << 19).astype(np.uint8).tobytes().decode()
    texts = pa.array([part, part])
    find = suffix._find(100)
    tracemalloc.start()
    *_, settled = find(texts, np.arange(2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(settled[0].tolist()) == {1} and len(settled[0]) == len(part) - 99
    assert peak < 200e6, peak  # 226 MB with counters of eight bytes and arrays kept to the end
