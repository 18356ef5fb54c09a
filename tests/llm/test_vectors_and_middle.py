"""Fill-in-middle, ball codes and exact search against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("hirelake.llm")

from hirelake.llm import ballcodes, fim, search  # noqa: E402
from hirelake.llm.arrays import flat  # noqa: E402

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size, bits in ((0, 3), (1, 3), (64, 2), (1000, 3), (777, 4)):
        symbols = rng.integers(0, 1 << bits, size).astype(np.uint8)
        matrix, at = fim.WaveletMatrix(symbols, bits), np.arange(size + 1)
        for s in range(1 << bits):
            want = np.concatenate([[0], np.cumsum(symbols == s)])
            assert (matrix.rank(s, at) == want).all()
        both = np.concatenate([[0], np.cumsum((symbols == 1) | (symbols == 2))])
        wanted = np.arange(both[-1] + 2)
        found = matrix.find((1, 2), wanted, np.zeros(len(wanted), np.int64), np.full(len(wanted), size))
        assert found.tolist() == np.minimum(np.searchsorted(both, wanted), size).tolist()


@pytest.mark.parametrize("unit", ["words", "lines", "characters"])
def test_cuts(unit):
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["", " ", "\n", "a", "é", " a\n\nb ", "日本 語\n", "a b", "\n\n x"] + ["".join(rng.choice("ab é語\n\t ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    data, offs = flat(pa.array([*texts, None]))
    cutter = fim.Cutter(data, offs, unit)
    for i, text in enumerate([*texts, ""]):
        units = TOKEN.findall(text) if unit == "words" else text.split("\n") if unit == "lines" else list(text)
        if unit == "lines":
            units = [u + "\n" for u in units[:-1]] + [u for u in units[-1:] if u]
        assert cutter.units[i] == len(units)
        for n in range(len(units) + 1):
            place = cutter.cut(np.array([i]), np.array([n]))
            assert data[offs[i] : place[0]].tobytes().decode() == "".join(units[:n])
            assert cutter.characters(offs[[i]], place)[0] == len("".join(units[:n]))


def by_hand(key, text):
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    x, y = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, m, z = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (key, len(units), "plain", None, None, text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (key, len(units), form, len(a), len(m), f"<P>{a}<S>{z}<M>{m}" if form == "psm" else f"<S>{z}<P>{a}<M>{m}")


def test_fill_in_middle(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["ab", " ", "\n", "é", "語", "x ", "<P", "\x0b", "\x85"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t"), (403, "has <M> in it"), (404, "word " * 200000), (None, "no key here"), (5, rows[5][1]), (9, None)] + [(500 + i, "a<S>") for i in range(20)]
    docs = spark.createDataFrame([(k, t, "x", 1, b"y", "text") for k, t in rows], "doc_id long, text string, form string, a int, output binary, n string").repartition(5)
    got = fim.fill_in_middle(docs).withColumn("again", fim.restored()).collect()
    text = lambda r: (str(r[0]), r[1], r[2], str(r[3]), str(r[4]), r[5])
    assert sorted(map(text, got)) == sorted(text(by_hand(k, t)) for k, t in rows)
    whole = {(k, t or "") for k, t in rows}
    assert {(r.doc_id, r.again) for r in got} == whole
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


def embeddings(spark, rows, kind="vec_id long, embedding array<float>, label int, key string, vector int, codes string"):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], kind).repartition(4)


def clustered(n, width, seed=7):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, width))
    return [(i * 2 + 1, [float(np.float32(x)) for x in centre[i % 6] + rng.normal(size=width) * 0.05], None if i % 9 == 0 else int(i % 4)) for i in range(n)]


ODD = [(7, None, 1), (9, [], 1), (11, [math.nan] * 16, 1), (13, [math.inf] + [0.0] * 15, 1), (15, [None] + [0.0] * 15, 2), (2000, [1.0, 2.0], 2)]


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = [(k, [math.floor(1024 * x) for x in v], lab) for k, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    size = len(kept[0][1]) // parts
    cut = [[r[1][p * size : (p + 1) * size] for p in range(parts)] for r in kept]
    books = [[cut[i][p] for i in range(min(entries, len(kept)))] for p in range(parts)]
    for step in range(rounds + 1):
        chosen = [[min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p])) for p, x in enumerate(row)] for row in cut]
        if step == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [row[p] for row, ch in zip(cut, chosen, strict=True) if ch[p][1] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    errors = [sum(d for d, _ in ch) for ch in chosen]
    labels = {}
    for r, e in zip(kept, errors, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), bytes(e for _, e in ch).hex(), err, labels[r[2]], digest) for r, ch, err in zip(kept, chosen, errors, strict=True))


@pytest.mark.parametrize("entries", [256, 8])
def test_ball_codes(spark, entries):
    rows = clustered(400, 16)
    rows += [*ODD, (None, rows[3][1], 3), rows[10], rows[10], (rows[10][0], rows[11][1], 1), *[(5000 + i, rows[0][1], None) for i in range(150)]]
    got = ballcodes.compress(embeddings(spark, rows), entries=entries).collect()
    assert sorted((str(r.vec_id), bytes(r.codes).hex(), r.error, r.label_error, r.codebooks_sha256) for r in got) == codes_by_hand(rows, entries=entries)


def test_ball_codes_of_few_and_none(spark):
    few = [(3, [0.5, -0.25, 1.0], 1), (1, [0.1, 0.2, 0.3], None)]  # a length that four parts don't divide
    got = ballcodes.compress(embeddings(spark, few)).collect()
    assert [r.error for r in got] == [0, 0] and {bytes(r.codes) for r in got} == {bytes(4), bytes([1, 1, 1, 0])}
    assert ballcodes.compress(embeddings(spark, ODD[:5])).count() == 0
    assert ballcodes.compress(embeddings(spark, [(1, [1e30, -1e30, 0.0, 0.0], 1)])).collect()[0].error == 0


def test_balls_skip_work_and_lose_nothing():
    rng = np.random.default_rng(3)
    centre = rng.integers(-2000, 2000, (40, 16)).astype(float)
    points = np.repeat(centre, 200, axis=0) + rng.integers(-60, 60, (8000, 16))
    points[:500] = points[500:1000]  # ties
    entries = points[rng.permutation(len(points))[:256]].copy()
    entries[7] = entries[3]
    index, _ = ballcodes.nearest(points, entries)
    moved = entries.copy()
    for e in range(0, 256, 3):
        if (index == e).any():
            moved[e] = points[index == e].mean(0) // 1
    balls = ballcodes.Balls(moved, entries)
    got, far = balls.move(points, index)
    want, error = ballcodes.nearest(points, moved)
    assert (got == want).all() and (far == error).all()
    assert balls.exact < 0.2 * len(points) * len(entries)
    still = ballcodes.Balls(moved, moved)
    assert (still.move(points, want)[0] == want).all() and still.exact == len(points)


def hits_by_hand(rows, k=5):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(kept):
        if i % 50 == 0:
            asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        found = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in kept if i != q and len(x) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("most", [4096, 3])
def test_exact_search(spark, monkeypatch, most):
    monkeypatch.setattr(search, "QUERIES", most)
    rows = [(i, v, n) for i, (_, v, n) in enumerate(clustered(420, 16))]
    rows += [*ODD, (None, rows[1][1], 1), (50, rows[2][1], 1), *[(1000 + i, rows[100][1], 1) for i in range(60)], rows[7], rows[7], (2050, [3.0, 1.0], 1)]
    got = search.top_k(embeddings(spark, rows), search.F.col("vec_id") % 50 == 0).collect()
    assert sorted(tuple(r) for r in got) == hits_by_hand(rows)
    assert search.top_k(embeddings(spark, rows).where("false"), search.F.col("vec_id") % 50 == 0).count() == 0
    assert search.top_k(embeddings(spark, ODD[:5]), search.F.col("vec_id") % 50 == 0).count() == 0


def test_segment_statistics_bound_products_and_rule_out():
    rng = np.random.default_rng(4)
    base = np.repeat(rng.normal(size=(400, 8)), 8, axis=1)  # neighbouring components alike, as in smooth series
    rows = np.floor(256 * (base + 0.05 * rng.normal(size=(400, 64))))
    for segments in (1, 3, 16, 32):
        assert (search.statistics(rows, segments) @ search.statistics(rows, segments).T >= rows @ rows.T - 1e-6).all()
    levels = search._levels(np.arange(400), list(rows), 5)[0]
    query, row, score = levels.survivors(rows)
    exact = rows @ rows.T
    assert all(score[i] == exact[query[i], row[i]] for i in range(len(score)))
    assert levels.looked[-1] < 0.1 * exact.size and levels.looked == sorted(levels.looked, reverse=True)
