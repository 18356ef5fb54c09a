"""Quality by a sparse ensemble of rules over document statistics.

Small trees are boosted on labelled rows, every path from a root is taken as a rule (a conjunction of bounds on
statistics), a lasso logistic regression keeps few of them, and these become one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import chunks, flat, owners, word_hashes, words
from .tables import written

#: Labelled rows that the fit sees at most, those of least hash of doc_id.
SAMPLE_ROWS = 20_000
STATISTICS = ["n_words", "word_length", "upper_share", "digit_share", "punct_share", "symbol_share", "distinct_share", "repeat_share", "top_share", "line_words", "repeated_lines", "stop_share", "letter_words", "short_share"]
_KIND = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isascii() and _c.isupper() else 2 if _c.isascii() and _c.islower() or _b >= 128 else 3 if _c.isascii() and _c.isdigit() else 4 if _c in ".,;:'\"!?()-" else 0 if _c.isspace() else 5


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; all zero for a text without words."""
    data, offs = flat(texts)
    m = len(offs) - 1
    starts, ends, woffs = words(data, offs)
    n = np.diff(woffs)
    kind, doc = _KIND[data], owners(offs)
    share = np.bincount(doc * 6 + kind, minlength=6 * m).reshape(m, 6).astype(float)
    solid = np.maximum(share[:, 1:].sum(1), 1)
    letters = np.maximum(share[:, 1] + share[:, 2], 1)
    wdoc, h = owners(woffs), word_hashes(data, starts, ends)
    many = np.maximum(n, 1)
    order = np.lexsort((h, wdoc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    distinct = np.bincount(wdoc[order][at], minlength=m)
    top = np.zeros(m)
    np.maximum.at(top, wdoc[order][at], runs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    alpha = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    lettered = alpha[ends] - alpha[starts] == ends - starts
    breaks = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    edge[1:][breaks] = True
    line_at = np.flatnonzero(edge[:-1]) if len(data) else np.zeros(0, np.int64)
    line_doc = doc[line_at]
    line_end = np.append(line_at[1:], len(data))
    line_end -= np.where((line_end > line_at) & (data[np.maximum(line_end, 1) - 1] == 10), 1, 0) if len(data) else 0
    line_hash = word_hashes(data, line_at, np.maximum(line_end, line_at + (line_end == line_at)))
    lines = np.bincount(line_doc, minlength=m)
    lorder = np.lexsort((line_hash, line_doc))
    same = (line_hash[lorder][1:] == line_hash[lorder][:-1]) & (line_doc[lorder][1:] == line_doc[lorder][:-1])
    dup = np.bincount(line_doc[lorder][1:][same], minlength=m) if len(lorder) else np.zeros(m)
    short = ends - starts <= 3
    plain_short = short & lettered
    columns = [
        n,
        np.bincount(wdoc, ends - starts, minlength=m) / many,
        share[:, 1] / letters,
        share[:, 3] / solid,
        share[:, 4] / solid,
        share[:, 5] / solid,
        distinct / np.sqrt(many),
        np.bincount(wdoc[again], minlength=m) / many,
        top / many,
        n / np.maximum(lines, 1),
        dup / np.maximum(lines, 1),
        np.bincount(wdoc[plain_short], minlength=m) / many,
        np.bincount(wdoc[lettered], minlength=m) / many,
        np.bincount(wdoc[short], minlength=m) / many,
    ]
    out = np.stack([np.asarray(c, float) for c in columns], 1)
    out[n == 0] = 0
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and a double column for each of STATISTICS; one row for each row of docs, null text as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            x = statistics(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def beside_statistics(docs: DataFrame, prefix: str) -> DataFrame:
    """docs with the statistics as further columns, named with the prefix; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            x = statistics(chunk.column("text"))
            yield pa.RecordBatch.from_arrays([*chunk.columns, *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=[*chunk.schema.names, *(prefix + s for s in STATISTICS)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + s, T.DoubleType()) for s in STATISTICS)])
    return docs.mapInArrow(run, schema)


def reject(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is ``least`` or more, with all their columns.

    Learns from the labelled rows that are not held out. The sample for the fit is picked by id first, so that only its
    texts are read for it, and each text is then judged where it is read: no text is shuffled. Null and empty texts are
    scored as well; repeated rows stay or go together; an empty table gives an empty one. Columns may have any names.
    """
    sample = labelled_sample(labels, learnable())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi")
    model = fit(with_statistics(own), sample)
    prefix = "_quality_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return beside_statistics(docs, prefix).where(model.column(prefix) >= least).select(*[f"`{c}`" for c in docs.columns])


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above the bound, bound)


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, w: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: list[Rule], fitted: np.ndarray) -> None:
    """One node of a regression tree on gradients g with weights w; paths are added to out, leaf values to fitted."""
    value = g[rows].sum() / (w[rows].sum() + 1e-3)
    fitted[rows] = value
    if path:
        out.append(path)
    if depth == 0 or len(rows) < 20:
        return
    best = (1e-6, -1, 0)
    total_g, total_w = g[rows].sum(), w[rows].sum()
    for f in range(x.shape[1]):
        if not len(cuts[f]):
            continue
        b = bins[rows, f]
        size = len(cuts[f]) + 1
        cg, cw, cn = (np.cumsum(np.bincount(b, weights, size))[:-1] for weights in (g[rows], w[rows], None))
        gain = cg**2 / (cw + 1) + (total_g - cg) ** 2 / (total_w - cw + 1) - total_g**2 / (total_w + 1)
        gain[(cn < 10) | (len(rows) - cn < 10)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (gain[at], f, at)
    if best[1] < 0:
        return
    _, f, at = best
    above = bins[rows, f] > at
    for side in (False, True):
        _grow(x, bins, cuts, g, w, rows[above == side], (*path, (f, side, float(cuts[f][at]))), depth - 1, out, fitted)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, seed: int = 5) -> list[Rule]:
    """Rules from boosted trees, each grown on half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 60))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: list[Rule] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        part = np.flatnonzero(rng.random(len(y)) < 0.5)
        step = np.zeros(len(y))
        if len(part) < 40:
            break
        grown: list[Rule] = []
        _grow(x, bins, cuts, y - p, p * (1 - p), part, (), depth, grown, step)
        rules += grown
        score += rate * np.clip(step, -4, 4)
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, bound in rule:
        out &= (x[:, f] > bound) == above
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on the weights (not the intercept), by accelerated proximal gradient steps."""
    n, k = a.shape
    base = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    w, v, b, vb, t = np.zeros(k), np.zeros(k), base, base, 1.0
    z = np.ones(k)
    for _ in range(20):  # the largest curvature, by power iteration
        z = a.T @ (a @ z)
        z /= np.linalg.norm(z) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(a @ z) ** 2 / n + 1))
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ v + vb))) - y
        nw = v - step * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b), w


class Model:
    """Few weighted rules; ``column`` is their Spark expression over STATISTICS, a score from 0 to 1."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    def column(self, prefix: str = "") -> Column:
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            meets = F.lit(True)
            for f, above, bound in rule:
                meets = meets & ((F.col(prefix + STATISTICS[f]) > bound) if above else (F.col(prefix + STATISTICS[f]) <= bound))
            total = total + F.when(meets, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def labelled_sample(labels: DataFrame, learn: Column, most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, y: at most ``most`` rows of labels (doc_id, quality not null) where ``learn`` holds, those of least hash."""
    known = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).distinct()
    hashed = F.abs(F.xxhash64("doc_id").cast("double"))
    # Twice as many by the hash, then exactly so many: few rows are sorted.
    near = known.where(hashed <= F.lit(2.0**63 * min(1.0, 2 * most / max(known.count(), 1))))
    return written(near.orderBy(hashed, "doc_id", "y").limit(most), "sample")


def fit(stats: DataFrame, sample: DataFrame, penalty: float = 5e-4) -> Model:
    """Fits on the rows of stats whose labels are in the sample (20,000 rows at most are broadcast).

    Without labelled rows every score is 0.5; with one class only, it is near that class. Of rows that repeat a doc_id
    one counts, that of least statistics.
    """
    met = stats.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*STATISTICS)).alias("s")).select("doc_id", "y", "s.*")
    rows = np.array([tuple(r) for r in met.toLocalIterator()], float)
    if not len(rows):
        return Model(0.0, [])
    rows = rows[np.lexsort(rows.T[::-1])]
    x, y = rows[:, 2:], rows[:, 1]
    rules = tree_rules(x, y)
    if not rules:
        return Model(float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), [])
    a = np.stack([holds(r, x) for r in rules], 1).astype(float)
    bias, weights = lasso(a, y, penalty)
    return Model(bias, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def learnable() -> Column:
    """Rows that are not held out: crc32 of doc_id as text, modulo 5, is not 0."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0


def score(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """doc_id and score (0 to 1, higher for labels.quality 1) of every row of docs.

    Null and empty texts have all statistics 0 and a score as well. A null doc_id is scored but never learned from;
    repeated rows get equal scores. Columns of docs other than doc_id and text are ignored. The statistics are written
    once to the shared folder and read for the fit and for the scores.
    """
    stats = written(with_statistics(docs), "statistics")
    model = fit(stats, labelled_sample(labels, learnable() if learn is None else learn))
    return stats.select("doc_id", model.column().alias("score"))
