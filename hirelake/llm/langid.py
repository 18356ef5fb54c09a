"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import chunks, flat
from .tables import scratch, written

#: Dimensions that n-grams are hashed to, and centroids of a language.
DIMENSIONS, CENTROIDS = 4096, 4
#: Different labelled texts of a language that k-means sees at most.
SAMPLE_ROWS = 1500
#: Share of a language's own sample whose distance counts as too far.
FAR_SHARE = 0.01
_LETTER = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _LETTER[_b] = ord(chr(_b).lower())
    elif _b >= 128:
        _LETTER[_b] = _b


def counts(texts: pa.Array) -> np.ndarray:
    """A row of n-gram counts for each text: two and three bytes, letters in lower case, all else a space."""
    data, offs = flat(texts)
    m = len(offs) - 1
    x = _LETTER[data].astype(np.uint32)
    out = np.zeros(m * DIMENSIONS, np.float32)
    doc = np.repeat(np.arange(m), np.diff(offs))
    for k in (2, 3):
        n = len(x) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k, np.uint32)
        for j in range(k):
            h = (h ^ x[j : n + j]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        good = (doc[:n] == doc[k - 1 :]) & ((x[:n] != 32) | (x[1 : n + 1] != 32))
        out += np.bincount(doc[:n][good] * DIMENSIONS + (h[good] % DIMENSIONS), minlength=len(out)).astype(np.float32)
    return out.reshape(m, DIMENSIONS)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(texts)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means; the first centroids are spread out, each far from those before it."""
    rng = np.random.default_rng(seed)
    c = [v.mean(0)]
    near = v @ c[0]
    while len(c) < min(k, len(v)):
        far = np.maximum(1 - near, 0) ** 2 + 1e-9
        c.append(v[rng.choice(len(v), p=far / far.sum())])
        near = np.maximum(near, v @ c[-1])
    c = np.array(c, np.float64)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(v @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = v[own == i].mean(0)
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for chunk in chunks(batches):
        df += (counts(chunk.column("text")) > 0).sum(0)
        n += chunk.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMENSIONS)), pa.array(np.concatenate([[n], df]))], names=["dim", "docs"])


class Model:
    """Centroids of each language, the least cosine of each that isn't too far, and the weights of the dimensions."""

    def __init__(self, languages: list[str], centroids: list[np.ndarray], least: np.ndarray, idf: np.ndarray):
        self.languages, self.centroids, self.least, self.idf = languages, centroids, least, idf

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language, its score, the cosine of its nearest centroid, and whether that is too far.

        The score is the nearest language's share of how near all languages are. A text without a letter is ``und``
        with score and cosine 0; so is every text if no language was learned.
        """
        lettered = np.array([_has_letter(t) for t in texts.to_pylist()], bool)
        if not self.languages:
            lettered[:] = False
            best = np.zeros((len(texts), 1))
        else:
            v = vectors(texts, self.idf)
            best = np.stack([(v @ c.T).max(1) for c in self.centroids], 1).astype(np.float64)
        at, cosine = best.argmax(1), best.max(1)
        score = 1 / np.exp(20 * (best - cosine[:, None])).sum(1)
        far = ~lettered | (cosine < (self.least[at] if self.languages else 0))
        return [self.languages[i] if k else "und" for i, k in zip(at, lettered, strict=True)], np.where(lettered, score, 0.0), np.where(lettered, np.clip(cosine, 0, 1), 0.0), far


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from text and lang of the rows where ``learn`` holds and neither is null.

    Document frequencies cover all of these rows (one number a dimension reaches the driver). k-means sees at most
    ``sample_rows`` different texts of a language, those of least hash; the driver holds one language's at a time, and of
    each only its centroids. A language's distances in this sample give the cosine below which a text is too far from it.
    Repeated texts count once in k-means; without any row the model knows no language. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        docs = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", F.xxhash64("text").alias("hash"))
        # A written table's size is known: Spark broadcasts a small one, and shuffles texts by language only for a large one.
        sizes = written(docs.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")), "languages")
        df = np.zeros(DIMENSIONS + 1)
        for r in docs.select("text").mapInArrow(_frequency, "dim long, docs long").groupBy("dim").agg(F.sum("docs").alias("n")).collect():
            df[r.dim + 1] = r.n
        idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
        # Twice as many as needed by the hash, then exactly so many of least hash: few rows are ranked.
        near = docs.join(sizes, "lang").where(F.abs(F.col("hash").cast("double")) <= F.lit(2.0**63) * 2 * sample_rows / F.col("n"))
        one = near.groupBy("lang", "hash").agg(F.min("text").alias("text"))
        sample = one.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.abs(F.col("hash").cast("double")), "hash"))).where(F.col("rn") <= sample_rows)

        def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches):
                v = vectors(chunk.column("text"), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([chunk.column("lang"), pa.array([r.tobytes() for r in v], pa.binary())], names=["lang", "v"])

        languages, centroids, least = [], [], []
        rows = sample.orderBy("lang").select("text", "lang").mapInArrow(embed, "lang string, v binary").toLocalIterator()
        for language, own in groupby(rows, lambda r: r["lang"]):
            v = np.array([np.frombuffer(b, np.float16) for b in sorted(bytes(r["v"]) for r in own)], np.float32)
            languages.append(language)
            centroids.append(cluster(v, CENTROIDS))
            least.append(np.quantile((v @ centroids[-1].T).max(1), FAR_SHARE))
    return Model(languages, centroids, np.array(least), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), nearest, cosine and rejected of every text, without a shuffle.

    One row for each row of docs; repeated rows give repeated results, an empty table none. ``nearest`` is the language
    of the nearest centroid; ``lang_pred`` is that, or ``und`` if it is rejected as too far. Null texts and texts
    without a letter are ``und`` in both, with score 0, and rejected. Columns other than doc_id and text are ignored.
    The model (some 64 KB a language) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            near, score, cosine, far = shared.value.predict(chunk.column("text"))
            told = ["und" if f else x for x, f in zip(near, far, strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(told, pa.string()), pa.array(score), pa.array(near, pa.string()), pa.array(cosine), pa.array(far)], names=["doc_id", "lang_pred", "score", "nearest", "cosine", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, nearest string, cosine double, rejected boolean")
