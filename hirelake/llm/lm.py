"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is hidden in turn and predicted from the two tokens before and the two after it; the sum of the
log-probabilities of the tokens that were there scores the document.

A word's probability is that of its class in the context, by the network, times the word's share of its class, by its
count in the whole corpus. The counts are a table that grows with the corpus: its common words are broadcast, all others
are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .arrays import chunks, flat, owners, word_hashes, words
from .tables import written

#: Frequent words with a class each; all others share classes by their hash. The last class is the text's edge.
FREQUENT, GROUPS, MEMBERS = 768, 32, 32
CLASSES = GROUPS * MEMBERS
SIDE, WIDTH, HIDDEN, BATCH = 2, 16, 32, 4096
#: Targets of one training step, and its rate (each weight's steps shrink as its gradients add up).
STEP, RATE = 1024, 0.1
#: Tokens of a training shard. Shards are dealt by documents, so that a network does not depend on how Spark cuts them.
SHARD_TOKENS = 2_000_000
#: Networks (some 900 KB each) that a task adds up.
FAN_IN = 64
#: Words that make one in so many tokens or more are broadcast with their counts (so many words at most).
COMMON = 2_000_000
_SHAPES = [(CLASSES, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, MEMBERS), (GROUPS, MEMBERS)]


def class_of(place: np.ndarray) -> np.ndarray:
    """The class at each place of the order of classes, so that neighbours in it are of different groups."""
    return (place % GROUPS * MEMBERS + place // GROUPS).astype(np.uint16)


EDGE = int(class_of(np.array(CLASSES - 1)))


def start(seed: int = 11) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    e, w1, b1, wg, bg, wm, bm = (np.zeros(s, np.float32) for s in _SHAPES)
    for weights, spread in ((e, 0.1), (w1, (2 * SIDE * WIDTH) ** -0.5), (wg, HIDDEN**-0.5), (wm, HIDDEN**-0.5)):
        weights[...] = rng.standard_normal(weights.shape) * spread
    return [e, w1, b1, wg, bg, wm, bm]


def _softmax(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (in place of z, a column for each row of the batch), and the log-probability of each row's target."""
    z -= z.max(0)
    at = z[target, np.arange(z.shape[1])]
    np.exp(z, out=z)
    total = z.sum(0)
    z /= total
    return z, at - np.log(total)


def forward(net: list[np.ndarray], context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """What a step needs: the order of rows by group with the groups' bounds, and (in that order) inputs, hidden units
    with a one at the end, and a column of probabilities of groups and of members a row; last, as the rows came, the
    log-probability of each target's class."""
    e, w1, b1, wg, bg, wm, bm = net
    group = (target // MEMBERS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    bounds = np.append(0, np.cumsum(np.bincount(group, minlength=GROUPS)))
    group, member = group[order], (target % MEMBERS)[order]
    x = e.take(context[order], axis=0).reshape(len(target), -1)
    h = np.ones((len(target), HIDDEN + 1), np.float32)
    np.tanh(x @ w1 + b1, out=h[:, :-1])
    pg, logs = _softmax(np.concatenate([wg, bg[None]]).T @ h.T, group)
    members = np.concatenate([wm, bm[:, None]], 1)
    z = np.empty((MEMBERS, len(target)), np.float32)
    for g in range(GROUPS):
        a, b = bounds[g], bounds[g + 1]
        if a < b:
            np.matmul(members[g].T, h[a:b].T, out=z[:, a:b])
    pm, more = _softmax(z, member)
    out = np.empty_like(logs)
    out[order] = logs + more
    return order, bounds, x, h, pg, pm, out


#: Where each class's numbers lie in the flat table of embeddings.
_FLAT = np.arange(CLASSES * WIDTH).reshape(CLASSES, WIDTH)


def train_step(net: list[np.ndarray], past: list[np.ndarray], context: np.ndarray, target: np.ndarray, rate: float) -> None:
    """One step of gradient descent; ``past`` holds the squares of each weight's gradients so far."""
    _, w1, _, wg, _, wm, _ = net
    order, bounds, x, h, dg, dm, _ = forward(net, context, target)
    context, target = context[order], target[order]
    rows = np.arange(len(target))
    dg[target // MEMBERS, rows] -= 1
    dm[target % MEMBERS, rows] -= 1
    back, gm = np.empty((len(target), HIDDEN), np.float32), np.zeros((GROUPS, HIDDEN + 1, MEMBERS), np.float32)
    for g in range(GROUPS):
        a, b = bounds[g], bounds[g + 1]
        if a < b:
            d = dm[:, a:b].T
            np.matmul(d, wm[g].T, out=back[a:b])
            np.matmul(h[a:b].T, d, out=gm[g])
    gg, hidden = h.T @ dg.T, h[:, :-1]
    dh = dg.T @ wg.T
    dh += back
    dh *= 1 - hidden * hidden
    ge = np.bincount(_FLAT.take(context, axis=0).ravel(), (dh @ w1.T).ravel(), CLASSES * WIDTH).astype(np.float32).reshape(CLASSES, WIDTH)
    for weights, squares, gradient in zip(net, past, [ge, x.T @ dh, dh.sum(0), gg[:-1], gg[-1], gm[:, :-1], gm[:, -1]], strict=True):
        gradient /= len(target)
        squares += gradient * gradient
        gradient *= rate
        gradient /= np.sqrt(squares)
        weights -= gradient


class Tokens:
    """Classes of the words of some texts, and the context of each."""

    def __init__(self, texts: pa.Array, frequent: tuple[np.ndarray, np.ndarray]):
        frequent, order = frequent
        data, offs = flat(texts)
        starts, ends, woffs = words(data, offs)
        self.hash = word_hashes(data, starts, ends)
        self.counts, self.doc = np.diff(woffs), owners(woffs)
        at = np.searchsorted(frequent, self.hash) if len(frequent) else np.zeros(len(self.hash), np.int64)
        known = frequent[np.minimum(at, len(frequent) - 1)] == self.hash if len(frequent) else np.zeros(len(self.hash), bool)
        rest = (FREQUENT + self.hash % np.uint64(CLASSES - 1 - FREQUENT)).astype(np.int64)
        self.classes = class_of(np.where(known, order[np.minimum(at, len(order) - 1)], rest) if len(order) else rest)
        place = np.arange(len(self.hash)) - woffs[self.doc]
        self.before, self.after, self.place = place, self.counts[self.doc] - 1 - place, place

    def context(self, at: np.ndarray) -> np.ndarray:
        columns = []
        n = len(self.classes)
        for step in [*range(-SIDE, 0), *range(1, SIDE + 1)]:
            there = self.before[at] >= -step if step < 0 else self.after[at] >= step
            columns.append(np.where(there, self.classes[np.clip(at + step, 0, n - 1)], np.uint16(EDGE)))
        return np.stack(columns, 1)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        data, offs = flat(chunk.column("text"))
        starts, ends, _ = words(data, offs)
        h, n = np.unique(word_hashes(data, starts, ends), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word (its hash), n: every word of the corpus and how often it occurs."""
    return written(docs.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``FREQUENT`` most frequent words, sorted, and each one's place by count; ties go to the lesser hash."""
    top = np.array([r.word for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()], np.int64).view(np.uint64)
    order = np.argsort(top)
    return top[order], order


def _trainer(frequent: tuple[np.ndarray, np.ndarray], net: list[np.ndarray], rate: float):
    names = ["sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        past: list[np.ndarray] = []
        shard, seen = None, 0
        totals = np.zeros(CLASSES)
        context, target = np.zeros((0, 2 * SIDE), np.uint16), np.zeros(0, np.uint16)

        def ended() -> pa.RecordBatch:
            flat_net = np.concatenate([p.ravel() for p in own]).astype(np.float64) * seen
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate([flat_net, totals, [seen]]).tobytes()], pa.binary())], names=names)

        def step(size: int) -> None:
            nonlocal context, target, seen
            train_step(own, past, context[:size], target[:size], rate)
            context, target, seen = context[size:], target[size:], seen + size

        for chunk in chunks(_by_shard(batches)):
            at = chunk.column("shard")[0].as_py()
            if at != shard:
                if shard is not None:
                    if len(target):
                        step(len(target))
                    if seen:
                        yield ended()
                shard, seen, totals = at, 0, np.zeros(CLASSES)
                own, past = [p.copy() for p in net], [np.full(p.shape, 1e-8, np.float32) for p in net]
            t = Tokens(chunk.column("text"), frequent)
            totals += np.bincount(t.classes, minlength=CLASSES)
            context = np.concatenate([context, t.context(np.arange(len(t.classes)))])
            target = np.concatenate([target, t.classes])
            done = len(target) // STEP * STEP
            for _ in range(0, done, STEP):
                step(STEP)
        if len(target):  # a shorter step for what is left
            step(len(target))
        if seen:
            yield ended()

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut where the shard changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]))


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("sums"):
            row = np.frombuffer(value.as_buffer(), np.float64)
            total = row.copy() if total is None else total + row
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def rounds_of(shards: int) -> int:
    """Rounds of training: 1, 2, 3, 4, ... for 1, 2, 4, 8, ... shards."""
    return max(1, shards.bit_length())


def _added(nets: DataFrame) -> Row | None:
    """The sum of all rows, in a tree in which no task adds up more than ``FAN_IN`` of them."""
    nets = written(nets, "nets")
    rows = nets.count()
    while rows > FAN_IN:
        rows = -(-rows // FAN_IN)
        nets = written(nets.repartition(rows).mapInArrow(_add, "sums binary"), "nets")
    return nets.coalesce(1).mapInArrow(_add, "sums binary").first()


def train(docs: DataFrame, counts: DataFrame, rate: float = RATE, shard_tokens: int = SHARD_TOKENS) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray], np.ndarray]:
    """Frequent words, the network, and how many tokens each class has.

    Documents are dealt into shards of some ``shard_tokens`` tokens by a hash of doc_id and text and ordered by it, so
    what is learned follows from the rows alone, not from files, partitions or tasks. There are as many rounds as the
    number of shards has binary digits, and each shard is in one of them: in a round its shards each train a copy of the
    network on every position; the copies are averaged by the number of their targets, added up in a tree, and are where the next round starts.
    One network of some 900 KB a round reaches the driver, whatever the corpus; what grows with the corpus is ``counts``,
    its vocabulary, the number of shards, and the rounds, each of which reads the texts again. With no rows or no words
    the starting network comes back; null texts have no tokens, and repeated rows are trained on again.
    """
    frequent = frequent_words(counts)
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))
    keyed = docs.select("text", F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key")).withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
    net, totals = start(), np.zeros(CLASSES)
    rounds = rounds_of(shards)
    for r in range(rounds):
        part = keyed.where(F.col("shard") % rounds == r).repartition("shard").sortWithinPartitions("shard", "key")
        nets = part.mapInArrow(lambda batches, net=net: _add(_trainer(frequent, net, rate)(batches)), "sums binary")
        total = _added(nets)
        if total is None:
            continue
        sums = np.frombuffer(bytes(total.sums), np.float64)
        totals = totals + sums[-1 - CLASSES : -1]
        values, net, at = (sums[: -1 - CLASSES] / sums[-1]).astype(np.float32), [], 0
        for shape in _SHAPES:
            size = int(np.prod(shape))
            net.append(values[at : at + size].reshape(shape))
            at += size
    return frequent, net, totals


def _places(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return at, table[at] == hashes


def score(docs: DataFrame, counts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], net: list[np.ndarray], totals: np.ndarray, common: int = COMMON) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (the sum of the tokens' conditional log-probabilities) and mean_log_prob.

    One row for each row of docs. A text without words (null, empty) has 0 tokens, log-likelihood 0 and a null mean;
    repeated rows give repeated results; an empty corpus scores with the starting network. A word that ``counts`` does
    not have counts as one. Columns other than doc_id and text are ignored.

    Words less common than one token in ``common`` are joined with their counts; as none of them is frequent, no task
    gets many rows of one. Texts are cut into words once; what is written between holds eight bytes for each such word. A row's words are told by a hash of its doc_id and text; rows equal in both have equal means.
    """
    top = counts.where(F.col("n") * common >= float(totals.sum())).toArrow()
    hashes = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    logs_of = np.log(top.column("n").to_numpy()[order]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, net, -np.log(np.maximum(totals, 1)), hashes[order], logs_of))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("key"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, net, share, table, logs_of = shared.value
        for chunk in chunks(batches):
            t = Tokens(chunk.column("text"), frequent)
            at, there = _places(table, t.hash)
            logs = share[t.classes] + (np.where(there, logs_of[at], 0) if len(table) else 0)
            for b in range(0, len(logs), BATCH):
                at = np.arange(b, min(b + BATCH, len(logs)))
                logs[at] += forward(net, t.context(at), t.classes[at])[-1]
            total = np.bincount(t.doc, logs, minlength=chunk.num_rows).astype(float)  # of no words numpy makes whole numbers
            offs = np.concatenate([[0], np.cumsum(np.bincount(t.doc[~there], minlength=chunk.num_rows))])
            rest = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(t.hash[~there].view(np.int64)))
            yield pa.RecordBatch.from_arrays([chunk.column("key"), chunk.column("doc_id"), pa.array(t.counts), pa.array(total), rest], names=["key", "doc_id", "n_tokens", "known", "rest"])

    first = written(keyed.mapInArrow(known, "key long, doc_id long, n_tokens long, known double, rest array<long>"), "known")
    rare = first.select("key", F.explode("rest").alias("word")).join(counts.where(F.col("n") * common < float(totals.sum())), "word", "left")
    means = rare.groupBy("key").agg(F.avg(F.log(F.coalesce("n", F.lit(1)))).alias("mean"))
    both = first.select("key", "doc_id", "n_tokens", "known", F.size("rest").alias("rest")).join(means, "key", "left")
    total = F.col("known") + F.col("rest") * F.coalesce("mean", F.lit(0.0))
    return both.select("doc_id", "n_tokens", total.alias("log_likelihood")).withColumn("mean_log_prob", F.expr("CASE WHEN n_tokens > 0 THEN log_likelihood / n_tokens END"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Trains on docs and scores them."""
    counts = vocabulary(docs)
    return score(docs, counts, *train(docs, counts))
