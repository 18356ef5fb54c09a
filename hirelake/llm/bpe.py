"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end the BPE encoding of that prefix: the token t for
which (last token of the shorter prefix, t) is a pair that BPE itself would leave side by side. Storing that token for
every prefix gives the encoding by walking back, lets bytes be appended without looking at more than the longest
token's length, and lets an edit be re-encoded only as far as its effect reaches.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import chunks

#: Pieces whose encoding a worker remembers before it forgets all and starts again.
CACHE_PIECES = 300_000
SCHEMA = "doc_id long, ids array<int>, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def split_table(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of two bytes or more, the two tokens whose merge makes it; absent where no merges lead to it."""
    table = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            table[rank] = (ranks[parts[0]], ranks[parts[1]])
    return table


class Encoder:
    def __init__(self, ranks: dict[bytes, int], splits: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.splits = split_table(ranks) if splits is None else splits
        self.merges = {pair: rank for rank, pair in self.splits.items()}
        self.longest = max(map(len, ranks))
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Each beginning of a token to the token it is, or -1.
        self.heads = {token[:i]: -1 for token in ranks for i in range(1, len(token))} | ranks

    def stable(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens side by side.

        Undo merges on both sides of the seam, the latest first. If at some point the two tokens at the seam merge
        into a token that comes before the one just undone, BPE would have merged across the seam.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, bound = left, right, 1 << 60
        while True:
            if self.merges.get((a, b), bound) < bound:
                good = False
                break
            split_a, split_b = self.splits.get(a), self.splits.get(b)
            if split_a is None and split_b is None:
                good = True
                break
            # At equal rank the left one merges first, so the right one is undone first.
            if split_b is None or split_a is not None and a > b:
                bound, a = a, split_a[1]
            else:
                bound, b = b + 1, split_b[0]
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        self.pairs[left, right] = good
        return good

    def extend(self, piece: bytes, last: list[int], size: list[int]) -> None:
        """Add the last token, and its length, of each prefix of the piece that is longer than those stored.

        Tokens are tried from each place in turn; as one token only can end a prefix, the first that fits is the one.
        """
        known, n, heads, pairs, stable = len(last), len(piece), self.heads.get, self.pairs.get, self.stable
        last += [-1] * (n - known)
        size += [0] * (n - known)
        for begin in range(max(0, known + 1 - self.longest), n):
            before = last[begin - 1] if begin else None
            for end in range(max(begin, known) + 1, n + 1):
                token = heads(piece[begin:end])
                if token is None:
                    break
                if token >= 0 and last[end - 1] < 0:
                    if begin:
                        good = pairs((before, token))
                        if not (stable(before, token) if good is None else good):
                            continue
                    last[end - 1] = token
                    size[end - 1] = end - begin
            if last[begin] < 0:
                raise ValueError("the vocabulary lacks a byte")

    def encode(self, piece: bytes) -> list[int]:
        last: list[int] = []
        size: list[int] = []
        self.extend(piece, last, size)
        return walk(last, size)

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Encodes pieces in order; what a piece shares with the one before it at its front is kept, and the rest appended."""
        last: list[int] = []
        size: list[int] = []
        before = b""
        for piece in pieces:
            shared, most = 0, min(len(piece), len(before))
            while shared < most and piece[shared] == before[shared]:
                shared += 1
            del last[shared:], size[shared:]
            self.extend(piece, last, size)
            yield walk(last, size)
            before = piece

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def walk(last: list[int], size: list[int]) -> list[int]:
    out, end = [], len(last)
    while end:
        out.append(last[end - 1])
        end -= size[end - 1]
    return out[::-1]


class Piece:
    """The stored prefixes of one piece, for appends and edits."""

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.piece, self.last, self.size = encoder, b"", [], []
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.encoder.extend(self.piece, self.last, self.size)

    def replace(self, begin: int, end: int, by: bytes) -> int:
        """Put ``by`` in place of the bytes begin..end; returns how many prefixes had to be looked at."""
        old_last, old_size, shift = self.last[end:], self.size[end:], begin + len(by)
        self.piece = self.piece[:begin] + by + self.piece[end:]
        self.last, self.size = self.last[:begin], self.size[:begin]
        alike, looked = 0, 0
        while len(self.last) < len(self.piece):
            self.encoder.extend(self.piece[: len(self.last) + 1], self.last, self.size)
            looked += 1
            at = len(self.last) - 1 - shift
            alike = alike + 1 if at >= 0 and self.last[-1] == old_last[at] and self.size[-1] == old_size[at] else 0
            if alike >= self.encoder.longest:  # what follows depends on no prefix that differs
                self.last += old_last[at + 1 :]
                self.size += old_size[at + 1 :]
                break
        return looked

    def ids(self) -> list[int]:
        return walk(self.last, self.size)


class Pieces(dict):
    """Piece of text to its ids, as packed int32."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def learn(self, found: list[list[str]]) -> None:
        if len(self) >= CACHE_PIECES:
            self.clear()
        new = sorted(p.encode() for p in set().union(*found) - self.keys())
        for piece, ids in zip(new, self.encoder.encode_sorted(new), strict=True):
            self[piece.decode()] = array("i", ids).tobytes()


_workers: dict[tuple, tuple] = {}


def _encoder(key: tuple, shared) -> tuple:
    """The encoder of this worker process; vocabularies are few and small, so the last one is kept."""
    if key not in _workers:
        _workers.clear()
        ranks, splits = shared.value
        encoder = Encoder(ranks, splits)
        size = max(ranks.values()) + 1
        lengths, table = np.zeros(size, np.int64), [encoder.bytes_of.get(i, b"") for i in range(size)]
        lengths[:] = list(map(len, table))
        _workers[key] = encoder, Pieces(encoder), lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(table), np.uint8)
    return _workers[key]


def _lists(counts: np.ndarray, kind: pa.DataType, values: pa.Array | np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]) if kind == pa.binary() else pa.ListArray.from_arrays(offsets, values)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``ids`` and ``decoded`` (the bytes that the ids stand for) of every text; one row for each row of docs.

    A null or empty text has no ids. Columns other than doc_id and text are ignored, repeated rows give repeated
    results, and a null doc_id stays null. There is no shuffle. The vocabulary is read on the driver and broadcast;
    it is bounded by the file, not by the documents. A worker remembers at most ``CACHE_PIECES`` encoded pieces.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, split_table(ranks)))
    key = (ranks_path, len(ranks), hash(frozenset(ranks.items())))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces, lengths, starts, table = _encoder(key, shared)
        find = regex.compile(pattern).findall
        for chunk in chunks(batches):
            found = [find(text) if text else [] for text in chunk.column("text").to_pylist()]
            pieces.learn(found)
            packed = [b"".join(map(pieces.__getitem__, each)) for each in found]
            ids = np.frombuffer(b"".join(packed), np.int32)
            counts = np.array([len(p) // 4 for p in packed], np.int64)
            sizes = lengths[ids]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            data = table[np.repeat(starts[ids] - ends + sizes, sizes) + np.arange(total)]
            bounds = np.concatenate([[0], np.cumsum(counts)])
            per_doc = np.diff(np.concatenate([[0], ends])[bounds])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id").cast(pa.int64()), _lists(counts, pa.list_(pa.int32()), pa.array(ids)), _lists(per_doc, pa.binary(), data)], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, SCHEMA)
