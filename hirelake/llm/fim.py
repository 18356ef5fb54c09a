"""Fill-in-middle: each text is cut in three and reordered, so that a left-to-right model learns to fill the gap.

A chunk of texts is one sequence of character classes, held as a wavelet matrix. A class says what a byte is (white
space, newline, first or further byte of a character) and whether a word ends with it; rank queries on classes add up to
counts of boundaries and of characters before any place, and bisection on these counts locates all cuts of the chunk at
once. Cuts lie between units of whole words (the default), lines or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import chunks, flat, words

MARKS = ("<P>", "<S>", "<M>")
_SPACE, _NEWLINE, _FIRST, _FURTHER, _ENDS = 0, 1, 2, 3, 4
#: The classes with which a unit ends; a character is counted by its first byte instead.
UNITS = {
    "words": (_ENDS | _SPACE, _ENDS | _NEWLINE, _ENDS | _FIRST, _ENDS | _FURTHER),
    "lines": (_NEWLINE, _ENDS | _NEWLINE),
    "characters": (_SPACE, _NEWLINE, _FIRST, _ENDS | _SPACE, _ENDS | _NEWLINE, _ENDS | _FIRST),
}


class WaveletMatrix:
    """Symbols of some bits each: a row of bits a level, highest first, sorted stably by the bits of the levels above."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size, self.levels = bits, len(symbols), []
        for shift in reversed(range(bits)):
            bit = (symbols >> shift & 1).astype(bool)
            words = np.packbits(np.pad(bit, (0, 64 - len(bit) % 64)), bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((words, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        words, before, _ = self.levels[level]
        block, place = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(words[block] & ((np.uint64(1) << place) - np.uint64(1)))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each place."""
        begin, end = np.zeros(1, np.int64), at
        for level, (_, _, zeros) in enumerate(self.levels):
            ones = self._ones(level, begin), self._ones(level, end)
            begin, end = (zeros + ones[0], zeros + ones[1]) if symbol >> (self.bits - 1 - level) & 1 else (begin - ones[0], end - ones[1])
        return end - begin

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How often any of the symbols stands before each place."""
        return sum((self.rank(s, at) for s in symbols), np.zeros(len(at), np.int64))

    def find(self, symbols: tuple[int, ...], wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least place from low to high before which ``wanted`` of the symbols stand; high if there are fewer."""
        low, high = low.copy(), high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            enough = self.count(symbols, middle) >= wanted[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1
        return low


def classes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The class of each byte: its kind, and ``_ENDS`` for the last byte of a word or of white space that ends a text."""
    out = np.where((data & 0xC0) == 0x80, _FURTHER, _FIRST).astype(np.uint8)
    out[(data == 0x20) | (data >= 0x09) & (data <= 0x0D)] = _SPACE
    out[data == 0x0A] = _NEWLINE
    last = offs[1:][np.diff(offs) > 0] - 1
    out[last[out[last] < _FIRST]] |= _ENDS
    out[words(data, offs)[1] - 1] |= _ENDS
    return out


class Cutter:
    """Counts units and characters of a chunk of texts, and finds where a number of units ends."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, unit: str):
        self.data, self.begin, self.end, self.unit, self.ends = data, offs[:-1], offs[1:], unit, UNITS[unit]
        self.matrix = WaveletMatrix(classes(data, offs), 3)
        self.before = self.matrix.count(self.ends, self.begin)
        self.units = self.matrix.count(self.ends, self.end) - self.before
        if unit == "lines":  # what follows the last newline is a line too
            self.units += (self.end > self.begin) & (data[self.end - 1] != 0x0A) if len(data) else 0

    def cut(self, which: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The place in the chunk after so many units of each of the texts."""
        wanted, begin, end = self.before[which] + units, self.begin[which], self.end[which]
        if self.unit != "characters":
            return self.matrix.find(self.ends, wanted, begin, end)
        place = self.matrix.find(self.ends, wanted + 1, begin, end)  # just behind the next character's first byte
        return np.where(units < self.units[which], place - 1, end)

    def characters(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        further = lambda at: self.matrix.count((_FURTHER, _ENDS | _FURTHER), at)
        return end - begin - further(end) + further(begin)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: str = "42", rate: int = 50, spm_rate: int = 80, unit: str = "words") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and output (the reordered text), one row for each row of docs.

    n counts the text's units. Four numbers from the sha256 of seed and key draw the two cuts and the form: ``rate`` of a
    hundred texts are reordered, ``spm_rate`` of a hundred of these as spm (suffix, prefix, middle), the others as psm.
    Empty texts and those that hold a mark stay plain: their output is the text and the two lengths are null. A null
    text is an empty one, a null key draws as an empty key, rows that repeat give equal rows; other columns are ignored
    and an empty table gives an empty one. Nothing is shuffled. A worker holds ``arrays.CHUNK_BYTES`` of texts at a time,
    or one longer text with some 20 bytes more for each of its bytes.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda i: F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.greatest(*[text.contains(m) for m in MARKS])
    form = F.when((text == "") | marked | (draw(2) % 100 >= rate), "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(F.col(key), draw(0).alias("a"), draw(1).alias("b"), form.alias("form"), text.alias("text"))
    prefix, suffix, middle = (m.encode() for m in MARKS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            data, offs = flat(chunk.column("text"))
            cutter = Cutter(data, offs, unit)
            forms = chunk.column("form").to_pylist()
            which = np.array([i for i, f in enumerate(forms) if f != "plain"], np.int64)
            drawn = np.sort(np.stack([chunk.column(c).to_numpy()[which] % (cutter.units[which] + 1) for c in "ab"]), axis=0)
            first, second = cutter.cut(which, drawn[0]), cutter.cut(which, drawn[1])
            raw, ends = data.tobytes(), offs.tolist()
            outputs = [raw[x:y] for x, y in zip(ends, ends[1:])]  # noqa: B905
            for i, x, y in zip(which.tolist(), first.tolist(), second.tolist(), strict=True):
                head, mid, tail = raw[ends[i] : x], raw[x:y], raw[y : ends[i + 1]]
                outputs[i] = b"".join((prefix, head, suffix, tail, middle, mid) if forms[i] == "psm" else (suffix, tail, prefix, head, middle, mid))
            lengths = np.full((2, chunk.num_rows), -1, np.int64)
            lengths[0, which], lengths[1, which] = cutter.characters(offs[which], first), cutter.characters(first, second)
            sizes = [pa.array(x, mask=x < 0) for x in lengths]
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(cutter.units), chunk.column("form"), *sizes, pa.array(outputs, pa.binary())], names=names)

    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]
    kind = docs.select(key).schema[0].dataType.simpleString()
    out = rows.mapInArrow(cut, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text again, from output and form alone: a reordered text holds each mark once, as its own text held none."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "|".join(MARKS))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


ORACLE = r"""
WITH h AS (SELECT coalesce(text, '') AS t, doc_id, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, t, w, len(w) AS n, CAST('0x' || s[1:8] AS BIGINT) % (len(w) + 1) AS x, CAST('0x' || s[9:16] AS BIGINT) % (len(w) + 1) AS y, CAST('0x' || s[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || s[25:32] AS BIGINT) % 100 AS h4 FROM h),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[:least(x, y)], '') AS a, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
