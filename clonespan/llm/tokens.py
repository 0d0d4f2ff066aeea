"""Words, word hashes and window hashes of many texts at once, as numpy arrays over Arrow batches.

Hashes are polynomials over random values modulo 2^64, finished with a mixing function.  Equal byte sequences have equal hashes
everywhere; different ones collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a batch are worked on in pieces of about so many bytes (a longer text is a piece of its own).
PIECE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Fixed class: ASCII white space.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        for k, base in enumerate((BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the sequences values[start:end]; equal sequences have equal hashes wherever they stand."""
    power, inverse = powers(len(values) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)], dtype=np.uint64)))
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of some texts: place in `data` (start, end), hash, and where each text's words begin (`first`, one more than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    rows: slice  # of the batch

    def __post_init__(self) -> None:
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of `width` words inside one text."""
        n = len(self.hash)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(n - width + 1)
        at = at[self.doc[at] == self.doc[at + width - 1]]
        return at, ranges_hash(self.hash, at, at + width)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, lower: bool, piece_bytes: int = PIECE_BYTES) -> Iterator[Words]:
    """The words between ASCII white space of a column's texts, piece by piece; with `lower`, A-Z count as a-z."""
    data, offsets = texts(column)
    at = 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece_bytes, "right")) - 1)
        part = data[offsets[at] : offsets[upto]]
        bounds = offsets[at : upto + 1] - offsets[at]
        yield _words(LOWER[part] if lower else part, bounds, slice(at, upto))
        at = upto


def _words(part: np.ndarray, bounds: np.ndarray, rows: slice) -> Words:
    word = ~IS_SPACE[part]
    n = len(part)
    begins, ends = word.copy(), word.copy()
    inner = bounds[(bounds > 0) & (bounds < n)]
    if n:
        before = np.concatenate(([False], word[:-1]))
        after = np.concatenate((word[1:], [False]))
        before[inner] = False
        after[inner - 1] = False
        begins &= ~before
        ends &= ~after
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(part, start, end, ranges_hash(_BYTE[part], start, end), np.searchsorted(start, bounds), rows)


#: 64-bit words of a membership filter: 2 MB whatever the data; a full filter only passes more rows on to the exact join.
BLOOM_WORDS = 1 << 18


def _bloom_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.concatenate([h, ~h]))
    return (x % np.uint64(BLOOM_WORDS)).astype(np.int64), np.uint64(1) << (x >> np.uint64(58))


def bloom_has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each of the 64-bit values."""
    at, bit = _bloom_places(h)
    found = (words[at] & bit) != 0
    return found[: len(h)] & found[len(h) :]


def bloom_of(values: DataFrame) -> np.ndarray:
    """Filter over the one bigint column of `values`: partial filters per task, folded with bit_or; BLOOM_WORDS rows come to the driver."""
    column = values.columns[0]

    def run(batches):
        words = np.zeros(BLOOM_WORDS, np.uint64)
        for b in batches:
            at, bit = _bloom_places(b.column(column).to_numpy().view(np.uint64))
            np.bitwise_or.at(words, at, bit)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used].view(np.int64))], names=["w", "m"])

    folded = values.mapInArrow(run, "w int, m bigint").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(BLOOM_WORDS, np.int64)
    words[folded.column("w").to_numpy()] = folded.column("m").to_numpy()
    return words.view(np.uint64)
