"""Fill-in-middle transformation: texts are cut into prefix, middle and suffix at line ends and put together in another order.

The bytes of a batch of texts are viewed as 64-bit words.  Arithmetic on whole words marks the bytes that end a line; the bits
of each word are counted and summed up.  The place of a line end is then a search of its rank in these sums, which gives the
word, and a select among the marks of that word.  Code points are counted the same way, over marks of their first bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, text_of, without
from .tokens import texts as bytes_of

#: The marks of the three parts, and the byte that ends a unit.
PREFIX, SUFFIX, MIDDLE, NEWLINE = "<P>", "<S>", "<M>", 0x0A
SEVEN, HIGH, ONE = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080), np.uint64(1)
RESULTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def words64(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, the last one filled with zeros and a spare word behind it."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def marks_of(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals `byte` (no carry crosses a byte, so there are no false marks)."""
    x = words ^ np.uint64(byte * 0x0101010101010101)
    return ~(((x & SEVEN) + SEVEN) | x | SEVEN)


def starts_of(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a code point: all but 10xxxxxx."""
    return (~words | (words << ONE)) & HIGH


class Ranked:
    """Marks of words with running counts."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks on the bytes before `at`."""
        word = at >> 3
        below = (ONE << (np.uint64(8) * (at & 7).astype(np.uint64))) - ONE
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, rank: np.ndarray) -> np.ndarray:
        """Place of the byte with the rank-th mark, counted from 1."""
        word = np.searchsorted(self.before, rank, "left") - 1
        left, bits = rank - self.before[word] - 1, self.marks[word].copy()
        for k in range(7):  # drop the lowest mark of those words where the wanted one is further up
            bits = np.where(left > k, bits & (bits - ONE), bits)
        return word * 8 + (np.bitwise_count((bits & (~bits + ONE)) - ONE) >> 3)


def cuts(data: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per text data[offsets[t]:offsets[t + 1]]: lines, end of prefix and of middle (bytes), code points of prefix and middle."""
    words = words64(data)
    ends, points = Ranked(marks_of(words, NEWLINE)), Ranked(starts_of(words))
    start, stop = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    before = ends.rank(start)
    full = ends.rank(stop) - before
    tail = np.zeros(len(start), bool)
    filled = stop > start
    tail[filled] = data[stop[filled] - 1] != NEWLINE
    n = full + tail
    one, two = x % (n + 1), y % (n + 1)
    place = []
    for k in (np.minimum(one, two), np.maximum(one, two)):
        at = np.where(k == 0, start, stop)
        inner = (k > 0) & (k <= full)
        at[inner] = ends.select(before[inner] + k[inner]) + 1
        place.append(at)
    ranks = [points.rank(p) for p in (start, *place)]
    return n, *place, ranks[1] - ranks[0], ranks[2] - ranks[1]


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from seed and key (null: empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """`docs` with n_units, form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    A unit is a line with its line feed, or what follows the last one.  Both cuts are drawn from seed and doc_id among the n + 1
    places around the n units; `rate` of 100 texts are transformed, `spm_rate` of 100 of these with the suffix first.  Texts that
    hold one of the marks, and empty texts, stay plain.

    Null text: as an empty one, output empty.  Null doc_id draws as an empty key.  Repeated rows come out alike.  Columns of
    `docs` with a result's name (in any case) give way to it; a struct carries the others.  A text is one row: it must fit a
    task's memory several times.  Empty table: no rows.
    """
    bounded_batches(docs.sparkSession)
    rest = without(docs, *RESULTS)
    text = text_of()
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    source = rest.select(F.struct(*[rest[f"`{c}`"] for c in rest.columns]).alias("row"), text.cast("binary").alias("text"), h1.alias("x"), h2.alias("y"), form.alias("form"))
    p, s, m = (v.encode() for v in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        for b in batches:
            data, offsets = bytes_of(b.column("text"))
            base = int(offsets[0])
            data = data[base : int(offsets[-1])]
            offsets = offsets - base
            n, one, two, prefix, middle = cuts(data, offsets, b.column("x").to_numpy(), b.column("y").to_numpy())
            out, forms = [], b.column("form").to_pylist()
            view = memoryview(np.ascontiguousarray(data))
            for form, lo, i, j, hi in zip(forms, offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist()):
                if form == "plain":
                    out.append(bytes(view[lo:hi]))
                elif form == "psm":
                    out.append(b"".join((p, view[lo:i], s, view[j:hi], m, view[i:j])))
                else:
                    out.append(b"".join((s, view[j:hi], p, view[lo:i], m, view[i:j])))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(n, pa.int64()), b.column("form"), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary())],
                names=["row", *RESULTS],
            )

    schema = T.StructType([source.schema["row"], *T.StructType.fromDDL("n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")])
    return source.mapInArrow(run, schema).select("row.*", *RESULTS[:-1], F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` made `output` of.  A transformed text holds each mark once, as it held none before."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(part[2], part[3], part[1]))
