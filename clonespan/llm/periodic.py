"""Periodic runs of words: k-gram seeds on diagonals, extended word by word.

A run of period q and at least `exponent` periods agrees with itself, shifted by q, on (exponent - 1) * q words or more.  Lags are
cut into levels; the k of a level is the overlap that its smallest lag guarantees, and never below its largest lag.  So every
run holds two equal k-grams q words apart, and between these none that is equal (the k-gram covers a whole period, and a
smallest period repeats no sooner): each occurrence need only be paired with the next one of the same document.

A pair is a seed on the diagonal of its lag.  Seeds pass in order of place; a table of the furthest word covered per lag skips
those that lie in a stretch already found, the others are extended both ways by comparing words.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, text_of, without, words_of
from .tokens import mix, ranges_hash

#: Texts of a batch are worked on in pieces of about so many bytes (a longer text is a piece of its own).
PIECE_BYTES = 1 << 20
#: Words compared at first when a seed is extended; the step doubles.
STEP = 32
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def levels(longest: int, length: int, exponent: int) -> list[tuple[int, int]]:
    """(smallest lag, largest lag) of each level up to lag `longest`; the largest lag is also the level's k."""
    out, lag = [], 1
    while lag <= longest:
        k = max(lag, min(max(length - q, (exponent - 1) * q) for q in range(lag, lag + length)))
        out.append((lag, k))
        lag = k + 1
    return out


def seeds(code: np.ndarray, first: np.ndarray, low: int, k: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of k-grams and the next equal one of the same text, lags from `low` to k, in order of place."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(code) - k + 1) if len(code) >= k else np.zeros(0, np.int64)
    at = at[(doc[at] == doc[at + k - 1]) & (n[doc[at]] >= exponent * low)]
    gram = ranges_hash(code, at, at + k)
    order = np.argsort(gram, kind="stable")
    left, right = at[order[:-1]], at[order[1:]]
    lag = right - left
    same = (gram[order[:-1]] == gram[order[1:]]) & (doc[left] == doc[right]) & (lag >= low) & (lag <= k)
    by_place = np.argsort(left[same], kind="stable")
    return left[same][by_place], lag[same][by_place]


def agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many of the first words of x and y agree."""
    n, at, step = min(len(x), len(y)), 0, STEP
    while at < n:
        differ = np.flatnonzero(x[at : min(n, at + step)] != y[at : min(n, at + step)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def runs_of(code: np.ndarray, first: np.ndarray, length: int = 6, exponent: int = 4) -> list[list[tuple[int, int, int]]]:
    """Per text (its words' codes: code[first[t]:first[t + 1]]) the runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    hashed = mix(code.astype(np.uint64) + np.uint64(1))
    for low, k in levels(int(np.diff(first).max(initial=0)) // exponent, length, exponent):
        places, lags = seeds(hashed, first, low, k, exponent)
        covered: dict[int, int] = {}
        texts = np.searchsorted(first, places, "right") - 1
        for at, lag, t in zip(places.tolist(), lags.tolist(), texts.tolist()):
            if at < covered.get(lag, 0):
                continue
            lo, hi = int(first[t]), int(first[t + 1])
            right = at + agreeing(code[at : hi - lag], code[at + lag : hi])
            left = at - agreeing(code[lo:at][::-1], code[lo + lag : at + lag][::-1])
            covered[lag] = max(right, at + 1)
            if right - left + lag >= max(length, exponent * lag):
                out[t].append((left - lo, right - left + lag, lag))
    return [sorted(set(x), key=lambda r: (r[0], r[2])) for x in out]


def best_of(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _of_piece(texts: list[bytes], length: int, exponent: int) -> list[tuple]:
    """(runs, best run, words, words dropped, collapsed text) of each text."""
    numbers: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    code = np.fromiter((numbers.setdefault(x, len(numbers)) for w in words for x in w), np.int64, int(first[-1]))
    out = []
    for w, runs in zip(words, runs_of(code, first, length, exponent)):
        keep = np.ones(len(w), bool)
        for start, size, period in runs:
            keep[start + period : start + size] = False
        kept = [w[i] for i in np.flatnonzero(keep)] if runs else w
        out.append((runs, best_of(runs), len(w), len(w) - len(kept), b" ".join(kept)))
    return out


def periodic_runs(docs: DataFrame, length: int = 6, exponent: int = 4) -> DataFrame:
    """`docs` with n_words, n_dropped, runs (array of start, length, period, by start, then period), best (the run of the
    greatest length / period; ties: smallest start, then period; null if there is none) and collapsed.

    A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least
    max(length, exponent * q) words that no neighbouring word extends keeping the period; length is 2 or more, exponent 3 or
    more.  Words stand between ASCII white space and are compared as they are.  `collapsed` is the text's words less those that
    a run holds after its first q words, joined by one space.

    Null and empty texts, and texts without words: no runs, `collapsed` empty.  Other nulls don't matter.  Repeated rows
    are treated one by one.  Columns of `docs` with a result's name (in any case) give way to it; a struct carries the others.
    A text is one row: its words must fit a task's memory.  Empty table: no rows.
    """
    if length < 2 or exponent < 3:
        raise ValueError("length must be 2 or more, exponent 3 or more")
    bounded_batches(docs.sparkSession)
    rest = without(docs, "n_words", "n_dropped", "runs", "best", "collapsed")
    source = rest.select(F.struct(*[rest[f"`{c}`"] for c in rest.columns]).alias("row"), text_of().cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            texts, done = [x.as_py() for x in b.column("text")], []
            ends = np.cumsum([len(t) for t in texts])
            while len(done) < len(texts):
                base = int(ends[len(done) - 1]) if done else 0
                upto = max(len(done) + 1, int(np.searchsorted(ends, base + PIECE_BYTES, "right")))
                done += _of_piece(texts[len(done) : upto], length, exponent)
            as_run = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"), pa.array([x[2] for x in done], pa.int64()), pa.array([x[3] for x in done], pa.int64()),
                    pa.array([[as_run(r) for r in x[0]] for x in done], pa.list_(_RUN)), pa.array([as_run(x[1]) for x in done], _RUN),
                    pa.array([x[4] for x in done], pa.binary()),
                ],
                names=["row", "n_words", "n_dropped", "runs", "best", "collapsed"],
            )

    schema = T.StructType([source.schema["row"], *T.StructType.fromDDL(f"n_words bigint, n_dropped bigint, runs array<{RUN}>, best {RUN}, collapsed binary")])
    out = source.mapInArrow(run, schema)
    return out.select("row.*", "n_words", "n_dropped", "runs", "best", F.col("collapsed").cast("string").alias("collapsed"))


def repeating(doc_id: Column, text: Column) -> Column:
    """A text whose tail repeats, where crc32 of the decimal doc_id is divisible by 10: each word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = words_of(text)
    n = F.size(words).cast("bigint")
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    block = F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(F.flatten(block), F.lit(1), (n - a).cast("int"))), " ")
    return F.when((h % 10 == 0) & (n > 0), planted).otherwise(text)
