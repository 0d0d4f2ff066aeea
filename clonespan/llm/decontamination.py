"""Benchmark decontamination: training tokens stream through a suffix automaton of the normalised test items."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded_batches, text_of

#: Words of an item that make a window, and the words that one automaton holds at most (more items: more automata in a row).
WINDOW, AUTOMATON_WORDS = 10, 500_000
#: Fixed class: bytes outside 0-9, A-Z, a-z and non-ASCII separate words; A-Z count as a-z.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton over the words of the items: its states are the sets of equal ends of item substrings."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        coded = []
        for name, words in items:
            if words:
                coded.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
                self.names.append(name)
        for word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        self.shortest = min([window, *map(len, coded)])
        self._own(coded)
        self._at: dict[int, tuple[int, list[tuple[int, int]]]] = {}

    def _new(self, length: int, link: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the substrings of q that p's, prolonged by c, reach: q itself or its shorter part, split off."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        self.link[q] = part
        return part

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        self.link[state] = self._split(p, self.next[p][c], c) if p >= 0 else 0
        return state

    def _own(self, coded: list[list[int]]) -> None:
        """Which items have the substrings of a state, and which short items end in it as a whole."""
        self.items: list[set[int]] = [set() for _ in self.next]
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, word_ids in enumerate(coded):
            state = 0
            for c in word_ids:
                state = self.next[state][c]
                v = state
                while v > 0 and i not in self.items[v]:
                    self.items[v].add(i)
                    v = self.link[v]
            if len(word_ids) < self.window:
                while self.length[self.link[state]] >= len(word_ids):
                    state = self.link[state]
                self.short.setdefault(state, []).append((len(word_ids), i))

    def _ends(self, state: int) -> tuple[int, list[tuple[int, int]]]:
        """For a match that stands in `state`: the state of its last `window` words, and the short items on the way to the root."""
        if state not in self._at:
            full, short, v = -1, [], state
            while v > 0:
                if self.length[self.link[v]] < self.window <= self.length[v]:
                    full = v
                short += self.short.get(v, [])
                v = self.link[v]
            self._at[state] = full, short
        return self._at[state]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int], int]:
        """Which words are hit, the items whose windows occur, and the longest match in words."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= self.shortest
        hit, found, longest = None, set(), 0
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            state, matched = 0, 0
            for i, c in enumerate(ids[s:e].tolist(), s):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                state, matched = self.next[state][c], matched + 1
                longest = max(longest, matched)
                if matched < self.shortest:
                    continue
                full, short = self._ends(state)
                reach = 0
                if matched >= self.window:
                    reach = self.window
                    found |= self.items[full]
                for n, item in short:
                    if n <= matched:
                        reach = max(reach, n)
                        found.add(item)
                if reach:
                    if hit is None:
                        hit = np.zeros(len(words), bool)
                    hit[i + 1 - reach : i + 1] = True
        return hit, found, longest


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def automata(benchmark: DataFrame, window: int, most_words: int) -> list[Automaton]:
    """Automata over the items in blocks of at most `most_words` words (a longer item has one of its own)."""
    out, block, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_of().cast("binary").alias("text")).distinct()
    for item in rows.orderBy("item_id", "text").toLocalIterator():
        words = bytes(item["text"]).translate(NORMAL).split()
        if block and size + len(words) > most_words:
            out.append(Automaton(block, window))
            block, size = [], 0
        block.append((item["item_id"], words))
        size += len(words)
    return [*out, Automaton(block, window)] if block else out


def scan(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), clean: bool = False, max_coverage: float = 0.5, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Per document: the `carry` columns, n_words, n_hit, longest_match, item_ids (sorted), spans (word ranges hit); with `clean`
    also text (less the spans hit) and `rejected` (more than `max_coverage` of its words are hit).

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.  A word is hit if it
    lies in an occurrence of a window.  Removal repeats until nothing is hit, for what a removal joins may match anew.  Every
    task builds the automata's tables once from broadcast copies of `automaton_words` words at most each; documents pass one
    after the other.  There is no shuffle.

    Null or empty text: no words, no hits.  Null item ids match but are not listed.  Items without words, and an empty
    benchmark, match nothing.  Repeated rows are scanned one by one.  Empty table: no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = [spark.sparkContext.broadcast(a) for a in automata(benchmark, window, automaton_words)]
    kept = [c for c in carry if c not in ("text", "n_words", "n_hit", "longest_match", "item_ids", "spans", "rejected")]
    source = docs.select(*[docs[f"`{c}`"] for c in kept], text_of().cast("binary").alias("_text"))

    def hits(words):
        hit, items, longest = None, set(), 0
        for a in held:
            h, found, m = a.value.scan(words)
            longest = max(longest, m)
            if h is not None:
                hit = h if hit is None else hit | h
                items.update(a.value.names[i] for i in found)
        return hit, items, longest

    def cleaned(text: bytes) -> bytes:
        while True:
            normal = text.translate(NORMAL)
            hit, _, _ = hits(normal.split())
            if hit is None:
                return text
            places = [m.span() for m in _WORD.finditer(normal)]
            out, at = [], 0
            for s, e in spans_of(hit):
                out.append(text[at : places[s][0]])
                at = places[e - 1][1]
            text = b"".join([*out, text[at:]])

    def run(batches):
        for b in batches:
            n_words, n_hit, longest, items, spans, texts, rejected = [], [], [], [], [], [], []
            for x in b.column("_text"):
                text = x.as_py()
                words = text.translate(NORMAL).split()
                hit, found, most = hits(words)
                n = 0 if hit is None else int(hit.sum())
                n_words.append(len(words))
                n_hit.append(n)
                longest.append(most)
                items.append(sorted(i for i in found if i is not None))
                spans.append([] if hit is None else [{"start": s, "end": e} for s, e in spans_of(hit)])
                if clean:
                    rejected.append(n > max_coverage * len(words))
                    texts.append(text if hit is None else cleaned(text))
            columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(longest, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names = ["n_words", "n_hit", "longest_match", "item_ids", "spans"]
            if clean:
                columns += [pa.array(texts, pa.binary()), pa.array(rejected, pa.bool_())]
                names += ["text", "rejected"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *columns], names=[*kept, *names])

    results = "n_words bigint, n_hit bigint, longest_match bigint, item_ids array<string>, spans array<struct<start:bigint,end:bigint>>"
    results += ", text binary, rejected boolean" if clean else ""
    schema = T.StructType([*[f for f in source.schema if f.name != "_text"], *T.StructType.fromDDL(results)])
    out = source.mapInArrow(run, schema)
    return out.withColumn("text", F.col("text").cast("string")) if clean else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """`docs` without the documents that are mostly test items, and without the hit spans of the others; n_chars follows.

    Untouched documents keep their text, null included.  Same columns as `docs`; all but text and n_chars keep their values,
    also those that are called like a result of `scan`.
    """
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), "text")
    out = scan(rows, benchmark, carry=("_row",), clean=True, **limits).filter("not rejected")
    new = {"text": F.when(F.col("_row")["text"].isNotNull(), F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_hit") > 0, F.length("text")).otherwise(F.col("_row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
