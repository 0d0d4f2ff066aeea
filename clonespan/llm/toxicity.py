"""Toxicity by the nearest labelled examples: exact TF-IDF cosine with a block-max inverted index.

Examples and documents are vectors over all terms of the examples, weighted by the terms' document frequencies in the whole
corpus; terms that speak for the label (log-likelihood ratio over the labelled sample) weigh more.  The index cuts the examples
into blocks of similar ones.  Postings of rare terms are added up; of frequent terms it knows the weights as a matrix per block and
the largest weight per block, and blocks are multiplied best bound first, until no bound can reach the k-th best example; this in
single precision with room for its error, what may be among the k best is summed in double precision.
Documents are looked up many at a time.  Neighbours vote by similarity, and the votes are calibrated on the examples themselves,
each left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import NORMAL
from .labelled import fold, training_sample
from .shared import bounded_batches, saved, text_of

#: Neighbours; examples per block; blocks scored at first; bytes of the word beginnings that count as terms; most examples of a class.
NEIGHBOURS, BLOCK, FIRST_BLOCKS, BEGINNINGS, EXAMPLES_PER_CLASS = 25, 128, 4, (5, 7), 6_000
#: Frequent terms: a matrix row each, at most so many, each in one of so many examples at least; documents looked up at once.
DENSE_TERMS, DENSE_SHARE, QUERIES = 1_280, 30, 256
#: Part of a sum of frequent terms that single precision may miss, on both sides of a comparison: several times DENSE_TERMS roundings.
SLACK = 1e-3
#: Groups of similar examples that blocks are cut from, and the rounds in which they are found.
GROUPS, GROUP_ROUNDS = 48, 4
#: Bytes of the texts whose words are numbered at once.
CHUNK_BYTES = 1 << 21
#: Tasks that the examples are dealt to.
SAMPLE_TASKS = 24
#: Weight of the prior in a vote; documents of label 1 with a term that weighs more, for one of label 0, at least.
PRIOR_WEIGHT, PURITY = 0.5, 3.0


def terms_of(text: bytes) -> Counter:
    """How often each word (letters and digits, A-Z lower-cased) and each beginning of a longer word occurs."""
    words = Counter(text.translate(NORMAL).split())
    out = Counter(words)
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k] + b"*"] += n
    return out


def vocabulary(sample: DataFrame, n_positive: int, n_negative: int, weight: dict[int, float]) -> tuple[list[bytes], np.ndarray]:
    """All terms of the sample and their factors: 1, and more for those that speak for label 1.  By far most documents with such
    a term have it (PURITY; classes weighing as among all labelled rows); the factor grows by what the likelihood ratio exceeds
    one that chance gives to about one of all terms.  Counted in parts per task, summed by term."""

    def run(batches):
        counts: dict[bytes, list[int]] = {}
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                for term in terms_of(text):
                    counts.setdefault(term, [0, 0])[label] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]], names=["term", "n0", "n1"]
        )

    terms = saved(sample.mapInArrow(run, "term binary, n0 bigint, n1 bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    n_terms = terms.count()
    if not (n_terms and n_positive and n_negative):
        found = terms.select("term").orderBy("term").toArrow()["term"].to_pylist()
        return found, np.ones(len(found))
    n, n1 = F.col("n0") + F.col("n1"), F.col("n1")
    total, share = float(n_positive + n_negative), n_positive / (n_positive + n_negative)
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = 2 * (
        part(n1, n * share) + part(F.col("n0"), n * (1 - share))
        + part(n_positive - n1, (total - n) * share) + part(n_negative - F.col("n0"), (total - n) * (1 - share))
    )
    speaks = n1 * weight[1] > PURITY * F.col("n0") * weight[0]
    factor = F.when(speaks, 1 + F.greatest(ratio - 2 * math.log(n_terms), F.lit(0.0))).otherwise(1.0)
    found = terms.select("term", factor.alias("factor")).orderBy("term").toArrow()
    return found["term"].to_pylist(), found["factor"].to_numpy()


def document_vectors(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Rows of `docs` (doc_id, vector): how often each of the terms occurs in the whole text, as `packed`.  Written, since all texts
    are needed twice: for document frequencies and to be scored."""
    held = docs.sparkSession.sparkContext.broadcast(Lookup(terms))

    def run(batches):
        for b in batches:
            rows = []
            for start, found, count in term_counts(b.column("text").to_pylist(), held.value):
                rows += packed(start, found, count)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "vector"])

    rows = docs.select("doc_id", text_of().cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return saved(rows.mapInArrow(run, f"doc_id {kind}, vector binary"), compression="zstd")


def packed(start: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Each text's terms, as differences to the term before, and counts, as 4-byte numbers byte plane by byte plane."""
    step = np.diff(terms, prepend=0)
    first = start[:-1][start[:-1] < start[1:]]
    step[first] = terms[first]
    both = np.stack([step, counts]).astype("<u4")
    return [np.ascontiguousarray(both[:, i:j]).view(np.uint8).reshape(-1, 4).T.tobytes() for i, j in zip(start[:-1].tolist(), start[1:].tolist())]


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of a text."""
    step, counts = np.ascontiguousarray(np.frombuffer(vector, np.uint8).reshape(4, -1).T).view("<u4").reshape(2, -1).astype(np.int64)
    return np.cumsum(step), counts


def document_frequencies(vectors: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents; counted in parts per task."""

    def run(batches):
        seen, n = np.zeros(n_terms, np.int64), 0
        for b in batches:
            found = [unpacked(v)[0] for v in b.column("vector").to_pylist()]
            seen += np.bincount(np.concatenate([np.zeros(0, np.int64), *found]), minlength=n_terms)
            n += len(found)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], some)), pa.int32()), pa.array(np.concatenate(([n], seen[some])), pa.int64())], names=["term", "n"])

    rows = vectors.select("vector").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["term"].to_pylist(), rows["n"].to_pylist()))
    return np.array([found.get(i, 0) for i in range(n_terms)], float), found.get(-1, 0)


class Lookup:
    """The numbers of terms, and of the beginnings of each of them that are terms (-1: none)."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.prepare()

    def prepare(self) -> None:
        self.number = dict(zip(self.terms, range(len(self.terms))))
        self.beginnings = np.empty((len(self.terms), len(BEGINNINGS)), np.int32)
        for column, k in enumerate(BEGINNINGS):
            self.beginnings[:, column] = self.beginning(self.terms, k)

    def __len__(self) -> int:
        return len(self.terms)

    def __getstate__(self) -> bytes:
        return b" ".join(self.terms)

    def __setstate__(self, state: bytes) -> None:
        self.terms = state.split()
        self.prepare()

    def beginning(self, words: list[bytes], k: int) -> list[int]:
        return [self.number.get(w[:k] + b"*", -1) if len(w) > k else -1 for w in words]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """A row for each word: the numbers of the word and of its beginnings."""
        whole = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        out, known = np.full((len(words), 1 + len(BEGINNINGS)), -1, np.int64), whole >= 0
        out[known, 0], out[known, 1:] = whole[known], self.beginnings[whole[known]]
        others = [words[i] for i in np.flatnonzero(~known).tolist()]
        for column, k in enumerate(BEGINNINGS, 1):
            out[~known, column] = self.beginning(others, k)
        return out


def term_counts(texts: list[bytes], lookup: Lookup) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Terms in `lookup` of the texts and how often each occurs, text after text, terms ascending; (starts, terms, counts) for each
    CHUNK_BYTES of the texts, with one start more than texts."""
    at = 0
    while at < len(texts):
        parts, size = [], 0
        while at < len(texts) and (not parts or size + len(texts[at]) < CHUNK_BYTES):
            parts.append(texts[at])
            size, at = size + len(texts[at]) + 1, at + 1
        # the letters of all words, where each word begins among them, and how many words end in each text
        letters = np.frombuffer(b" ".join([*parts, b""]).translate(NORMAL), np.uint8)
        inner = letters != 32
        last = np.flatnonzero(inner[:-1] & ~inner[1:])
        words = np.diff(np.searchsorted(last, np.cumsum([0, *[len(t) + 1 for t in parts]])))
        begin = np.concatenate(([0], np.cumsum(inner, dtype=np.int32)[last])).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(last), [None, pa.py_buffer(begin), pa.py_buffer(letters[inner])]).dictionary_encode()
        found = lookup.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        text = np.repeat(np.arange(len(parts)), words)
        key = np.sort((found + text[:, None] * len(lookup))[found >= 0])
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        count, key = np.diff(np.concatenate((first, [len(key)]))), key[first]
        start = np.searchsorted(key, np.arange(len(parts) + 1) * len(lookup))
        yield start, key - np.repeat(np.arange(len(parts)), np.diff(start)) * len(lookup), count


def groups_of(dense: np.ndarray) -> np.ndarray:
    """A group for each column, similar columns together: spherical k-means from evenly spaced columns."""
    n = dense.shape[1]
    if n <= GROUPS:
        return np.zeros(n, np.int64)
    centre = dense[:, np.arange(GROUPS) * n // GROUPS]
    for _ in range(GROUP_ROUNDS):
        group = (centre.T @ dense).argmax(axis=0)
        for g in range(GROUPS):
            centre[:, g] = dense[:, group == g].sum(axis=1)
        centre /= np.maximum(np.sqrt((centre * centre).sum(axis=0)), 1e-30)
    return group


@dataclass
class Index:
    """Postings of the examples by term and block, the terms' largest weights per block, and the labels."""

    terms: list[bytes]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    example: np.ndarray  # postings by term and example: the example
    count: np.ndarray  # and how often it has the term
    df: np.ndarray  # term -> number of postings
    norm: np.ndarray  # example -> length of its vector before it is 1
    block: int
    prior: float
    weight: np.ndarray  # of an example of each class, for the share that the sample took of it
    slope: float = 1.0
    offset: float = 0.0
    empty: float = 0.0

    @classmethod
    def build(cls, terms: list[bytes], idf: np.ndarray, examples: list[tuple[int, int, bytes]], prior: float, weight: dict[int, float], block: int = BLOCK) -> "Index":
        none = np.zeros(0, np.int64)
        self = cls(terms, idf, none, none, none, none, np.zeros(len(terms), np.int64), none, block, prior, np.array([weight[0], weight[1]]))
        vectors = []
        for (doc_id, label, _), (found, count, _, norm) in zip(examples, self.counts([text for _, _, text in examples])):
            if norm:
                vectors.append((doc_id, label, found.astype(np.int32), count.astype(np.int32), norm))
        # a fixed order, which settles ties
        vectors.sort(key=lambda v: (int(v[2][((1 + np.log(v[3])) * idf[v[2]]).argmax()]), v[0]))
        self.ids, self.labels = np.array([v[0] for v in vectors], np.int64), np.array([v[1] for v in vectors], float)
        self.norm = np.array([v[4] for v in vectors], float)
        term = np.concatenate([none, *[v[2] for v in vectors]])
        term = term.astype(np.int32)
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v[2]) for v in vectors])
        order = np.argsort(term, kind="stable")
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
        self.example, self.count = narrow(example[order]), narrow(np.concatenate([none, *[v[3] for v in vectors]])[order])
        self.df = narrow(np.bincount(term, minlength=len(terms)))
        return self

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.terms)

    def prepare(self) -> None:
        """What follows from the fields, made where examples are looked up, which the driver does not do: postings of rare terms,
        matrices and block maxima of the frequent ones; examples stand at places in which similar ones are neighbours."""
        n, of_term = len(self.ids), self.df.astype(np.int64)
        start = np.concatenate(([0], np.cumsum(of_term)))
        often = np.sort(np.argsort(-of_term, kind="stable")[:DENSE_TERMS])
        often = often[of_term[often] * DENSE_SHARE >= n]
        self.row = np.full(len(of_term), -1, np.int32)
        self.row[often] = np.arange(len(often), dtype=np.int32)
        logs = 1 + np.log(np.arange(1, int(self.count.max(initial=1)) + 1).astype(float))

        dense, self.often = np.zeros((len(often), n), np.float32), np.zeros((n, len(often)), self.count.dtype)
        for row, t in enumerate(often.tolist()):
            of = slice(start[t], start[t + 1])
            self.often[self.example[of], row] = self.count[of]
            dense[row, self.example[of]] = logs[self.count[of] - 1] * self.idf[t] / self.norm[self.example[of]]
        self.at = np.argsort(groups_of(dense), kind="stable")
        place = np.empty(n, self.example.dtype)
        place[self.at] = np.arange(n, dtype=place.dtype)
        self.place, self.matrix, self.most = place, [], np.zeros((len(often), -(-n // self.block)), np.float32)
        for first in range(0, n, self.block):
            part = dense[:, self.at[first : first + self.block]]
            rows = np.flatnonzero(part.any(axis=1))
            self.matrix.append((rows, part[rows]))
            self.most[rows, first // self.block] = part[rows].max(axis=1)
        rare = np.repeat(self.row < 0, of_term)
        # a posting in one number: the example's place, and how often it has the term
        self.bits = int(self.count.max(initial=1)).bit_length()
        kind = np.min_scalar_type((n << self.bits) | ((1 << self.bits) - 1))
        self.posting = (place[self.example[rare]].astype(kind) << kind.type(self.bits)) | self.count[rare].astype(kind)
        self.start = np.concatenate(([0], np.cumsum(np.where(self.row < 0, of_term, 0))))
        self.logs, self.length = np.concatenate(([0.0], logs)), np.pad(self.norm[self.at], (0, -n % self.block), constant_values=1.0)

    def __getstate__(self) -> dict:
        """The fields only, in a narrow form: a broadcast lies on every executor's disk."""
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"terms": b" ".join(self.terms)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"terms": state["terms"].split()})

    def counts(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
        """(terms, counts, weights) of each text, and the length of its vector before it is 1: (1 + log count) * idf."""
        for start, terms, count in term_counts(texts, self.lookup):
            w = (1 + np.log(count.astype(float))) * self.idf[terms]
            for i, j in zip(start[:-1].tolist(), start[1:].tolist()):
                yield terms[i:j], count[i:j], w[i:j], math.sqrt(w[i:j] @ w[i:j])

    def vectors(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each text, of length 1."""
        for terms, _, w, norm in self.counts(texts):
            yield (terms, w / norm) if norm else (terms[:0], np.zeros(0))

    def vector_of(self, terms: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(count.astype(float))) * self.idf[terms]
        norm = math.sqrt(w @ w)
        return (terms, w / norm) if norm else (terms[:0], np.zeros(0))

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        return next(self.vectors([text]))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest examples with a term in common; ties go to the smaller example number."""
        return self.nearest_of_all([(terms, weights)], k, [skip])[0]

    def nearest_of_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """`nearest` for each of the vectors, without the example that `skip` names for it."""
        if not len(self.example):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        if "matrix" not in self.__dict__:
            self.prepare()
        out = []
        for i in range(0, len(vectors), QUERIES):
            out += self._nearest(vectors[i : i + QUERIES], k, skip[i : i + QUERIES] if skip else [None] * QUERIES)
        return out

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        often = np.zeros((len(vectors), len(self.most)), np.float32)
        rarely = np.empty((len(vectors), len(self.length)))
        for q, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            dense = row >= 0
            often[q, row[dense]] = weights[dense]
            rare = terms[~dense]
            first = self.start[rare]
            n = self.start[rare + 1] - first
            at = np.repeat(first - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            posting = self.posting.take(at)
            weight = np.repeat(weights[~dense] * self.idf[rare], n)
            weight *= self.logs.take(posting & posting.dtype.type((1 << self.bits) - 1))
            rarely[q] = np.bincount((posting >> posting.dtype.type(self.bits)).astype(np.int64), weight, minlength=len(self.length))
        rarely /= self.length
        flat = rarely.astype(np.float32)
        score = flat.reshape(len(vectors), len(self.matrix), self.block)
        bounds = score.max(axis=2) + often @ self.most
        order = np.argsort(-bounds, axis=1, kind="stable")
        least, scored, done, step = np.zeros(len(vectors), np.float32), np.zeros(bounds.shape, bool), 0, FIRST_BLOCKS
        while done < len(self.matrix):
            take = np.zeros(bounds.shape, bool)
            np.put_along_axis(take, order[:, done : done + step], True, axis=1)
            take &= (bounds > 0) & (bounds >= least[:, None] * (1 - SLACK) - 1e-11)
            if not take.any():
                break
            for block in np.flatnonzero(take.any(axis=0)).tolist():
                asks = np.flatnonzero(take[:, block])
                rows, part = self.matrix[block]
                score[asks, block, : part.shape[1]] += often[asks[:, None], rows] @ part
            scored |= take
            for q in np.flatnonzero(take.any(axis=1)).tolist():
                if skip[q] is not None:
                    flat[q, self.place[skip[q]]] = 0
                seen = score[q, scored[q]].ravel()
                if len(seen) >= k:
                    least[q] = np.partition(seen, -k)[-k]
            done, step = done + step, 4 * step
        out = []
        for q in range(len(vectors)):
            found = np.flatnonzero((flat[q] > 0) & (flat[q] >= least[q] * (1 - SLACK) - 1e-11))  # ties at the end stay in
            found = found[scored[q, found // self.block]]
            # what may be among the k best, in double precision
            terms, weights = vectors[q]
            row, number = self.row[terms], self.at[found]
            dense = row >= 0
            cosines = rarely[q, found] + self.logs[self.often[number[:, None], row[dense]]] @ (weights * self.idf[terms])[dense] / self.length[found]
            best = np.lexsort((number, -np.round(cosines, 12)))[:k]
            out.append((number[best], cosines[best]))
        return out

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Log-odds of the similarity-weighted vote, drawn to the prior where little is similar."""
        w = cosines**2 * self.weight[self.labels[found].astype(int)]
        share = (w @ self.labels[found] + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT)
        return math.log(share / (1 - share))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling of the votes x of examples with labels y; classes weigh as they do among all labelled rows."""
        if not len(x) or min(y) == max(y):
            return
        w = self.weight[y.astype(int)]
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([(w * (p - y) * x).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
            h = w * p * (1 - p)
            hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(hess, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.slope, self.offset = max(float(a), 0.1), float(b)

    def judge(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, neighbours, cosines) of a text."""
        return next(self.judge_all([self.vector(text)]))

    def judge_all(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """`judge` for each of the texts with these vectors."""
        for found, cosines in self.nearest_of_all(vectors):
            p = 1 / (1 + math.exp(-(self.slope * self.vote(found, cosines) + self.offset))) if len(found) else self.empty
            yield p, found, cosines


def left_out_votes(sample: DataFrame, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(votes, labels) of the examples in `sample`, each without itself, in order of their ids; looked up by the tasks."""
    held = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        x = held.value
        where = {d: i for i, d in enumerate(x.ids.tolist())}
        for b in batches:
            known = [(d, where[d], t) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if d in where]
            found = x.nearest_of_all(list(x.vectors([t for _, _, t in known])), skip=[i for _, i, _ in known])
            out = [(d, x.vote(*near), float(x.labels[i])) for (d, i, _), near in zip(known, found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.float64()))], names=["doc_id", "vote", "label"])

    rows = sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, vote double, label double").toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("vote", "ascending")])
    return rows["vote"].to_numpy(), rows["label"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS) -> Index:
    """The index of `fit_with_vectors`."""
    return fit_with_vectors(docs, labels, per_class)[0]


def fit_with_vectors(docs: DataFrame, labels: DataFrame, per_class: int = EXAMPLES_PER_CLASS) -> tuple[Index, DataFrame]:
    """An index over a bounded sample of the labelled rows whose fold (crc32 of the id mod 5) is not 0.

    The sample has at most `per_class` rows of each class, whole texts; document frequencies come from all documents.  The
    driver keeps the postings in narrow types; votes of the examples are found by tasks.  With it: `document_vectors` of all documents.
    """
    bounded_batches(docs.sparkSession)
    sample, totals = training_sample(docs, labels, "toxic", fold(5) != 0, per_class)
    sample = saved(sample.repartition(SAMPLE_TASKS))
    n = Counter({r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()})
    weight = {k: totals.get(k, 0) / n[k] if n[k] else 0.0 for k in (0, 1)}
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    terms, factor = vocabulary(sample, n[1], n[0], weight)
    vectors = document_vectors(docs, terms)
    df, n_docs = document_frequencies(vectors, len(terms))
    rows = sample.toArrow().sort_by("doc_id")
    examples = list(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), rows["text"].to_pylist()))
    index = Index.build(terms, np.log((1 + n_docs) / (1 + df)) * factor, examples, prior, weight)
    index.calibrate(*left_out_votes(sample, index))
    # texts without any term: the share of label 1 among such examples
    held = set(index.ids.tolist())
    bare = Counter(label for d, label, _ in examples if d not in held)
    ones, zeros = bare[1] * weight[1], bare[0] * weight[0]
    index.empty = (ones + prior) / (ones + zeros + 1)
    return index, vectors


def score(docs: DataFrame, index: Index) -> DataFrame:
    """`score_vectors` of any documents."""
    return score_vectors(document_vectors(docs, index.terms), index)


def score_vectors(vectors: DataFrame, index: Index) -> DataFrame:
    """Per document: doc_id, score (probability of label 1), predicted (1 from 0.5 on), evidence (nearest examples: doc_id, label,
    cosine), for rows of `document_vectors`; whole texts, no shuffle.

    Null and empty texts, and texts without a term of any example, have no evidence and the share of label 1 among labelled
    texts of that kind.  Repeated rows and null ids are scored row by row.  Empty table: no rows.  Other columns are ignored.
    """
    held = vectors.sparkSession.sparkContext.broadcast(index)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        x = held.value
        for b in batches:
            scores, lists = [], []
            rows = b.column("vector").to_pylist()
            once = list(dict.fromkeys(rows))  # equal texts of a batch are looked up once
            judged = dict(zip(once, x.judge_all([x.vector_of(*unpacked(v)) for v in once])))
            for p, found, cosines in map(judged.get, rows):
                scores.append(p)
                lists.append([{"doc_id": int(x.ids[i]), "label": int(x.labels[i]), "cosine": float(c)} for i, c in zip(found[:5], cosines)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32()), pa.array(lists, evidence)],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence array<struct<doc_id:bigint,label:int,cosine:double>>")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out (its fold was not learned from), score, predicted, evidence."""
    index, vectors = fit_with_vectors(docs, labels)
    scored = score_vectors(vectors, index)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", "evidence")
