"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters look at WIDTH bytes at every STRIDE bytes; a chunk is a stretch of frames that overlaps the
next one; every filter keeps its largest response per chunk.  A hidden layer turns a chunk's responses into log-odds, and the
mean over all chunks of the whole document gives one probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, training_sample
from .shared import bounded_batches, text_of

#: Bytes per frame step (a filter sees two steps), embedding size, filters, hidden units, frames per block, blocks per chunk and per chunk step.
STRIDE, EMBED, FILTERS, HIDDEN, BLOCK, CHUNK_BLOCKS, STEP_BLOCKS = 4, 8, 24, 16, 32, 4, 3
BLOCK_BYTES = STRIDE * BLOCK
PIECE_BYTES = 1 << 19


@dataclass
class Batch:
    """Documents as padded bytes: `data` in blocks, where each document's blocks begin, the chunks, and the lengths."""

    data: np.ndarray
    first: np.ndarray  # blocks, one more than documents
    chunk_first: np.ndarray  # first block of each chunk
    chunk_last: np.ndarray  # block after it
    chunk_doc: np.ndarray
    fill: np.ndarray  # share of a full chunk that is text
    length: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> "Batch":
        length = np.array([len(t) for t in texts])
        blocks = np.maximum(1, -(-length // BLOCK_BYTES))
        first = np.concatenate(([0], np.cumsum(blocks)))
        data = np.zeros(first[-1] * BLOCK_BYTES, np.uint8)
        for t, at in zip(texts, first[:-1] * BLOCK_BYTES):
            data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        chunks = np.maximum(1, -(-(blocks - (CHUNK_BLOCKS - STEP_BLOCKS)) // STEP_BLOCKS))
        doc = np.repeat(np.arange(len(texts)), chunks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = first[doc] + nth * STEP_BLOCKS
        rest = length[doc] - nth * STEP_BLOCKS * BLOCK_BYTES
        fill = np.clip(rest / (CHUNK_BLOCKS * BLOCK_BYTES), 0, 1).astype(np.float32)
        return cls(data, first, start, np.minimum(start + CHUNK_BLOCKS, first[doc + 1]), doc, fill, length)


@dataclass
class Net:
    embed: np.ndarray
    near: np.ndarray  # filter weights of the first STRIDE bytes
    far: np.ndarray  # and of the next
    bias: np.ndarray
    hidden: np.ndarray  # of a chunk's pooled responses and its share of a full chunk
    hidden_bias: np.ndarray
    out: np.ndarray
    rest: np.ndarray  # intercept
    shift: float = 0.0
    names: tuple = field(default=("embed", "near", "far", "bias", "hidden", "hidden_bias", "out", "rest"), repr=False)

    @classmethod
    def fresh(cls, seed: int) -> "Net":
        r = np.random.default_rng(seed)
        f = lambda *s, scale: r.normal(0, scale, s).astype(np.float32)
        k, zeros = STRIDE * EMBED, lambda n: np.zeros(n, np.float32)
        return cls(
            f(256, EMBED, scale=1.0), f(k, FILTERS, scale=(2 * k) ** -0.5), f(k, FILTERS, scale=(2 * k) ** -0.5), zeros(FILTERS),
            f(FILTERS + 1, HIDDEN, scale=FILTERS**-0.5 / 2), zeros(HIDDEN), f(HIDDEN, scale=HIDDEN**-0.5), zeros(1),
        )

    def responses(self, b: Batch) -> tuple[np.ndarray, np.ndarray]:
        """(embedded steps, filter responses of every frame)."""
        steps = np.take(self.embed, b.data, axis=0).reshape(-1, STRIDE * EMBED)
        out = steps @ self.near
        ahead = steps @ self.far
        ahead[b.first[:-1] * BLOCK] = 0  # no frame reaches into the next document
        out[:-1] += ahead[1:]
        return steps, out

    def logits(self, b: Batch) -> tuple[np.ndarray, tuple]:
        steps, response = self.responses(b)
        block = response.reshape(-1, BLOCK, FILTERS).max(axis=1)
        blocks = np.minimum(b.chunk_first[:, None] + np.arange(CHUNK_BLOCKS), b.chunk_last[:, None] - 1)
        pooled = block[blocks].max(axis=1)
        active = np.concatenate([np.maximum(pooled + self.bias, 0), b.fill[:, None]], axis=1)
        inner = np.tanh(active @ self.hidden + self.hidden_bias)
        heads = np.searchsorted(b.chunk_doc, np.arange(len(b.length)))
        count = np.diff(np.concatenate((heads, [len(b.chunk_doc)])))
        logit = np.add.reduceat(inner @ self.out, heads) / count + self.rest[0]
        return logit, (steps, response, block, blocks, active, inner, count)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text, worked on in pieces of bounded size."""
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) + BLOCK_BYTES <= PIECE_BYTES):
                size += len(texts[upto]) + BLOCK_BYTES
                upto += 1
            out[at:upto] = 1 / (1 + np.exp(-(self.logits(Batch.of(texts[at:upto]))[0].astype(float) + self.shift)))
            at = upto
        return out

    def gradients(self, b: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
        logit, (steps, response, block, blocks, active, inner, count) = self.logits(b)
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)
        d_chunk = (d / count)[b.chunk_doc].astype(np.float32)
        g = {"rest": np.array([d.sum()], np.float32), "out": inner.T @ d_chunk}
        d_inner = d_chunk[:, None] * self.out * (1 - inner**2)
        g["hidden"], g["hidden_bias"] = active.T @ d_inner, d_inner.sum(axis=0)
        d_active = (d_inner @ self.hidden.T)[:, :FILTERS] * (active[:, :FILTERS] > 0)
        g["bias"] = d_active.sum(axis=0)
        # back through max-pooling: the frame of a chunk with the largest response
        best = np.take_along_axis(blocks, block[blocks].argmax(axis=1), axis=1)
        peak = response.reshape(-1, BLOCK, FILTERS).argmax(axis=1)
        chunk, filt = np.nonzero(d_active)
        d_hit = d_active[chunk, filt]
        at = best[chunk, filt]
        frames = at * BLOCK + peak[at, filt]
        last = np.isin(frames + 1, b.first[1:] * BLOCK)
        after = np.minimum(frames + 1, len(steps) - 1)
        x_near, x_far = steps[frames], steps[after] * ~last[:, None]
        g["near"], g["far"] = np.zeros_like(self.near), np.zeros_like(self.far)
        for f in range(FILTERS):
            of = filt == f
            g["near"][:, f] = x_near[of].T @ d_hit[of]
            g["far"][:, f] = x_far[of].T @ d_hit[of]
        g["embed"] = np.zeros_like(self.embed)
        for x, w, on in ((frames, self.near, np.ones(len(frames))), (after, self.far, ~last)):
            d_steps = (w.T[filt] * (d_hit * on)[:, None]).reshape(-1, EMBED)
            places = b.data[(x[:, None] * STRIDE + np.arange(STRIDE)).ravel()]
            for k in range(EMBED):
                g["embed"][:, k] += np.bincount(places, d_steps[:, k], 256)
        return g


def train(texts: list[bytes], y: np.ndarray, totals: dict[int, int], epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Net:
    """Adam over class-balanced batches; the intercept is then moved to the classes' shares among all labelled rows."""
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.shift = float(np.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1)))
        return net
    classes = [np.flatnonzero(y == k) for k in (0, 1)]
    m = {k: np.zeros_like(getattr(net, k)) for k in net.names}
    v = {k: np.zeros_like(getattr(net, k)) for k in net.names}
    steps = max(60, epochs * max(map(len, classes)) // (batch // 2))
    for t in range(1, steps + 1):
        rows = np.concatenate([r.choice(c, batch // 2) for c in classes])
        g = net.gradients(Batch.of([texts[i] for i in rows]), y[rows].astype(np.float32))
        lr = rate * (1 - 0.9 * t / steps)
        for k in net.names:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            setattr(net, k, (getattr(net, k) - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32))
    net.shift = float(np.log(totals[1] / totals[0]))
    return net


def fit(docs: DataFrame, labels: DataFrame, **options) -> Net:
    """A network for labels.quality from rows whose fold (crc32 of the id mod 3) is not 1; see labelled.py for the sample's bounds."""
    sample, totals = training_sample(docs, labels, "quality", fold(3) != 1, **options)
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    return train([bytes(r["text"]) for r in rows], np.array([r["label"] for r in rows]), totals)


def score(docs: DataFrame, net: Net, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `carry` columns with `score` (probability of label 1) and `predicted` (1 from 0.5 on); whole texts, no shuffle.

    Null and empty texts get the network's score for no bytes.  Repeated rows and null ids are scored row by row.  Empty table:
    no rows.  Carried columns called like a result column are replaced.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)
    kept = [c for c in carry if c not in ("score", "predicted")]
    carried = "text" in kept
    rows = docs.select(*[docs[f"`{c}`"] for c in kept], *([] if carried else [text_of().cast("binary").alias("_text")]))

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).fill_null(b"") if carried else b.column("_text")
            p = held.value.scores(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    return rows.mapInArrow(run, ", ".join([*schema, "score double, predicted int"]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out (its fold was not learned from), score, predicted."""
    return score(docs, fit(docs, labels)).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` less those that the network predicts to be of label 0; same columns, whatever their names."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*rest).alias("_row"), "text")
    kept = score(rows, fit(docs, labels), carry=("_row", "text")).filter("predicted = 1")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
