"""Substring deduplication by De Bruijn compaction.

1. Token k-mers that are smallest among their neighbours are anchors; the stretch from one anchor to the next is an edge of a
   De Bruijn graph over anchors.  Two equal windows of WINDOW words choose the same anchors inside and have an edge in common,
   whatever stands around them.
2. Edges that several documents hold are kept.  Paths of kept edges without branches are compacted by joins: the edges of such
   a path are one component.
3. A document's stretches along compacted paths have coordinates in the smallest document that holds their edges.  Where the
   coordinates run along together, all windows inside are removed.  A window whose own edges are not all shared stays.  Only
   windows that this leaves open, and their possible sources, are compared by the hash of their whole word sequence.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bounded_batches, components, saved, text_of
from .tokens import Words, bloom_has, bloom_of, mix, pieces, ranges_hash

#: Words of a window, of a k-mer, and text bytes that one bucket is sized for.
WINDOW, KMER, BUCKET_TEXT = 50, 8, 8 << 20


def sliding(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every `width` neighbours, from running values to the left and right inside blocks."""
    n = len(a)
    blocks = np.pad(a, (0, -n % width), mode="edge").reshape(-1, width)
    ahead = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def anchors(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, k-mer hash) of the anchors: k-mers that are smallest in some run of `reach` k-mers of their text.

    A window has at least 2 * reach k-mers, hence two anchors of its own choice.
    """
    at, h = w.windows(KMER)
    reach = (window - KMER + 1) // 2
    if len(at) < reach:
        return at[:0], h[:0]
    least = sliding(h, reach, np.minimum)
    doc = w.doc[at]
    least[doc[: len(least)] != doc[reach - 1 :]] = 0
    chosen = sliding(np.pad(least, reach - 1), reach, np.maximum) == h
    return at[chosen], h[chosen]


def edges_of(w: Words, window: int) -> dict[str, np.ndarray]:
    """The edges of texts with a window at least: text, first word, words, hashes of the edge and of its end anchors."""
    at, h = anchors(w, window)
    doc = w.doc[at]
    pair = np.flatnonzero((doc[1:] == doc[:-1]) & (w.count[doc[1:]] >= window)) if len(at) > 1 else np.zeros(0, np.int64)
    start, end = at[pair], at[pair + 1] + KMER if len(pair) else at[pair]
    return {"doc": doc[pair], "pos": start - w.first[doc[pair]], "length": end - start, "edge": ranges_hash(w.hash, start, end), "src": h[pair], "dst": h[pair + 1] if len(pair) else h[pair]}


def _packed(bucket: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Columns dealt to buckets: (bucket numbers, one byte string each with the columns one after the other)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    return [int(bucket[p[0]]) for p in parts], [b"".join(c[p].tobytes() for c in columns) for p in parts]


def _unpacked(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts = []
    for x in blobs:
        n, at, columns = len(x) // width, 0, []
        for k in kinds:
            columns.append(np.frombuffer(x, k, n, at))
            at += n * np.dtype(k).itemsize
        parts.append(columns)
    return [np.concatenate(c) for c in zip(*parts)]


def _bucket(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


_FIRST = pa.schema([("doc_id", pa.int64()), ("dig", pa.int32()), ("n_words", pa.int64()), ("sha", pa.string()), ("bucket", pa.int64()), ("blob", pa.binary())])


def _first_pass(texts: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Per text its word count and the hash of all its words; per piece and bucket the edges with their smallest and largest document."""

    def rows(n, **columns):
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _FIRST], schema=_FIRST)

    def run(batches):
        for batch in batches:
            ids, dig, text = batch.column("doc_id"), batch.column("dig"), batch.column("text")
            sha = [hashlib.sha256(b" ".join(x.as_py().split())).hexdigest() for x in text]
            for w in pieces(text, lower=False):
                n, own = len(w.count), slice(w.rows.start, w.rows.stop)
                yield rows(n, doc_id=ids[own], dig=dig[own], n_words=pa.array(w.count.astype(np.int64)), sha=pa.array(sha[own]))
                e = edges_of(w, window)
                known = ids[own].is_valid().to_numpy(zero_copy_only=False)[e["doc"]]
                doc = ids[own].fill_null(0).to_numpy()[e["doc"]][known]
                edge, pos = e["edge"][known], e["pos"][known].astype(np.int32)
                order = np.lexsort((pos, doc, edge))
                edge, doc, pos = edge[order], doc[order], pos[order]
                heads = np.concatenate(([True], edge[1:] != edge[:-1])) if len(edge) else np.zeros(0, bool)
                tails = np.concatenate((heads[1:], [True])) if len(edge) else heads
                twice = tails & ~heads
                twice[twice] = doc[twice] != doc[heads][np.cumsum(heads)[twice] - 1]
                keep = np.flatnonzero(heads | twice)
                keep = keep[np.lexsort((pos[keep], doc[keep]))]  # ids side by side compress well
                numbers, blobs = _packed(_bucket(edge[keep], n_buckets), edge[keep], doc[keep], pos[keep])
                if blobs:
                    yield rows(len(blobs), bucket=pa.array(numbers, pa.int64()), blob=pa.array(blobs, pa.binary()))

    return texts.mapInArrow(run, "doc_id bigint, dig int, n_words bigint, sha string, bucket bigint, blob binary")


def _shared_edges(packed: DataFrame, n_buckets: int) -> DataFrame:
    """The edges that two documents or more hold, and where the smallest of them has them first: (edge, source, source_pos)."""

    def run(batches):
        blobs = [x for b in batches for x in b.column("blob").to_pylist()]
        if blobs:
            edge, doc, pos = _unpacked(blobs, "u8", "i8", "i4")
            order = np.lexsort((pos, doc, edge))
            edge, doc, pos = edge[order], doc[order], pos[order]
            heads = np.flatnonzero(np.concatenate(([True], edge[1:] != edge[:-1])))
            several = doc[heads] != doc[np.concatenate((heads[1:], [len(edge)])) - 1]
            at = heads[several]
            yield pa.RecordBatch.from_arrays([pa.array(edge[at].view(np.int64)), pa.array(doc[at]), pa.array(pos[at])], names=["edge", "source", "source_pos"])

    return packed.repartition(n_buckets, "bucket").select("blob").mapInArrow(run, "edge bigint, source bigint, source_pos int")


def _occurrences(texts: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Where documents hold shared edges: (doc_id, dig, pos, length, edge, src, dst, source, source_pos).

    The end anchors src and dst are given where the edge stands first, in its source.
    """
    held = texts.sparkSession.sparkContext.broadcast(bloom_of(shared.select("edge")))
    names = ["doc_id", "dig", "pos", "length", "edge", "src", "dst"]

    def run(batches):
        for batch in batches:
            ids, dig = batch.column("doc_id"), batch.column("dig")
            for w in pieces(batch.column("text"), lower=False):
                e = edges_of(w, window)
                ok = bloom_has(held.value, e["edge"])
                row = pa.array(e["doc"][ok] + w.rows.start)
                numbers = [pa.array(e[c][ok].astype(np.int32)) for c in ("pos", "length")] + [pa.array(e[c][ok].view(np.int64)) for c in ("edge", "src", "dst")]
                yield pa.RecordBatch.from_arrays([ids.take(row), dig.take(row), *numbers], names=names)

    kinds = dict.fromkeys(names, "bigint") | {"dig": "int", "pos": "int", "length": "int"}
    found = texts.filter("doc_id is not null").mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    joined = found.join(shared, "edge")
    first = (F.col("doc_id") == F.col("source")) & (F.col("pos") == F.col("source_pos"))  # the graph needs an edge's ends once
    return joined.withColumns({c: F.when(first, F.col(c)) for c in ("src", "dst")})


def compacted(edges: DataFrame) -> DataFrame:
    """(edge, path): edges (edge, src, dst) of the graph joined into paths without branches; an edge by itself is a path."""
    into = edges.groupBy("dst").agg(F.count("*").alias("n"), F.min("edge").alias("a")).filter("n = 1")
    out = edges.groupBy("src").agg(F.count("*").alias("n"), F.min("edge").alias("b")).filter("n = 1")
    steps = into.select("dst", "a").join(out.select("src", "b"), F.col("dst") == F.col("src")).select("a", "b")
    paths = components(steps).select(F.col("node").alias("edge"), F.col("component").alias("path"))
    return edges.select("edge").join(paths, "edge", "left").select("edge", F.coalesce("path", "edge").alias("path"))


def stretches(occurrences: DataFrame) -> DataFrame:
    """Source coordinates: (doc_id, dig, start, end, own) of unbroken runs of shared edges along one path that run along
    together in one source; `own`: the document is the source itself."""
    edges = occurrences.filter("src is not null").select("edge", "src", "dst").distinct()
    placed = occurrences.select("doc_id", "dig", "pos", "length", "edge", "source", "source_pos").join(saved(compacted(saved(edges))), "edge").drop("edge")
    in_order = W.partitionBy("doc_id", "dig").orderBy("pos")
    before = lambda c: F.lag(c).over(in_order)
    follows = (
        (before(F.col("pos") + F.col("length") - KMER) == F.col("pos")) & (before("path") == F.col("path")) & (before("source") == F.col("source"))
        & (F.col("source_pos") - before("source_pos") == F.col("pos") - before("pos"))
    )
    runs = placed.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(in_order))
    ends = F.max(F.col("pos") + F.col("length"))
    return runs.groupBy("doc_id", "dig", "run").agg(F.min("pos").alias("start"), ends.alias("end"), F.min(F.col("source") == F.col("doc_id")).alias("own"))


def _texts_with(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` (doc_id, dig, ...) with their texts; only texts whose id passes a filter of fixed size are shuffled."""
    held = texts.sparkSession.sparkContext.broadcast(bloom_of(rows.select("doc_id")))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(bloom_has(held.value, b.column("doc_id").to_numpy().view(np.uint64))))

    passed = texts.filter("doc_id is not null").mapInArrow(run, "doc_id bigint, dig int, text binary")
    return passed.dropDuplicates(["doc_id", "dig"]).join(rows, ["doc_id", "dig"])


_SECOND = pa.schema([("doc_id", pa.int64()), ("dig", pa.int32()), ("at", pa.binary()), ("bucket", pa.int64()), ("blob", pa.binary())])


def _covers(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of 0..size-1 lie in one of the intervals lo..hi (both included)."""
    lo, hi = np.maximum(lo, 0), np.minimum(hi, size - 1)
    some = lo <= hi
    return np.cumsum(np.bincount(lo[some], minlength=size + 1) - np.bincount(hi[some] + 1, minlength=size + 1))[:size] > 0


def _choices(w: Words, window: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The edges of a piece, and for each the first and last window (by its first word) that chooses both its anchors by itself."""
    at, h = w.windows(KMER)
    e, reach, spare = edges_of(w, window), (window - KMER + 1) // 2, window - KMER + 1 - (window - KMER + 1) // 2
    if not len(e["doc"]):
        return e, np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding(h, reach, np.minimum)
    least[w.doc[at[: len(least)]] != w.doc[at[reach - 1 :]]] = 0
    low, high = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    for d in range(reach):  # runs in which the k-mer d places on is smallest
        j = np.flatnonzero(h[d : d + len(least)] == least)
        low[j + d] = j
    for d in reversed(range(reach)):
        j = np.flatnonzero(h[d : d + len(least)] == least)
        high[j + d] = j
    place = np.full(len(w.hash), -1, np.int64)
    place[at] = np.arange(len(at))
    first = w.first[e["doc"]] + e["pos"]
    second = first + e["length"] - KMER
    return e, at[low[place[second]]] - spare, at[high[place[first]]]


def _window_pass(found: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Verdicts on windows of (doc_id, dig, text, spans).

    Decided (`at`: pairs of first and last window start): windows inside a stretch of another source, and those that a smaller
    document of the same piece holds.  A window with an edge of its own choice that is not shared stays.  Of the other open
    windows the piece's smallest document goes to the window's bucket.
    """

    def run(batches):
        for batch in batches:
            ids, digs, spans = batch.column("doc_id").to_numpy(), batch.column("dig").to_numpy(), batch.column("spans")
            for w in pieces(batch.column("text"), lower=False):
                e, low, high = _choices(w, window)
                edge_first = np.searchsorted(e["doc"], np.arange(len(w.count) + 1))
                starts, docs, sure = [], [], {}
                for i, row in enumerate(range(w.rows.start, w.rows.stop)):
                    size, inner, mine = int(w.count[i]) - window + 1, spans[row].values, slice(edge_first[i], edge_first[i + 1])
                    start, end, own = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "own"))
                    other = ~own.astype(bool) & (end - start >= window)
                    if other.any():
                        sure[row] = np.stack([start[other], end[other] - window], axis=1)
                    removed = _covers(size, start[other], end[other] - window)
                    order = np.argsort(start)
                    pos, upto = e["pos"][mine], e["pos"][mine] + e["length"][mine]
                    k = np.searchsorted(start[order], pos, "right") - 1
                    lone = (k < 0) | (end[order][np.maximum(k, 0)] < upto)
                    stays = _covers(size, low[mine][lone] - w.first[i], high[mine][lone] - w.first[i])
                    open_ = np.flatnonzero(~removed & ~stays)
                    starts.append(open_ + w.first[i])
                    docs.append(np.full(len(open_), i))
                start, doc = np.concatenate(starts), np.concatenate(docs)
                h, check = ranges_hash(w.hash, start, start + window), ranges_hash(w.hash ^ np.uint64(0x5DEECE66D), start, start + window)
                row = doc + w.rows.start
                order = np.lexsort((ids[row], check, h))
                h, check, row, place = h[order], check[order], row[order], (start - w.first[doc])[order].astype(np.int32)
                if len(h):
                    new = np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
                    gone = ids[row] != ids[row[np.flatnonzero(new)]][np.cumsum(new) - 1]
                    for r in np.unique(row[gone]):
                        at = place[gone & (row == r)]
                        sure[r] = np.concatenate([sure[r], np.stack([at, at], axis=1)]) if r in sure else np.stack([at, at], axis=1)
                    k = np.flatnonzero(~gone)
                    k = k[np.lexsort((place[k], row[k]))]  # ids side by side compress well
                    # neighbouring windows have the same smallest k-mer, and go to one bucket
                    kmers, hashes = w.windows(KMER)
                    smallest = np.zeros(len(w.hash), np.uint64)
                    least = sliding(hashes, window - KMER + 1, np.minimum)
                    smallest[kmers[: len(least)]] = least
                    at = smallest[w.first[row[k] - w.rows.start] + place[k]]
                    numbers, blobs = _packed(_bucket(mix(at), n_buckets), h[k], check[k].astype(np.uint32), ids[row[k]], digs[row[k]], place[k])
                    n = len(blobs)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], schema=_SECOND)
                if sure:
                    r = list(sure)
                    ats = pa.array([x.astype(np.int32).tobytes() for x in sure.values()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(digs[r]), ats, pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.binary())], schema=_SECOND)

    return found.select("doc_id", "dig", "text", "spans").mapInArrow(run, "doc_id bigint, dig int, at binary, bucket bigint, blob binary")


def _verdicts(packed: DataFrame, n_buckets: int) -> DataFrame:
    """(doc_id, dig, at): pairs of first and last start of windows that a smaller document holds as well."""

    def run(batches):
        blobs = [x for b in batches for x in b.column("blob").to_pylist()]
        if not blobs:
            return
        h, check, doc, dig, at = _unpacked(blobs, "u8", "u4", "i8", "i4", "i4")
        order = np.lexsort((doc, check, h))
        h, check, doc, dig, at = h[order], check[order], doc[order], dig[order], at[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
        gone = doc != doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        doc, dig, at = doc[gone], dig[gone], at[gone]
        if not len(doc):
            return
        order = np.lexsort((at, dig, doc))
        doc, dig, at = doc[order], dig[order], at[order]
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(dig) != 0)) + 1
        first = np.concatenate(([0], cuts))
        pairs = [np.stack([p, p], axis=1).tobytes() for p in np.split(at, cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(dig[first]), pa.array(pairs, pa.binary())], names=["doc_id", "dig", "at"])

    return packed.repartition(n_buckets, "bucket").select("blob").mapInArrow(run, "doc_id bigint, dig int, at binary")


def _kept(found: DataFrame, window: int) -> DataFrame:
    """(doc_id, dig, n_removed, sha, text) of the documents that lose words: `at` has pairs of first and last start of windows removed."""

    def run(batches):
        for b in batches:
            removed, sha, texts = [], [], []
            for text, lists in zip(b.column("text"), b.column("at")):
                words = text.as_py().split()
                pairs = np.concatenate([np.frombuffer(x.as_py(), np.int32).reshape(-1, 2) for x in lists.values])
                keep = ~_covers(len(words), pairs[:, 0], pairs[:, 1] + window - 1)
                kept = b" ".join([x for x, k in zip(words, keep.tolist()) if k])
                removed.append(int((~keep).sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("dig"), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.binary())], names=["doc_id", "dig", "n_removed", "sha", "text"])

    return found.mapInArrow(run, "doc_id bigint, dig int, n_removed bigint, sha string, text binary")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(per row of `docs`: doc_id, n_words, n_removed, kept_sha256; and the changed texts: doc_id, dig, text).

    A window is `window` (at least 2 * KMER) consecutive words of one document.  Every word is removed that lies in a window
    whose word sequence also starts in a document with a smaller doc_id.  Windows are judged on the input.  Words stand between
    ASCII white space and count as they are; kept words are joined by one space.  dig is Spark's 32-bit hash of the input text.

    Null or empty text: no words.  Null doc_id: loses nothing and takes nothing from others.  Rows with one doc_id are one
    document and take nothing from each other.  Empty table: no rows.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    n_buckets = max(8, -(-size // BUCKET_TEXT))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash(text_of()).alias("dig"), text_of().cast("binary").alias("text"))
    passed = saved(_first_pass(texts, window, n_buckets))
    shared = saved(_shared_edges(passed.filter("blob is not null").select("bucket", "blob"), n_buckets))
    occurrences = saved(_occurrences(texts, shared, window))
    spans = stretches(occurrences).groupBy("doc_id", "dig").agg(F.collect_list(F.struct("start", "end", "own")).alias("spans"))
    found = saved(_texts_with(texts, saved(spans)))
    windows = saved(_window_pass(found, window, n_buckets))
    decided = windows.filter("at is not null").select("doc_id", "dig", "at")
    verdicts = decided.unionByName(_verdicts(windows.filter("blob is not null").select("bucket", "blob"), n_buckets))
    lost = verdicts.groupBy("doc_id", "dig").agg(F.collect_list("at").alias("at"))
    changed = saved(_kept(found.select("doc_id", "dig", "text").join(lost, ["doc_id", "dig"]), window))
    plain = passed.filter("blob is null").select("doc_id", "dig", "n_words", "sha")
    out = plain.join(changed.select("doc_id", "dig", "n_removed", F.col("sha").alias("less")), ["doc_id", "dig"], "left")
    return (
        out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("less", "sha").alias("kept_sha256")),
        changed.select("doc_id", "dig", F.col("text").cast("string").alias("text")),
    )
