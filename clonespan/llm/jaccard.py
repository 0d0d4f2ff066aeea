"""N-gram Jaccard join: size-banded tiles with bitmap signatures, bit-count bounds, then exact sorted-array intersection.

1. A document's set is that of its word shingles' 64-bit hashes.  Equal sets are one class from here on.
2. Two sets with Jaccard similarity of t or more differ in at most d elements, d known for a band of sizes.  The hash space is
   cut into more than d slices for the band; a similar pair agrees on all elements of at least one slice.  Sets that have too
   few slices with content to agree on one of these are cut finer.  (band, level, slice, content) is a tile; documents that meet
   in a tile are candidates.  No similar pair is missed.
   A pair that meets is a candidate if sizes and bitmaps allow it; strangers that only share a passage are parted there.
3. Components of candidates are cut into blocks of bounded size.  First only bitmaps are dealt to the blocks: sets that no other
   set of the component can reach, by the bit counts and sizes, are done.  Of the others the elements follow.  Within a block, pairs of fitting size whose bitmaps' differing
   bits leave enough overlap are intersected exactly.  Between blocks the same bit counts tell which sets have a partner there;
   their elements meet and are intersected.  Every similar pair of classes is found once.  Pairs are counted where they are
   found; what moves on is a number per set and block, and the links that connect the sets as all pairs do.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, components, own_tables, saved, text_of
from .tokens import Words, bloom_has, bloom_of, mix, pieces, ranges_hash

#: Growth of the size bands; levels of slices; text bytes that one bucket of tiles is sized for; sets and elements of a block; least words of a bitmap; most tasks of a shuffle;
#: most nodes of a tile whose pairs are listed.
BAND_GROWTH, LEVELS, BUCKET_TEXT, BLOCK_SETS, BLOCK_ELEMENTS, BITMAP_WORDS, MOST_TASKS, CROWD = 1.4, 4, 20 << 20, 2_000, 2_000_000, 16, 20_000, 16
LOW48 = np.uint64((1 << 48) - 1)


class Threshold:
    """Jaccard similarity of at least num / den, in integers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(self.lows[-1] * max(BAND_GROWTH, den / num))))
        self.differ = [self.most_different(hi - 1, (hi - 1) * den // num) for hi in self.lows[1:]]

    def overlap(self, total):
        """The least intersection of a similar pair whose sizes sum to `total`."""
        return -(-self.num * total // (self.num + self.den))

    def most_different(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.num + self.den)

    def slices(self, band: int, level: int = 0) -> int:
        """Slices of a band: one more than can differ, and some for slices that are empty; every level has half as many again."""
        d = self.differ[band]
        return (d + 3 + d // 8) * 3**level // 2**level


def shingle_sets(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts of a piece, where each text's begin)."""
    at, h = w.windows(width)
    doc = w.doc[at]
    few = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(few):
        h = np.concatenate([h, ranges_hash(w.hash, w.first[few], w.first[few + 1])])
        doc = np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(w.count) + 1))
    h = h.copy()
    for s, e in zip(first[:-1].tolist(), first[1:].tolist()):
        h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=len(w.count))))).astype(np.int64)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[first[1:]] - total[first[:-1]]


def digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every set."""
    n = np.diff(first).astype(np.uint64)
    return mix(sums(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), first) + n), mix(sums(mix(h + np.uint64(0x1234567890ABCDEF)), first) ^ n)


def tiles(h: np.ndarray, first: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(tile hash, set index) of all sets: those of a set's own band, and those of the band below if it reaches into it.

    A set with no more slices that hold something than elements may differ is also cut finer, at last into its elements.  Two
    similar sets that agree on empty slices only are both such sets, so they meet further down, where every slice has content.
    """
    n = np.diff(first)
    lows = np.array(t.lows)
    band = np.searchsorted(lows, n, "right") - 1
    differ = np.array(t.differ)
    out_tile, out_set = [], []
    for below in (0, 1):
        b = band - below
        use = (n > 0) & (b >= 0)
        if below:
            use &= n * t.num <= (lows[np.maximum(band, 0)] - 1) * t.den
        use &= differ[np.maximum(b, 0)] > 0
        sets = np.flatnonzero(use)
        for level in range(LEVELS):
            if not len(sets):
                break
            owner = np.repeat(np.arange(len(sets)), n[sets])
            elements = h[np.repeat(first[sets] - (np.cumsum(n[sets]) - n[sets]), n[sets]) + np.arange(len(owner))]
            if level < LEVELS - 1:
                m = np.array([t.slices(k, level) for k in range(int(b[sets].max()) + 1)], np.uint64)[b[sets]]
                piece = ((elements >> np.uint64(32)) * m[owner]) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate(([True], (piece[1:] != piece[:-1]) | (owner[1:] != owner[:-1]))))
            else:
                piece, starts = np.zeros(len(elements), np.uint64), np.arange(len(elements))
            who = owner[starts]
            where = piece[starts] * np.uint64(1 << 16) + b[sets][who].astype(np.uint64) + np.uint64(level << 12)
            out_tile.append(mix(sums(mix(elements), np.concatenate((starts, [len(elements)]))) + mix(where)))
            out_set.append(sets[who])
            sets = sets[np.bincount(who, minlength=len(sets)) <= differ[b[sets]]]
    if not out_tile:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_tile), np.concatenate(out_set)


def met(tile: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, node) in order and without repetition, and how many nodes each row's tile has."""
    order = np.lexsort((node, tile))
    t, v = tile[order], node[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    t, v = t[new], v[new]
    heads = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((heads, [len(t)])))
    return t, v, np.repeat(sizes, sizes)


def packed_tiles(tile: np.ndarray, node: np.ndarray) -> bytes:
    """6 bytes of each tile and 6 of each node (chance hits are harmless here)."""
    return np.concatenate([tile, node]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


_SIGNED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("blob", pa.binary())])
_SIGNED_SQL = "kind int, doc_id bigint, n bigint, h1 bigint, h2 bigint, blob binary"


def _rows(kind: int, n_rows: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(np.full(n_rows, kind, np.int32))]
    arrays += [columns[f.name] if f.name in columns else pa.nulls(n_rows, f.type) for f in list(_SIGNED)[1:]]
    return pa.RecordBatch.from_arrays(arrays, schema=_SIGNED)


def signed(docs: DataFrame, width: int, t: Threshold, n_buckets: int) -> DataFrame:
    """One pass over the texts.  kind 0: a document's set (n, digests, bitmap); kind 1: packed tiles for bucket n; kind 3: packed
    tiles that are crowded within a piece of text, less the nodes that let their bucket know."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for w in pieces(batch.column("_text"), lower=True):
                h, first = shingle_sets(w, width)
                h1, h2 = digests(h, first)
                n = np.diff(first)
                maps = pa.array([bitmap(h[s:e]).tobytes() for s, e in zip(first[:-1], first[1:])], pa.binary())
                yield _rows(0, len(n), doc_id=ids.slice(w.rows.start, len(n)), n=pa.array(n), h1=pa.array(h1.view(np.int64)), h2=pa.array(h2.view(np.int64)), blob=maps)
                tile, owner = tiles(h, first, t)
                tile, node, size = met(tile, h1[owner] & LOW48)
                place = np.arange(len(tile)) - np.searchsorted(tile, tile)
                over = (size > CROWD) & (place > CROWD)
                if over.any():
                    yield _rows(3, 1, blob=pa.array([packed_tiles(tile[over], node[over])], pa.binary()))
                tile, node = tile[~over], node[~over]
                bucket = ((tile >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
                parts = np.split(np.arange(len(bucket)), np.flatnonzero(np.diff(bucket)) + 1) if len(bucket) else []
                if parts:
                    blobs = [packed_tiles(tile[part], node[part]) for part in parts]
                    yield _rows(1, len(blobs), n=pa.array([int(bucket[part[0]]) for part in parts], pa.int64()), blob=pa.array(blobs, pa.binary()))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("_text")).mapInArrow(run, _SIGNED_SQL)


def _unpacked(blob: bytes) -> np.ndarray:
    six = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return wide.view("<u8").reshape(2, -1)


def meetings(packed: DataFrame, n_buckets: int) -> DataFrame:
    """Rows (crowded, a, b) of the tiles of each bucket: the pairs (a, b) of nodes that meet in a tile, and of crowded tiles the
    members (tile, node).  A task holds the tiles of one bucket at a time as two arrays."""

    def rows(crowded, a, b):
        kind = pa.array(np.full(len(a), crowded, bool))
        return pa.RecordBatch.from_arrays([kind, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["crowded", "a", "b"])

    def solve(blobs):
        tile, node, size = met(*np.concatenate([_unpacked(x) for x in blobs], axis=1))
        yield rows(True, tile[size > CROWD], node[size > CROWD])
        few = (size > 1) & (size <= CROWD)
        tile, node = tile[few], node[few]
        pairs = [np.zeros((0, 2), np.uint64)]
        for k in range(1, CROWD):
            same = np.flatnonzero(tile[k:] == tile[:-k])
            pairs.append(np.stack([node[same], node[same + k]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        yield rows(False, pairs[:, 0].copy(), pairs[:, 1].copy())

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != now and blobs:
                    yield from solve(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from solve(blobs)

    dealt = packed.select(F.col("n").alias("bucket"), "blob").repartition(min(n_buckets, MOST_TASKS), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "crowded boolean, a bigint, b bigint")


def _held_apart(packed: DataFrame) -> DataFrame:
    """(crowded, a, b) of the packed tiles of kind 3."""

    def run(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                tile, node = _unpacked(blob)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(tile), bool)), pa.array(tile.view(np.int64)), pa.array(node.view(np.int64))], names=["crowded", "a", "b"])

    return packed.select("blob").mapInArrow(run, "crowded boolean, a bigint, b bigint")


def candidate_edges(met: DataFrame, classes: DataFrame, n_tasks: int, t: Threshold) -> DataFrame:
    """Edges (a, b) that connect the nodes as all pairs do that meet in a tile and whose sizes and bitmaps allow a link.

    classes: (node, n, bits).  Pairs of tiles of few nodes are looked at once each, whatever tiles they share.  The nodes of a
    crowded tile are cut into blocks of bounded size that face each other; there, nodes that are connected already are skipped.
    """
    one = classes.select(F.col("node").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    two = classes.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    pairs = met.filter("not crowded").select("a", "b").distinct().join(one, "a").join(two, "b")
    pairs = pairs.filter((F.least("n1", "n2") * t.den >= F.greatest("n1", "n2") * t.num)).select("a", "b", "n1", "n2", "bits1", "bits2")

    def fitting(batches):
        for b in batches:
            total = b.column("n1").to_numpy() + b.column("n2").to_numpy()
            near = differing(b.column("bits1").to_pylist(), b.column("bits2").to_pylist()) <= total - 2 * t.overlap(total)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(near))

    crowd = saved(met.filter("crowded").select(F.col("a").alias("tile"), F.col("b").alias("node")).distinct())
    blocks = crowd.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = crowd.join(blocks, "tile").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.col("tile").alias("cand"), F.least("own", "other").alias("band"), F.greatest("own", "other").alias("part"), "node")
    dealt = dealt.join(classes, "node")

    def solve(rows):
        if len(rows) < 2:
            return []
        rows = sorted(rows)
        names, n = np.array([x[1] for x in rows]), np.array([x[0] for x in rows])
        bits = Bitmaps([x[2] for x in rows])
        label, out = np.arange(len(rows)), []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, np.searchsorted(n, n[i] * t.den // t.num, "right"))
            j = _near(n, bits, i, j[label[j] != label[i]], t)
            apart, which = np.unique(label[j], return_index=True)
            for x, k in zip(apart.tolist(), which.tolist()):
                out.append((int(names[i]), int(names[j[k]])))
            label[np.isin(label, apart)] = label[i]
        return out

    within = _per_block(dealt, ["n", "node", "bits"], n_tasks, solve, "a bigint, b bigint")
    return pairs.mapInArrow(fitting, "a bigint, b bigint").unionByName(within)


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Parity bitmap: differing bits of two bitmaps never outnumber the differing elements of the sets.

    It has a bit per element at least: in fewer bits any two large sets would differ by less than similar ones may.
    """
    bits = 64 * BITMAP_WORDS
    while bits < len(elements):
        bits *= 2
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).view(np.uint64)


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (a row each) as they are in `words` words, for no more words than they have."""
    return maps if maps.shape[1] == words else np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def _stacked(maps: list[bytes]) -> np.ndarray:
    """Bitmaps of one width as rows."""
    return np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)


def differing(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """Differing bits of the bitmaps one[k] and two[k], in the width of the narrower one."""
    out = np.zeros(len(one), np.int64)
    widths = np.array([(len(a), len(b)) for a, b in zip(one, two)]).reshape(-1, 2) // 8
    for u, v in np.unique(widths, axis=0).tolist():
        at = np.flatnonzero((widths == (u, v)).all(axis=1))
        a, b = (_folded(_stacked([maps[k] for k in at]), min(u, v)) for maps in (one, two))
        out[at] = np.bitwise_count(a ^ b).sum(axis=1)
    return out


class Bitmaps:
    """The bitmaps of some sets; two are compared in the width of the narrower one."""

    def __init__(self, maps: list[bytes]):
        self.width, self.row, self.maps = np.array([len(x) // 8 for x in maps]), np.zeros(len(maps), np.int64), {}
        for words in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == words)
            self.row[own] = np.arange(len(own))
            self.maps[words] = _stacked([maps[k] for k in own])

    def differ(self, i: int, j: np.ndarray) -> np.ndarray:
        """Differing bits of set i and each of the sets j."""
        width, out = int(self.width[i]), np.zeros(len(j), np.int64)
        mine = self.maps[width][self.row[i] : self.row[i] + 1]
        for words, maps in self.maps.items():
            at = np.flatnonzero(self.width[j] == words)
            if len(at):
                least = min(words, width)
                out[at] = np.bitwise_count(_folded(maps[self.row[j[at]]], least) ^ _folded(mine, least)).sum(axis=1)
        return out


def _elements(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, h1, h2, elements) of the documents in `wanted` (doc_id, h1, h2): sorted hashes as bytes.

    Only texts whose id passes a filter of fixed size are taken up again; the join with `wanted` decides.
    """
    held = docs.sparkSession.sparkContext.broadcast(bloom_of(wanted))

    def run(batches):
        for batch in batches:
            rows = pa.array(np.flatnonzero(bloom_has(held.value, batch.column("doc_id").to_numpy().view(np.uint64))))
            ids = batch.column("doc_id").take(rows)
            for w in pieces(batch.column("_text").take(rows), lower=True):
                h, first = shingle_sets(w, width)
                h1, h2 = digests(h, first)
                raw = [h[s:e].tobytes() for s, e in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.rows.start, len(raw)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(raw, pa.binary())],
                    names=["doc_id", "h1", "h2", "elements"],
                )

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, elements binary")


def linked(names: list, copies: list[int], sets: list[np.ndarray], t: Threshold, side: list[int] | None = None) -> list[tuple]:
    """All similar pairs of the sets (with `side`: those of different sides) as rows (a, b, n): links (a, b, null) that connect
    the sets as these pairs do (a spanning forest), and per set with partners (a, null, the sum of the partners' `copies`)."""
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, sets, names, copies = n[order], [sets[i] for i in order], [names[i] for i in order], np.array(copies, np.int64)[order]
    side = None if side is None else np.array(side)[order]
    maps = Bitmaps([bitmap(s).tobytes() for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate(([0], np.cumsum(n)))
    mark, label, partners = np.zeros(len(code), np.int32), np.arange(len(sets)), np.zeros(len(sets), np.int64)
    out = []
    for i in range(len(sets)):
        other = np.arange(i + 1, np.searchsorted(n, n[i] * t.den // t.num, "right"))
        if side is not None:
            other = other[side[other] != side[i]]
        other = _near(n, maps, i, other, t)
        if not len(other):
            continue
        mark[code[first[i] : first[i + 1]]] = 1
        starts = np.cumsum(n[other]) - n[other]
        at = np.repeat(first[other] - starts, n[other]) + np.arange(n[other].sum())
        both = np.add.reduceat(mark[code[at]], starts)
        mark[code[first[i] : first[i + 1]]] = 0
        hits = other[both >= t.overlap(n[other] + n[i])]
        partners[i] += copies[hits].sum()
        partners[hits] += copies[i]
        apart, which = np.unique(label[hits], return_index=True)
        for x, j in zip(apart.tolist(), hits[which].tolist()):
            if x != label[i]:
                out.append((names[i], names[j], None))
                label[label == x] = label[i]
    return out + [(names[i], None, int(partners[i])) for i in np.flatnonzero(partners)]


def _per_block(blocks: DataFrame, columns: list[str], n_tasks: int, solve, schema: str) -> DataFrame:
    """`solve` over the rows (columns) of every block (cand, band, part); blocks pass one after the other in key order."""
    keys, fields = ["cand", "band", "part"], [x.split() for x in schema.split(", ")]
    kinds = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64()}[kind]) for name, kind in fields])

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    def run(batches):
        now, rows = None, []
        for b in batches:
            out = []
            for *key, row in zip(*[b.column(c).to_pylist() for c in keys], zip(*[b.column(c).to_pylist() for c in columns])):
                if key != now:
                    out += solve(rows)
                    now, rows = key, []
                rows.append(row)
            yield packed(out)
        yield packed(solve(rows))

    return blocks.repartition(min(n_tasks, MOST_TASKS), *keys).sortWithinPartitions(*keys).select(*keys, *columns).mapInArrow(run, schema)


def _block_links(blocks: DataFrame, n_tasks: int, t: Threshold) -> DataFrame:
    """Rows (a, b, n) of `linked` within every block of (node, copies, elements)."""

    def solve(rows):
        sets = {node: (copies, np.frombuffer(elements, np.uint64)) for node, copies, elements in rows}
        return linked(list(sets), *[list(x) for x in zip(*sets.values())], t) if len(sets) > 1 else []

    return _per_block(blocks, ["node", "copies", "elements"], n_tasks, solve, "a string, b string, n bigint")


def _near(n: np.ndarray, bits: Bitmaps, i: int, j: np.ndarray, t: Threshold) -> np.ndarray:
    """Those of the sets j whose size and bitmap allow enough overlap with set i."""
    j = j[np.minimum(n[j], n[i]) * t.den >= np.maximum(n[j], n[i]) * t.num]
    total = n[j] + n[i]
    return j[bits.differ(i, j) <= total - 2 * t.overlap(total)]


def _facing(light: DataFrame) -> DataFrame:
    """The blocks of large groups face each other in tiles: (cand, tile, side, all columns); two blocks of equal or neighbouring
    size band, at least one with a row `todo`."""
    blocks = light.groupBy("cand", "band", "part").agg(F.max("todo").alias("todo"))
    other = blocks.select(F.col("cand").alias("c2"), F.col("band").alias("band2"), F.col("part").alias("part2"), F.col("todo").alias("todo2"))
    below = ((F.col("band2") == F.col("band")) & (F.col("part2") > F.col("part"))) | (F.col("band2") == F.col("band") + 1)
    pairs = blocks.join(other, (F.col("cand") == F.col("c2")) & below & (F.col("todo") | F.col("todo2")))
    pairs = saved(pairs.select("cand", "band", "part", "band2", "part2"))
    keys, rest = ["cand", "band", "part"], [c for c in light.columns if c not in ("band", "part")]
    left = light.join(pairs, keys).select(*rest, F.concat_ws(":", "band", "part", "band2", "part2").alias("tile"), F.lit(0).alias("side"))
    turned = pairs.select("cand", F.col("band").alias("band1"), F.col("part").alias("part1"), F.col("band2").alias("band"), F.col("part2").alias("part"))
    right = light.join(turned, keys).select(*rest, F.concat_ws(":", "band1", "part1", "band", "part").alias("tile"), F.lit(1).alias("side"))
    return left.unionByName(right)


def _partnered(light: DataFrame, n_tasks: int, t: Threshold) -> DataFrame:
    """(node) of the sets of (cand, band, part, single, node, n, bits) that have another set within reach of size and bitmap.

    A set that finds one in its own block is done; of groups with several blocks only the others are looked up elsewhere.
    """

    def marks(names, n, bits, todo):
        found = np.zeros(len(n), bool)
        for i in np.flatnonzero(todo):
            if not found[i]:
                j = _near(n, bits, i, np.delete(np.arange(len(n)), i), t)
                found[j] = True
                found[i] = len(j) > 0
        return [(names[i],) for i in np.flatnonzero(found & todo)]

    def within(rows):
        if len(rows) < 2:
            return []
        names, n, bits = zip(*rows)
        return marks(names, np.array(n), Bitmaps(bits), np.ones(len(n), bool))

    here = saved(_per_block(light, ["node", "n", "bits"], n_tasks, within, "node string"))
    big = light.filter("not single").join(here.withColumn("todo", F.lit(False)), "node", "left").withColumn("todo", F.coalesce("todo", F.lit(True)))

    def across(key, rows):
        bits = Bitmaps(rows["bits"].tolist())
        got = marks(rows["node"].tolist(), rows["n"].to_numpy(), bits, rows["todo"].to_numpy().astype(bool))
        return pd.DataFrame({"node": pd.Series([x[0] for x in got], dtype=str)})

    there = _facing(big.select("cand", "band", "part", "node", "n", "bits", "todo")).groupBy("cand", "tile").applyInPandas(across, "node string")
    return here.unionByName(there.distinct()).distinct()


def _cross_links(members: DataFrame, t: Threshold) -> DataFrame:
    """Rows (a, b, n) of `linked` for the pairs between blocks of large candidate groups.

    members: (cand, band, part, node, copies, n, bits, elements).  First only bitmaps meet in the tiles of block pairs; the
    elements of sets that have a partner on the other side follow, and are intersected in the tile.
    """
    light = members.select("cand", "band", "part", "node", "n", "bits", F.lit(True).alias("todo"))

    def screen(key, rows):
        n, side = rows["n"].to_numpy(), rows["side"].to_numpy()
        bits = Bitmaps(rows["bits"].tolist())
        found, right = np.zeros(len(n), bool), np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            j = _near(n, bits, i, right, t)
            found[j] = True
            found[i] = len(j) > 0
        return rows[found][["cand", "tile", "side", "node"]]

    kind = light.schema["cand"].dataType.simpleString()
    met = saved(_facing(light).groupBy("cand", "tile").applyInPandas(screen, f"cand {kind}, tile string, side int, node string"))

    def exact(key, rows):
        sets = [np.frombuffer(x, np.uint64) for x in rows["elements"]]
        out = linked(rows["node"].tolist(), rows["copies"].tolist(), sets, t, rows["side"].tolist())
        return pd.DataFrame({c: pd.Series([x[k] for x in out], dtype=kind) for k, (c, kind) in enumerate((("a", object), ("b", object), ("n", "Int64")))})

    facing = met.join(members.select("node", "copies", "elements"), "node")
    return facing.groupBy("cand", "tile").applyInPandas(exact, "a string, b string, n bigint")


def similar_groups(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, class_id, component_id (smallest doc_id reachable by links, itself included) and
    n_links (how many other rows it links with).

    Documents link if the Jaccard similarity of their sets of `width`-word shingles is num / den or more.  Words stand between
    ASCII white space, A-Z count as a-z; with fewer words than `width` the whole sequence is the one shingle.  class_id is the
    smallest doc_id with the same set.

    Null and empty texts, and texts without words, have an empty set and link with nothing.  Rows with null doc_id link with
    nothing (class and component null).  Repeated rows are copies, and link with each other.  Ties don't matter.  Empty table: no rows.  Other columns
    are ignored.
    """
    with own_tables(docs.sparkSession) as keep:
        return keep(_similar_groups(docs, width, Threshold(num, den)))


def _similar_groups(docs: DataFrame, width: int, t: Threshold) -> DataFrame:
    num, den = t.num, t.den
    bounded_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    n_buckets = max(8, -(-size // BUCKET_TEXT))
    passed = saved(signed(docs, width, t, n_buckets))
    sets = passed.filter("kind = 0").select("doc_id", "n", "h1", "h2", F.col("blob").alias("bits"))
    classes = saved(sets.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("copies")))
    low = F.col("h1").bitwiseAND(F.lit(int(LOW48)))
    met = saved(meetings(passed.filter("kind = 1"), n_buckets).unionByName(_held_apart(passed.filter("kind = 3"))))
    candidates = components(candidate_edges(met, classes.select(low.alias("node"), "n", "bits"), n_buckets, t)).withColumnRenamed("component", "cand")

    members = classes.withColumn("low", low).join(candidates, F.col("low") == F.col("node")).select("cand", "doc_id", "h1", "h2", "n", "bits", "copies")
    band = F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int")
    whole = members.groupBy("cand").agg(F.count("*").alias("all"), F.sum("n").alias("all_n")).filter("all > 1")
    banded = members.groupBy("cand", band.alias("band")).agg(F.count("*").alias("size"), F.sum("n").alias("size_n"))
    plan = banded.join(whole, "cand").withColumn("single", (F.col("all") <= BLOCK_SETS) & (F.col("all_n") <= BLOCK_ELEMENTS))
    parts = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("size_n") / BLOCK_ELEMENTS)).cast("int")
    plan = saved(plan.select("cand", "band", "single", F.when(F.col("single"), 1).otherwise(parts).alias("parts")))
    members = members.withColumn("band", band).join(plan, ["cand", "band"])
    node = F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0"))
    members = saved(
        members.select(
            "cand", "single", F.when(F.col("single"), F.lit(0)).otherwise(F.col("band")).cast("int").alias("band"), "parts",
            F.pmod(F.xxhash64("h1", "h2"), "parts").cast("int").alias("part"), node.alias("node"), "doc_id", "h1", "h2", "n", "bits", "copies",
        )
    )
    members = saved(members.join(_partnered(members, n_buckets, t), "node", "left_semi"))
    with_sets = saved(members.join(_elements(docs, members.select("doc_id"), width), ["doc_id", "h1", "h2"]))
    links = saved(_block_links(with_sets, n_buckets, t))
    if not members.filter("not single").isEmpty():
        big = with_sets.filter("not single").select("cand", "band", "part", "node", "copies", "n", "bits", "elements").dropDuplicates(["cand", "node"])
        links = saved(links.unionByName(_cross_links(big, t)))
    merged = components(links.filter("b is not null"))
    partners = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("partners"))
    named = classes.withColumn("node", node).join(merged, "node").select("component", "h1", "h2", "doc_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    group = named.join(least, "component").select("h1", "h2", "least")
    n_links = F.col("copies") - 1 + F.coalesce("partners", F.lit(0))
    of_class = classes.join(group, ["h1", "h2"], "left").withColumn("node", node).join(partners, "node", "left")
    of_class = saved(of_class.select("h1", "h2", F.col("doc_id").alias("class"), F.coalesce("least", "doc_id").alias("group"), n_links.alias("links")))
    out = sets.join(of_class, ["h1", "h2"], "left")
    own = F.col("n") == 0
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(own | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("class")).alias("class_id"),
        F.when(own | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("group")).alias("component_id"),
        F.when(own | F.col("doc_id").isNull(), 0).otherwise(F.col("links")).alias("n_links"),
    )


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """`docs` less every document that has a similar one, directly or through others, with a smaller doc_id; null ids all stay.

    Rows that share a doc_id stay or go together; they go if each of them has a smaller one.
    """
    groups = similar_groups(docs, **options).filter("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("component_id"))
    lost = saved(groups.filter("component_id < doc_id").select("doc_id"))
    kept = docs.join(lost, "doc_id", "left_anti")
    return kept.select(*docs.columns)
