"""SimHash near-duplicates: fingerprints of word shingles, and links within a few bits found by pigeonring filtering.

The 64 bits stand in a ring of m = max_bits + 1 segments.  If two fingerprints differ in at most max_bits bits, some segment of
the ring begins a chain whose first l segments together differ in at most l * max_bits / m bits, for every l from 1 to m (the
strong form of the pigeonhole principle).  Hence the chain's first segment is equal, its second differs in at most one bit,
and so on.  A key is (first segment of the chain, the second one less one of its QUARTERS parts): a pair of similar fingerprints
shares such a key.  Pairs that share one pass the chain's further budgets before their whole distance is looked at.

Equal fingerprints are one class throughout.  A key of many fingerprints is cut into blocks, and the pairs of its blocks are
tasks' work of bounded size.  Every block gives only the edges that connect what it links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, components, saved, text_of

#: Fixed value: seed of the shingle hash.
SEED = 42
#: Parts of a chain's second segment, one of which may differ; fingerprints of a block; shingles hashed at once.
QUARTERS, BLOCK, HASHED = 4, 4_096, 1 << 16


def fingerprint(text: bytes, width: int) -> int:
    """Majority bits of the shingles' XXH64; a text without words has 0.  Bytes A-Z count as a-z."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASHED):
        spans = zip(starts[at : min(n, at + HASHED)].tolist(), ends[at : at + HASHED].tolist())
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the fingerprint as a signed bigint."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column("_text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def segments(max_bits: int) -> list[int]:
    """Where the ring's segments begin, and 64."""
    return [64 * i // (max_bits + 1) for i in range(max_bits + 2)]


def _bits(fp: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def chain_keys(fp: Column, max_bits: int) -> Column:
    """The keys of a fingerprint, an array of structs (chain, part, bits)."""
    cuts, out = segments(max_bits), []
    for chain in range(max_bits + 1):
        second = (chain + 1) % (max_bits + 1)
        first, at, n = _bits(fp, cuts[chain], cuts[chain + 1] - cuts[chain]), cuts[second], cuts[second + 1] - cuts[second]
        for part in range(QUARTERS):
            lo, hi = n * part // QUARTERS, n * (part + 1) // QUARTERS
            rest = F.shiftleft(_bits(fp, at, n).bitwiseAND(F.lit((1 << n) - 1 - ((1 << hi) - (1 << lo)))), 32)
            out.append(F.struct(F.lit(chain).alias("chain"), F.lit(part).alias("part"), rest.bitwiseOR(first).alias("bits")))
    return F.array(*out)


def chain_masks(chain: int, max_bits: int) -> list[tuple[np.uint64, int]]:
    """(mask of the chain's first l segments, bits that may differ there) for l = 2, 3, ..., the whole ring last."""
    cuts, m, mask, out = segments(max_bits), max_bits + 1, 0, []
    for length in range(1, m + 1):
        i = (chain + length - 1) % m
        mask |= (1 << cuts[i + 1]) - (1 << cuts[i])
        out.append((np.uint64(mask), length * max_bits // m))
    return out[1:]


def linked(fps: np.ndarray, side: np.ndarray, masks: list[tuple[np.uint64, int]]) -> list[tuple[int, int]]:
    """Edges (places) that connect the fingerprints as all their links do; with two sides, as the links between them do."""
    label, both, out = np.arange(len(fps)), len(np.unique(side)) > 1, []
    for i in range(len(fps) - 1):
        j = np.arange(i + 1, len(fps))
        j = j[label[j] != label[i]]
        if both:
            j = j[side[j] != side[i]]
        differ = fps[j] ^ fps[i]
        for mask, budget in masks:
            near = np.bitwise_count(differ & mask) <= budget
            j, differ = j[near], differ[near]
        apart, which = np.unique(label[j], return_index=True)
        for x, k in zip(apart.tolist(), which.tolist()):
            out.append((i, int(j[k])))
            label[label == x] = label[i]
    return out


def links(classes: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints `fp` of `classes` that connect them as all links do."""
    keys = ["chain", "part", "bits"]
    keyed = classes.select("fp", F.explode(chain_keys(F.col("fp"), max_bits)).alias("k")).select("fp", "k.*")
    crowded = saved(keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = keyed.join(crowded.select(*keys, blocks.alias("blocks")), keys)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("fp", *keys, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    keys += ["x", "y"]
    masks = [chain_masks(c, max_bits) for c in range(max_bits + 1)]

    def solve(rows):
        fps = np.array([x[0] for x in rows], np.int64).view(np.uint64)
        pairs = linked(fps, np.array([x[1] for x in rows]), masks[rows[0][2]])
        return [(rows[i][0], rows[j][0]) for i, j in pairs]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        now, rows = None, []
        for b in batches:
            out = []
            for *key, fp, side in zip(*[b.column(c).to_pylist() for c in [*keys, "fp", "side"]]):
                if key != now:
                    out += solve(rows) if len(rows) > 1 else []
                    now, rows = key, []
                rows.append((fp, side, key[0]))
            yield packed(out)
        yield packed(solve(rows) if len(rows) > 1 else [])

    dealt = met.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "fp", "side").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3) -> DataFrame:
    """Per row of `docs`: doc_id, fingerprint (16 hex digits), class_id (smallest doc_id with that fingerprint) and component_id
    (smallest doc_id reachable by links, itself included).

    A fingerprint bit is 1 if more than half of the hashes of the `width`-word shingles, repeats included, have it; with fewer
    words the whole sequence is the one shingle.  Words stand between ASCII white space, A-Z count as a-z.  Rows link if their
    fingerprints differ in at most `max_bits` bits (0 to 15).

    Null and empty texts, and texts without words, have fingerprint 0 and link like any other.  Rows with null doc_id have a
    fingerprint, no class or component, and connect nothing.  Repeated rows are copies; rows that share a doc_id but not the text are
    grouped each by its own text.  Ties don't matter.  Empty table: no rows.
    Other columns are ignored.
    """
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must be 0 to 15")
    rows = saved(fingerprints(docs, width))
    classes = saved(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    group = classes.select("fp", F.col("least").alias("class_id"), F.col("least").alias("component_id"))
    if max_bits:
        merged = components(links(classes, max_bits)).join(classes, F.col("node") == F.col("fp")).select("component", "fp", "least")
        tops = merged.groupBy("component").agg(F.min("least").alias("component_id"))
        merged = merged.join(tops, "component").select("fp", "component_id")
        group = saved(classes.join(merged, "fp", "left").select("fp", F.col("least").alias("class_id"), F.coalesce("component_id", "least").alias("component_id")))
    out = rows.join(group.withColumnRenamed("fp", "_fp"), rows["fp"] == F.col("_fp"), "left")
    named = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(named, F.col("class_id")).alias("class_id"), F.when(named, F.col("component_id")).alias("component_id"),
    )


def one_per_group(docs: DataFrame, **options) -> DataFrame:
    """`docs` less every row whose group has a smaller doc_id; rows with null doc_id all stay, rows that share a doc_id stay or
    go together (they go if each of them has a smaller one).  Same columns as `docs`."""
    groups = near_duplicates(docs, **options).filter("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("component_id"))
    lost = saved(groups.filter("component_id < doc_id").select(F.col("doc_id").alias("_lost")))
    return docs.join(lost, docs["doc_id"].cast("bigint") == lost["_lost"], "left_anti")
