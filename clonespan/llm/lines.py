"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

The state of an index is three tables in the shared folder:

* `refs`    (shard, k1, k2, doc_id)           which document holds which line key: the exact references;
* `counts`  (shard, k1, k2, n_docs, last_doc)  the exact reference count of a key, and the largest document that holds it;
* `filters` (shard, n_buckets, slots)          a cuckoo filter per shard over the keys that are held often enough to be dropped.

A line of a document is dropped if its key's filter says "maybe" and the exact table agrees.  Inserting or deleting documents
changes references and counts, and moves keys into or out of the filters when their count passes the limit, so a deletion
undoes an insertion.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, saved, text_of

#: A key counts from so many code points on; keys in so many documents are dropped; keys per shard and rows per probing task.
MIN_CHARS, MIN_DOCS, SHARD_KEYS, PROBE_ROWS = 20, 3, 100_000, 100_000
#: Fixed class: white space that is stripped.
STRIP = b" \t\n\x0b\x0c\r"
SLOTS = 4


def line_key(line: bytes) -> bytes | None:
    """The 128-bit digest of a line's key, None if the key is too short to count."""
    key = line.strip(STRIP).lower()
    if len(key) < MIN_CHARS or len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "replace")) < MIN_CHARS:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets.  False positives only, deletions allowed."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n_keys: int) -> "CuckooFilter":
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, n_keys) / (SLOTS * 0.7)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def holding(cls, k1: np.ndarray, k2: np.ndarray) -> "CuckooFilter":
        """A filter with all the keys; doubled until they fit."""
        size = len(k1)
        while True:
            built = cls.sized(size)
            if built.insert(k1, k2):
                return built
            size = max(2 * size, 8)

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.slots) - 1)
        mark = (k2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (k1.astype(np.uint64) & mask).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995) & (len(self.slots) - 1))

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one = self._places(k1, k2)
        return (self.slots[one] == mark[:, None]).any(axis=1) | (self.slots[self._other(mark, one)] == mark[:, None]).any(axis=1)

    def _fill(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; True where there was none."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        nth = np.arange(len(b)) - np.searchsorted(b, b)
        free = np.argsort(self.slots[b] != 0, axis=1, kind="stable")
        n_free = (self.slots[b] == 0).sum(axis=1)
        fits = nth < n_free
        self.slots[b[fits], free[fits, nth[fits]]] = mark[order][fits]
        left = np.empty(len(b), bool)
        left[order] = ~fits
        return left

    def insert(self, k1: np.ndarray, k2: np.ndarray, kicks: int = 500) -> bool:
        """Insert all keys at once: first their one bucket, then the other, then evict rounds.  False if some found no place."""
        mark, bucket = self._places(k1, k2)
        left = self._fill(mark, bucket)
        mark, bucket = mark[left], self._other(mark[left], bucket[left])
        for turn in range(kicks):
            left = self._fill(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return True
            # one waiting mark per full bucket takes the place of an old one, which goes to its other bucket
            at, first = np.unique(bucket, return_index=True)
            victim = self.slots[at, turn % SLOTS].copy()
            self.slots[at, turn % SLOTS] = mark[first]
            rest = np.ones(len(mark), bool)
            rest[first] = False
            mark, bucket = np.concatenate([mark[rest], victim]), np.concatenate([bucket[rest], self._other(victim, at)])
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take one fingerprint per key out; the keys must have been inserted."""
        for m, b in zip(*self._places(k1, k2)):
            for place in (b, int(self._other(np.array([m]), np.array([b]))[0])):
                at = np.flatnonzero(self.slots[place] == m)
                if len(at):
                    self.slots[place, at[0]] = 0
                    break


def line_references(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id) for every different key of every document."""

    def run(batches):
        for b in batches:
            digests, rows = [], []
            for i, x in enumerate(b.column("_text")):
                keys = {k for line in x.as_py().split(b"\n") if (k := line_key(line))}
                digests += keys
                rows += [i] * len(keys)
            k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), b.column("doc_id").take(pa.array(rows, pa.int64()))], names=["k1", "k2", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().cast("binary").alias("_text"))
    return rows.mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("shard", "k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


@dataclass
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> "LineIndex":
        """An index of `docs`; the number of shards follows the number of references."""
        bounded_batches(docs.sparkSession)
        plain = saved(line_references(docs))
        n_shards = max(1, -(-plain.count() // shard_keys))
        refs = plain.select(F.pmod("k1", F.lit(n_shards)).cast("int").alias("shard"), "k1", "k2", "doc_id")
        counts = saved(_counted(refs))

        def build(key, keys):
            built = CuckooFilter.holding(keys["k1"].to_numpy(), keys["k2"].to_numpy())
            return pd.DataFrame({"shard": [int(key[0])], "n_buckets": [len(built.slots)], "slots": [built.slots.tobytes()]})

        frequent = counts.filter(F.col("n_docs") >= min_docs)
        filters = saved(frequent.groupBy("shard").applyInPandas(build, "shard int, n_buckets int, slots binary"))
        return cls(refs, counts, filters, n_shards, min_docs)

    def _refs_of(self, docs: DataFrame) -> DataFrame:
        return line_references(docs).select(F.pmod("k1", F.lit(self.n_shards)).cast("int").alias("shard"), "k1", "k2", "doc_id")

    def _moved(self, counts: DataFrame, refs: DataFrame) -> "LineIndex":
        """The index with new counts and references; keys that passed the limit enter or leave the filters."""
        old = self.counts.select("shard", "k1", "k2", (F.col("n_docs") >= self.min_docs).alias("was"))
        now = counts.select("shard", "k1", "k2", (F.col("n_docs") >= self.min_docs).alias("is"))
        both = old.join(now, ["shard", "k1", "k2"], "full").select("shard", "k1", "k2", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is", F.lit(False)).alias("is"))
        changes, frequent = saved(both.filter("was <> is")), counts.filter(F.col("n_docs") >= self.min_docs)

        def change(key, filters, keys):
            k1, k2, enters = keys["k1"].to_numpy(), keys["k2"].to_numpy(), keys["is"].to_numpy().astype(bool)
            if len(filters):
                f = CuckooFilter(np.frombuffer(filters["slots"].iloc[0], np.uint16).reshape(-1, SLOTS).copy())
            else:
                f = CuckooFilter.sized(int(enters.sum()))
            f.delete(k1[~enters], k2[~enters])
            full = not f.insert(k1[enters], k2[enters])
            return pd.DataFrame({"shard": [int(key[0])], "n_buckets": [0 if full else len(f.slots)], "slots": [f.slots.tobytes()]})

        schema = "shard int, n_buckets int, slots binary"
        filters = saved(self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(change, schema))

        def rebuild(key, keys):  # the shards that overflowed
            built = CuckooFilter.holding(keys["k1"].to_numpy(), keys["k2"].to_numpy())
            return pd.DataFrame({"shard": [int(key[0])], "n_buckets": [len(built.slots)], "slots": [built.slots.tobytes()]})

        again = frequent.join(filters.filter("n_buckets = 0").select("shard"), "shard", "left_semi").groupBy("shard").applyInPandas(rebuild, schema)
        return LineIndex(refs, counts, saved(filters.filter("n_buckets > 0").unionByName(again)), self.n_shards, self.min_docs)

    def insert(self, docs: DataFrame) -> "LineIndex":
        """The index with `docs` added.  Documents of ids that it holds already are left out: `delete` these first."""
        held = self.refs.select("doc_id").distinct()
        new = saved(self._refs_of(docs).join(held, "doc_id", "left_anti").select("shard", "k1", "k2", "doc_id"))
        merged = self.counts.unionByName(_counted(new)).groupBy("shard", "k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return self._moved(saved(merged), self.refs.unionByName(new))

    def delete(self, ids: DataFrame) -> "LineIndex":
        """The index without the documents whose doc_id is in `ids`; only the keys that they held are counted anew."""
        gone = ids.select("doc_id").distinct()
        touched = saved(self.refs.join(gone, "doc_id", "left_semi").select("shard", "k1", "k2").distinct())
        refs = saved(self.refs.join(gone, "doc_id", "left_anti").select("shard", "k1", "k2", "doc_id"))
        keys = ["shard", "k1", "k2"]
        anew = _counted(refs.join(touched, keys, "left_semi"))
        return self._moved(saved(self.counts.join(touched, keys, "left_anti").unionByName(anew.select(*self.counts.columns))), refs)

    def maybe(self, refs: DataFrame) -> DataFrame:
        """The references whose key the shard's filter may hold.

        A shard's references are dealt over as many tasks as their number asks for, each with a copy of the filter, so that a
        key that stands in every document does not land in one task.
        """
        sizes = saved(refs.groupBy("shard").agg(F.ceil(F.count("*") / PROBE_ROWS).cast("int").alias("parts")))
        salted = refs.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "k2"), "parts").cast("int")).drop("parts")
        copies = self.filters.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def probe(key, rows, filters):
            if not len(rows) or not len(filters):
                return rows.iloc[:0][["shard", "k1", "k2", "doc_id"]]
            held = CuckooFilter(np.frombuffer(filters["slots"].iloc[0], np.uint16).reshape(-1, SLOTS))
            return rows[held.contains(rows["k1"].to_numpy(), rows["k2"].to_numpy())][["shard", "k1", "k2", "doc_id"]]

        grouped = salted.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part"))
        return grouped.applyInPandas(probe, "shard int, k1 bigint, k2 bigint, doc_id bigint")

    def drops(self, refs: DataFrame | None = None) -> DataFrame:
        """(doc_id, k1, k2): the lines that documents lose; by default for the documents of the index."""
        frequent = self.counts.filter(F.col("n_docs") >= self.min_docs).select("shard", "k1", "k2", "last_doc")
        checked = self.maybe(self.refs if refs is None else refs).join(frequent, ["shard", "k1", "k2"])
        lose = F.coalesce(F.col("doc_id") < F.col("last_doc"), F.col("last_doc").isNotNull())
        return checked.filter(lose).select("doc_id", "k1", "k2")

    def apply(self, docs: DataFrame, keep_text: bool = True) -> DataFrame:
        """`docs` less the lines that the index drops, with n_lines (before), n_dropped and kept_sha256; see `dedup_lines`."""
        results = ("n_lines", "n_dropped", "kept_sha256")
        names = [c for c in docs.columns if c.lower() not in results and (keep_text or c != "text")]
        lost = self.drops().distinct().groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("_lost")).withColumnRenamed("doc_id", "_id")
        rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"), text_of().cast("binary").alias("_text"))
        joined = rows.join(lost, rows["_doc"].eqNullSafe(lost["_id"]), "left").select("_row", "_text", "_lost")

        def run(batches):
            for b in batches:
                n_lines, n_dropped, digest, texts = [], [], [], []
                for x, lost_keys in zip(b.column("_text"), b.column("_lost")):
                    lines = x.as_py().split(b"\n")
                    kept = lines
                    if lost_keys.is_valid:
                        pairs = lost_keys.values
                        flat = np.stack([pairs.field("k1").to_numpy(), pairs.field("k2").to_numpy()], axis=1).tobytes()
                        gone = {flat[i : i + 16] for i in range(0, len(flat), 16)}
                        kept = [line for line in lines if line_key(line) not in gone]
                    text = b"\n".join(kept)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                    digest.append(hashlib.sha256(text).hexdigest())
                    texts.append(text if keep_text else b"")
                columns = [b.column("_row"), pa.array(texts, pa.binary()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", "_kept", *results])

        row_type = joined.schema["_row"].dataType.simpleString()
        out = joined.mapInArrow(run, f"_row {row_type}, _kept binary, n_lines bigint, n_dropped bigint, kept_sha256 string")
        columns = [F.col("_kept").cast("string").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in names]
        return out.select(*columns, *results)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_text: bool = True) -> DataFrame:
    """Drop the lines that stand in `min_docs` documents or more from all of them but that with the largest doc_id.

    A text is split at line feeds; a line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of fewer
    than MIN_CHARS code points are never dropped.  Returns `docs` with the kept text (with keep_text), n_lines, n_dropped and
    kept_sha256.  The last document keeps all its lines of a key, others lose all of them.

    Null or empty text: one empty line.  Null doc_id: a document like others, smaller than any other.  Rows with one doc_id are
    documents of their own; those that tie on the largest id keep their lines.  Empty table: no rows.  Columns of `docs` called
    like a result column are replaced.
    """
    return LineIndex.build(docs, min_docs).apply(docs, keep_text)
