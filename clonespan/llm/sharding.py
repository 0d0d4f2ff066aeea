"""Sharding by a two-pass external shuffle; DataFrame functions only.

Pass 1 scatters the records uniformly over buckets of bounded size with a seeded hash.  Pass 2 shuffles every bucket in memory
(Spark's `shuffle` is a Fisher-Yates shuffle).  Buckets in order give one random order of all records, which is cut into shards
whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved, scratch, text_of, without

#: Bytes and records that a bucket holds on average.
BUCKET_BYTES, BUCKET_ROWS = 16 << 20, 20_000


def text_size() -> Column:
    return (F.octet_length(text_of()) + 16).cast("bigint")


def scattered(rows: DataFrame, seed: int, bucket_bytes: int, bucket_rows: int, size: str) -> DataFrame:
    """Pass 1: (row, place, bucket).  Equal rows are told apart by a running number, so that no group of copies shares a bucket."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n_buckets = max(1, -(-total[0] // bucket_bytes), -(-total[1] // bucket_rows))
    names = [F.col(f"`{c}`") for c in rows.columns]
    packed = rows.select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("place"))
    return packed.select("row", "place", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(n_buckets)).cast("int").alias("bucket"))


def external_shuffle(rows: DataFrame, n_shards: int, size: str, seed: int = 20_240_229, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`rows` with `shard` (0 to n_shards - 1) and `slot` (place in the shard, gapless from 0), in random order.

    Row counts of the shards differ by one at most.  `size` names a column with a row's bytes, from which the number of buckets
    follows.  A bucket is a seeded sample of the rows, so its size does not depend on keys, sources or copies.  The row's place
    in the input decides the bucket: reruns over the same files with the same splits agree.

    Null values, repeated rows and null ids are rows like others.  Empty table: no rows.  Columns of `rows` that are called
    shard or slot are replaced.
    """
    rows = without(rows, "shard", "slot")
    placed = saved(scattered(rows, seed, bucket_bytes, bucket_rows, size), compression="zstd")
    in_order = W.partitionBy().orderBy("bucket")
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = saved(
        counts.select("bucket", (F.sum("n").over(in_order) - F.col("n")).alias("offset"), F.sum("n").over(W.partitionBy()).alias("total"))
    )
    # whole buckets in ranges: tasks follow each other in the random order
    gathered = placed.repartitionByRange("bucket").groupBy("bucket").agg(F.collect_list("row").alias("rows"), F.collect_list("place").alias("places"))
    # in order of place: rows need not have an order (maps have none), and texts are not compared
    order = F.sort_array(F.transform("places", lambda p, i: F.struct(p.alias("place"), i.alias("i"))))
    gathered = gathered.select("bucket", F.transform(order, lambda o: F.get("rows", o["i"])).alias("rows"))
    mixed = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    ranked = mixed.join(offsets, "bucket").select("offset", "total", F.posexplode("rows").alias("pos", "row"))
    rank = F.col("offset") + F.col("pos")
    # shard s takes the ranks from ceil(s * total / shards) on
    shard = F.expr(f"(offset + pos) * {n_shards}L div total")
    first = F.expr(f"(shard * total + {n_shards - 1}L) div {n_shards}L")
    return (
        ranked.withColumn("shard", shard).withColumn("slot", rank - first)
        .select("row.*", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, **options) -> DataFrame:
    """Whole documents in shards below `path` (a folder shard=<n> each, files in slot order); returns what was written.

    Null and empty texts, null ids and repeated rows are written like others.  A column called _size is left out, those called
    shard or slot are replaced.  Empty table: no shard is written, no rows come back.
    """
    sized = without(docs, "_size").withColumn("_size", text_size())
    placed = external_shuffle(sized, n_shards, "_size", **options).drop("_size")
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 40, **options) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes + 16), text_crc32, law (`rows`), shard, slot, grown_shard (null under this law).

    The documents are written to shards in the shared folder; what comes back is measured on the texts found there.  Null
    text: size 16, crc of the empty text.
    """
    written = write_shards(docs, scratch(docs.sparkSession), n_shards, **options)
    crc = F.crc32(text_of().cast("binary")).cast("bigint").alias("text_crc32")
    return written.select("doc_id", text_size().alias("size"), crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
