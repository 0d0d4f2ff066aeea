"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved, text_of, without, words_of

#: Bits of a document's hash, and the bits that each histogram resolves; the last one resolves what is left.
HASH_BITS, LEVEL_BITS = 60, (12, 12, 36)


def word_count() -> Column:
    return F.size(words_of(text_of())).cast("bigint")


def document_hash(seed: str) -> Column:
    """60 bits of md5(seed, doc_id); a null id counts by its text."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text_of()))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) -> + target: the total is shared by weight, no target is above cap x size.

    Weights go round by code point order of the source, null last.  With w the weight and s the size of a source, the targets
    are min(cap * s, level * w) for the one level at which they sum to the total; it is found among the running sums of the
    sources in the order of cap * s / w.  The windows hold one row per source.
    """
    everything = W.partitionBy()
    ranked = (
        sizes.withColumn("n", F.row_number().over(everything.orderBy(F.col("source").isNull(), "source")))
        .withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int")))
        .withColumn("most", F.col("source_size").cast("double") * cap)
        .withColumn("ratio", F.col("most") / F.col("w"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
    )
    up = everything.orderBy("ratio", "n")
    level = (F.col("total") - F.coalesce(F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(
        up.rowsBetween(0, W.unboundedFollowing)
    )
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select("source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, budget) -> (source, edge, before, at): rows with hash < edge sum to `before` <= budget, those at the edge to `at`.

    Nested histograms: sizes by source and leading hash bits; only the bucket in which the budget ends is resolved further.
    Every histogram is summed before the shuffle; a window holds at most 4,096 rows of a source (the last one the few hashes of
    one bucket in 2^24).  A source whose rows do not exceed the budget has no edge.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("base"))
    done = 0
    for bits in LEVEL_BITS:
        part = rows
        if done:
            inner = state.select(F.col("source").alias("s"), "prefix")
            part = rows.join(inner, rows["source"].eqNullSafe(inner["s"]) & (F.shiftright(rows["hash"], HASH_BITS - done) == inner["prefix"])).drop("s", "prefix")
        done += bits
        sums = part.groupBy("source", F.shiftright("hash", HASH_BITS - done).alias("bucket")).agg(F.sum("size").alias("sum"))
        in_order = W.partitionBy("source").orderBy("bucket")
        known = state.select(F.col("source").alias("s"), "budget", "base")
        upto = sums.withColumn("upto", F.sum("sum").over(in_order))
        ends = upto.join(known, upto["source"].eqNullSafe(known["s"])).withColumn("upto", F.col("upto") + F.col("base"))
        state = saved(
            ends.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("sum") <= F.col("budget"))).select(
                "source", "budget", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("sum")).alias("base"), F.col("sum").alias("at")
            )
        )
    return state.select("source", F.col("prefix").alias("edge"), F.col("base").alias("before"), "at")


def mixing_plan(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, source, size, hash) and, per source (s), source_size, target, times and the hash edge."""
    rows = saved(docs.select("doc_id", "source", word_count().alias("size"), document_hash(seed).alias("hash")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    targets = saved(targets.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")))
    rest = F.col("target") - F.col("times") * F.col("source_size")
    edges = thresholds(rows, targets.select("source", rest.alias("budget")))
    plan = targets.join(edges.withColumnRenamed("source", "s"), targets["source"].eqNullSafe(F.col("s")), "left").drop("s")
    nearer = (F.col("before") + F.col("at") - rest) < (rest - F.col("before"))
    edge = F.when(nearer, F.col("edge") + 1).otherwise(F.col("edge"))
    edge = F.when(rest > 0, edge).otherwise(0)  # nothing is left to fill: empty documents aren't taken once more either
    return rows, saved(plan.select(F.col("source").alias("s"), "source_size", "target", "times", edge.alias("edge")))


def copies_of(hash_column: str) -> Column:
    return F.col("times") + F.when(F.col(hash_column) < F.col("edge"), 1).otherwise(0)


def mix(docs: DataFrame, **options) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken.

    A document's size is its number of words.  Every document of a source is taken floor(target / source_size) times, and those
    whose hash lies below the source's threshold once more; the documents at the threshold go to the nearer side.  No sort of
    documents takes place: thresholds come from nested histograms (`thresholds`).

    Null text: size 0.  Null source: a source of its own, last in order.  Null doc_id: hashed by its text.  Repeated rows have
    one hash and are taken alike.  Empty table: no rows.  Columns of `docs` other than doc_id, source and text are not read.
    A source of size 0 has target 0.  Documents of size 0 take 0 words.
    """
    rows, plan = mixing_plan(docs, **options)
    return rows.join(plan, rows["source"].eqNullSafe(plan["s"])).select(
        "doc_id", "source", "size", "source_size", "target", copies_of("hash").alias("copies"), (F.col("size") * copies_of("hash")).alias("taken")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of `docs`, all its columns, as often as `mix` says.  Texts are not shuffled: the plan has a row per source.

    Null and empty texts have size 0 and are taken as often as their source asks for, 3 times at most; null sources, null ids,
    repeated rows and the empty table are treated as in `mix`.  Columns of any name keep their values.
    """
    _, plan = mixing_plan(docs, **options)
    plan = plan.select(F.col("s").alias("_s"), "times", "edge")
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), docs["source"].alias("_source"), document_hash(options.get("seed", "mix")).alias("_hash"))
    hit = rows.join(plan, rows["_source"].eqNullSafe(plan["_s"])).withColumn("_n", copies_of("_hash").cast("int")).filter("_n > 0")
    return hit.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
