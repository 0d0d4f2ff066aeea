"""Running totals, positions, quantiles and score blocks that stay distributed when one group holds most rows.

A window partitioned by the group alone sends a hot group to one task.  These operators add a *level*: a monotone
function of the ordering value that cuts every group into consecutive slices.  Totals inside a slice come from a window
over (group, slice); totals of the earlier slices come from a window over the slice totals, whose row count is bounded by
the number of slices.  Equal values are collapsed to one weighted row first, so ties never pile up in one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import col
from ..session import stored

LEVEL = "_level"


def unit_level(c: str | Column, per_octave: int = 64) -> Column:
    """Slice of a value in [0, 1], monotone in it: fine on a log scale towards 0 and towards 1, where rare-event scores crowd."""
    x = F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0))
    low = F.floor((F.log2(F.greatest(x, F.lit(2.0**-60))) + 61.0) * per_octave)
    high = F.floor((-F.log2(F.greatest(1.0 - x, F.lit(2.0**-60))) + 61.0) * per_octave)
    return F.when(x < 0.5, low).otherwise(high)


def small_share_level(c: str | Column, per_octave: int = 64) -> Column:
    """Slice of a positive share on a log scale: heavy-tailed frequencies spread evenly."""
    return F.floor(F.log2(F.greatest(col(c), F.lit(1e-300))) * per_octave)


def attach_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Add the columns of a per-key table; without keys the table has one row and is read as one scalar subquery of a struct."""
    if keys:
        return df.join(totals, keys)
    row = totals.select(F.struct(*totals.columns).alias("_totals")).scalar()
    return df.select("*", F.inline(F.array(row)))


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    measures: list[str],
    level: Column,
    level_descending: bool = False,
) -> DataFrame:
    """Add `<measure>_before`: the total of the measure over the rows that precede the row inside its group.

    `order` must be unique within a group and `level` monotone in it (falling when `level_descending`).
    """
    sliced = df.withColumn(LEVEL, level)
    inside = Window.partitionBy(*keys, LEVEL).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lv = F.col(LEVEL).desc() if level_descending else F.col(LEVEL).asc()
    across = Window.partitionBy(*keys).orderBy(lv).rowsBetween(Window.unboundedPreceding, -1)
    slices = sliced.groupBy(*keys, LEVEL).agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    offsets = slices.select(*keys, LEVEL, *[F.coalesce(F.sum(f"_t_{m}").over(across), F.lit(0)).alias(f"_o_{m}") for m in measures])
    local = sliced.select("*", *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_l_{m}") for m in measures])
    # rows exploded from a small table look small to Spark; they are in order already, and the driver must not hold them
    joined = local.hint("shuffle_merge").join(offsets, [*keys, LEVEL])
    return joined.select(*df.columns, *[(F.col(f"_l_{m}") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures])


def ordered_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add the 1-based rank of every row inside its group; `order` must be unique within a group.

    One sort of all rows in ranges, written with a running number.  A group's numbers are consecutive in every file's part of
    the sort, so a row per group and part, with the number of the group's rows in earlier parts, turns them into ranks.
    """
    rows = stored(df.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    parts = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(parts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    ranked = rows.withColumn("_part", part)
    same = [ranked[k].eqNullSafe(offsets[k]) for k in keys] + [ranked["_part"] == offsets["_part"]]
    return ranked.join(offsets, same).select(*[ranked[c] for c in df.columns], (ranked["_id"] + offsets["_shift"]).alias(name))


def positions(df: DataFrame, keys: list[str], hash_col: str, tie: str, name: str = "position") -> DataFrame:
    """0-based position of every row inside its group, ordered by a hex hash text and then the tie column."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(counted, keys, [F.col(hash_col), F.col(tie)], ["_one"], F.substring(hash_col, 1, 2))
    return ranked.withColumnRenamed("_one_before", name).drop("_one")


def value_blocks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One weighted row per distinct value of a group."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], level: Column | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, named by `probs`; nulls are ignored."""
    blocks = value_blocks(df.filter(F.col(value).isNotNull()), keys, value)
    lv = level if level is not None else unit_level(value)
    ranked = running_totals(blocks, keys, [F.col(value)], ["n"], lv)
    sizes = blocks.groupBy(*keys).agg(F.sum("n").alias("_size"))
    ranked = attach_totals(ranked, sizes, keys)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col(value)))

    aggs = [F.max("_size").alias("_size")]
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("_size") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)


def score_blocks(
    df: DataFrame, keys: list[str], score: str, label: str, extra_thresholds: list[float] | None = None
) -> DataFrame:
    """Per group and distinct score: positives and negatives at the score and above it (higher scores first).

    The blocks are written once: ranks and totals read them in several branches, which would fold the rows again each.
    `extra_thresholds` adds cut-offs that no row carries, with zero rows of their own.
    """
    y = F.col(label).cast("bigint")
    rows = df.select(*keys, F.col(score).alias("threshold"), y.alias("pos"), (F.lit(1) - y).alias("neg"))
    blocks = rows.groupBy(*keys, "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    if extra_thresholds:
        zero = F.lit(0).cast("bigint")
        values = F.explode(F.array(*[F.lit(float(t)) for t in extra_thresholds]))
        groups = blocks.select(*keys).distinct() if keys else blocks.groupBy().agg(F.count(F.lit(1)).alias("_n")).drop("_n")
        extra = groups.select(*keys, values.alias("threshold"), zero.alias("pos"), zero.alias("neg"))
        blocks = blocks.unionByName(extra).groupBy(*keys, "threshold").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = running_totals(
        stored(blocks), keys, [F.col("threshold").desc()], ["pos", "neg"], unit_level("threshold"), level_descending=True
    )
    return ranked.select(
        *keys, "threshold", "pos", "neg", "pos_before", "neg_before",
        (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"),
    )
