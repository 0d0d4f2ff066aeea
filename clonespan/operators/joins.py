"""Checked joins, set comparisons, unions and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if


def key_counts(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))


def checked_left_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Left join that stops the job when a key repeats on the right or a left row finds no partner.

    Only the keys of the right side are counted, whatever it carries; the check runs inside the join, not as an extra job.
    """
    payload = [c for c in right.columns if c not in key]
    clash = sorted(set(payload) & set(left.columns))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    counts = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    joined = left.join(counts, key, "left").join(right, key, "left")
    verdict = (
        F.when(F.col("_rows").isNull(), F.raise_error(F.concat(F.lit("no partner for key "), F.concat_ws(",", *key))))
        .when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws(",", *key))))
        .otherwise(F.lit(True))
    )
    return joined.filter(verdict).select(*left.columns, *payload)


def id_set_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys present on one side only, with the side; both sides equal when the result is empty."""
    left = a.select(*key).distinct().withColumn("in_a", F.lit(1))
    right = b.select(*key).distinct().withColumn("in_b", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True).groupBy(*key).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    only = both.filter(F.col("in_a").isNull() | F.col("in_b").isNull())
    return only.select(*key, F.when(F.col("in_b").isNull(), "only_in_a").otherwise("only_in_b").alias("side"))


def with_dynamic_features(static: DataFrame, dynamic: DataFrame, key: list[str]) -> DataFrame:
    """Features that change with the task next to the features that don't: one row per row of `dynamic` that has a static partner.

    `dynamic` is often exploded from a small table, by whose size Spark would broadcast it; the hint keeps it from the driver.
    """
    clash = sorted((set(static.columns) & set(dynamic.columns)) - set(key))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    return dynamic.hint("shuffle_merge").join(static, key)


def key_difference(a: DataFrame, b: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Distinct keys of `a` that `b` (column `other`) doesn't have; null counts as a value."""
    return a.select(key).subtract(b.select(other or key))


def key_intersection(a: DataFrame, b: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Distinct keys that both sides have; null counts as a value."""
    return a.select(key).intersect(b.select(other or key))


def shared_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys present on both sides; disjoint when the result is empty."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_semi")


def receptor_blocks(df: DataFrame, receptor: str, prefixes: dict[str, str], key: str) -> DataFrame:
    """(receptor, key, features) -> one row per key with one prefixed block of columns per receptor, in one aggregation."""
    features = [c for c in df.columns if c not in (receptor, key)]
    cells = [F.max(F.when(F.col(receptor) == r, F.col(c))).alias(p + c) for r, p in prefixes.items() for c in features]
    return df.groupBy(key).agg(*cells)


def paired_blocks(
    blocks: dict[str, DataFrame], mapping: DataFrame, patient: str = "patient", library: str = "library_id"
) -> DataFrame:
    """Each receptor block mapped library -> patient, prefixed and joined on the patient.

    `mapping` has (patient, receptor, library_id); the block key is the receptor name, its prefix the lower-case name.
    """
    parts = []
    for receptor, block in blocks.items():
        ids = mapping.filter(F.col("receptor") == receptor).select(patient, library)
        named = block.join(ids, library).drop(library)
        parts.append(named.select(patient, *[F.col(c).alias(f"{receptor.lower()}_{c}") for c in named.columns if c != patient]))
    return reduce(lambda a, b: a.join(b, patient), parts)


def grid_completion(observed: DataFrame, axes: dict[str, list[float]], count: str, keys: list[str] | None = None) -> DataFrame:
    """All cells of a parameter grid, per key, with their observed counts, 0 where a cell never occurred.

    The counts fold to one map row per key and the grid is exploded from literals, so the grid is never cross-joined to data.
    """
    names, keys = list(axes), keys or []
    key = F.concat_ws("|", *[F.col(n).cast("string") for n in names])
    folded = observed.groupBy(*keys, *names).agg(F.sum(count).alias("_n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col("_n").alias("n")))).alias("_m"), F.sum("_n").alias("_total"))
    out = folded
    for n in names:
        out = out.withColumn(n, F.explode(F.array(*[F.lit(float(x)) for x in axes[n]])))
    n = F.coalesce(F.col("_m")[key], F.lit(0)).cast("bigint")
    return out.select(*keys, *names, n.alias(count), (n / F.col("_total") * 100.0).alias("percentage"), (n / F.col("_total")).alias("selection_frequency"))


def compare_with_tolerance(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tol: float = 1e-10) -> DataFrame:
    """Cells where two tables disagree: |a - b| > tol + tol * |b|, or a key missing on one side."""
    left = a.select(*key, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(*key, *[F.col(c).alias(f"b_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in columns]
    cells = left.join(right, key, "full_outer").select(*key, F.inline(F.array(*rows)))
    off = F.abs(F.col("a") - F.col("b")) > F.lit(tol) + F.lit(tol) * F.abs("b")
    return cells.filter(F.coalesce(off, F.col("a").isNull() != F.col("b").isNull()))


def pairs_of(df: DataFrame, keys: list[str], item: str, items: list[str], value: str) -> DataFrame:
    """Values of every unordered pair of a fixed item list, per group.

    The items become columns in one aggregation and the pairs are spelled out as literals: no self-join.
    """
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col(item) == m, F.col(value))).alias(f"_v{i}") for i, m in enumerate(items)])
    pairs = [
        F.struct(F.lit(items[i]).alias("item_a"), F.lit(items[j]).alias("item_b"), F.col(f"_v{i}").alias("value_a"), F.col(f"_v{j}").alias("value_b"))
        for i in range(len(items)) for j in range(i + 1, len(items))
    ]
    return wide.select(*keys, F.inline(F.array(*pairs)))


def union_tables(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Tables stacked by column name, each tagged with its key."""
    return reduce(lambda a, b: a.unionByName(b), [t.withColumn(key, F.lit(name)) for name, t in tables.items()])


def widen(df: DataFrame, rows: list[str], column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(*rows).pivot(column, values).agg(F.first(value))


def lengthen(df: DataFrame, ids: list[str], columns: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def match_counts(predicted: DataFrame, assigned: DataFrame, key: list[str]) -> DataFrame:
    """Predictions against the frozen assignment: matched, missing and unexpected keys; a key with a null matches nothing.

    Both tables meet in one aggregation, which needs no shuffle when they are dealt by a key column already.
    """
    p = predicted.select(*key, F.lit(True).alias("_p"), F.lit(False).alias("_a"))
    a = assigned.select(*key, F.lit(False).alias("_p"), F.lit(True).alias("_a"))
    seen = p.unionByName(a).groupBy(*key).agg(F.max("_p").alias("_p"), F.max("_a").alias("_a"))
    both = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in key], F.col("_p") & F.col("_a"))
    return seen.agg(
        count_if(both).alias("matched"), count_if(F.col("_a") & ~both).alias("missing"), count_if(F.col("_p") & ~both).alias("unexpected"),
    )


def null_safe_differences(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys and columns where two tables that must agree differ (nulls equal)."""
    left = a.select(key, *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    rows: list[Column] = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"a_{c}").cast("string").alias("a"), F.col(f"b_{c}").cast("string").alias("b")) for c in columns
    ]
    cells = left.join(right, key).select(key, F.inline(F.array(*rows)))
    return cells.filter(~F.col("a").eqNullSafe(F.col("b")))
