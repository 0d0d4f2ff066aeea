"""Reusable data-quality checks; each returns a small table of findings (empty or zero when all is well)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if, hash_integer


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """Blank and repeated key values with their row counts."""
    text = F.trim(F.col(key).cast("string"))
    counts = df.groupBy(F.coalesce(text, F.lit("")).alias("key_value")).agg(F.count(F.lit(1)).alias("rows"))
    problem = F.when(F.col("key_value") == "", "blank").when(F.col("rows") > 1, "repeated")
    return counts.withColumn("problem", problem).filter("problem is not null")


def disallowed_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    bad = df.filter(F.col(column).isNull() | ~F.col(column).cast("string").isin(allowed))
    return bad.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def missing_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: nulls, values that are not null, NaN and infinite values, from one pass."""
    types = dict(df.dtypes)
    names = columns or df.columns

    def numbers(c: str, test: Column) -> Column:
        return count_if(test) if types[c] in ("double", "float") else F.lit(0).cast("bigint")

    aggs = []
    for c in names:
        x = F.col(f"`{c}`")
        aggs += [count_if(x.isNull()).alias(f"n_{c}"), F.count(x).alias(f"c_{c}"), numbers(c, F.isnan(x)).alias(f"a_{c}"), numbers(c, F.abs(x) == F.lit(float("inf"))).alias(f"i_{c}")]
    kinds = {"nulls": "n", "non_null": "c", "nan": "a", "infinite": "i"}
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{k}_{c}`").alias(name) for name, k in kinds.items()]) for c in names]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def range_profile(df: DataFrame, bounds: dict[str, tuple[float, float]], tol: float = 1e-10) -> DataFrame:
    aggs = [f(c).alias(f"{p}_{c}") for c in bounds for p, f in (("lo", F.min), ("hi", F.max))]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"lo_{c}").cast("double").alias("min_value"), F.col(f"hi_{c}").cast("double").alias("max_value"),
            ((F.col(f"lo_{c}") >= lo - tol) & (F.col(f"hi_{c}") <= hi + tol)).alias("in_range"),
        )
        for c, (lo, hi) in bounds.items()
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def expected_values(observed: DataFrame, expected: dict[str, float], tol: float = 1e-10) -> DataFrame:
    """One-row table against expected values, column by column."""
    rows = [
        F.struct(F.lit(c).alias("quantity"), F.col(c).cast("double").alias("observed"), F.lit(float(e)).alias("expected"),
                 (F.abs(F.col(c).cast("double") - F.lit(float(e))) <= tol).alias("matches"))
        for c, e in expected.items()
    ]
    return observed.select(F.inline(F.array(*rows)))


def partition_key_mismatches(df: DataFrame, key: str, partition_key: str) -> DataFrame:
    return df.filter(~F.col(key).eqNullSafe(F.col(partition_key)))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent content fingerprint: row count and sums of md5 parts of every row (map-side combined)."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(hash_integer(text, 1, 8)).alias("sum_a"), F.sum(hash_integer(text, 9, 8)).alias("sum_b"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def invariant_violations(df: DataFrame, key: list[str], fixed: list[str]) -> DataFrame:
    """Keys that carry more than one value of a column that must not change."""
    aggs = [F.count_distinct(c).alias(c) for c in fixed]
    counts = df.groupBy(*key).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in fixed]
    return counts.select(*key, F.inline(F.array(*rows))).filter("distinct_values > 1")
