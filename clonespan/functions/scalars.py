"""Scalar column expressions: ratios, rounding, parsing, labels, keys, prefixes, grid steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "__MISSING__"
JOINT_SEPARATOR = " || "
NONNEGATIVE_NUMBER = r"^\s*(\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|-0*\.?0+)\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_if(cond: Column) -> Column:
    """Rows where the condition holds, never null (0 for an empty group)."""
    return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0).cast("bigint"))


def sum_if(cond: Column, value: str | Column) -> Column:
    return F.sum(F.when(cond, col(value)).otherwise(F.lit(0.0)))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, and 0 where the denominator is 0."""
    den = col(b).cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise(col(a).cast("double") / den)


def log_ratio(a: str | Column, b: str | Column, eps: float = 1e-8) -> Column:
    return F.log((col(a) + F.lit(eps)) / (col(b) + F.lit(eps)))


def parse_nonnegative_float(token: str | Column) -> Column:
    """Finite, non-negative number, otherwise null."""
    value = F.nullif(F.trim(col(token)).try_cast("double"), F.lit(float("inf")))
    return F.when(col(token).rlike(NONNEGATIVE_NUMBER), value)


def integral(value: str | Column) -> Column:
    """A whole double as an integer, otherwise null."""
    return F.when(col(value) % 1 == 0, col(value).cast("bigint"))


def parse_nonnegative_int(token: str | Column) -> Column:
    """Integral non-negative number ('3.0' counts), otherwise null."""
    return integral(parse_nonnegative_float(token))


def encode_label(c: str | Column, positive: str) -> Column:
    return F.when(F.upper(F.trim(col(c))) == F.lit(positive.upper()), 1).otherwise(0)


def category_text(c: str | Column) -> Column:
    text = F.trim(col(c).cast("string"))
    return F.when(text.isNull() | (text == ""), F.lit(MISSING)).otherwise(text)


def joint_key(columns: list[str]) -> Column:
    return F.concat_ws(JOINT_SEPARATOR, *[category_text(c) for c in columns])


def parse_bool(c: str | Column) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes")


def count_threshold(n: str | Column, prevalence: float | Column, minimum: int | Column) -> Column:
    """Larger of a minimum count and the prevalence share of n, rounded up (same double product everywhere)."""
    share = prevalence if isinstance(prevalence, Column) else F.lit(float(prevalence))
    floor_ = minimum if isinstance(minimum, Column) else F.lit(minimum)
    return F.greatest(floor_.cast("bigint"), F.ceil(share * col(n)).cast("bigint"))


def round_half_up(x: str | Column) -> Column:
    return F.floor(col(x) + F.lit(0.5)).cast("bigint")


def stratum_train_size(n: str | Column, ratio: float) -> Column:
    """Training rows of a stratum of n rows: half-up share kept within 1..n-1; a single row trains."""
    c = col(n)
    return F.when(c == 1, F.lit(1).cast("bigint")).otherwise(
        F.least(F.greatest(round_half_up(c * F.lit(float(ratio))), F.lit(1)), c - 1)
    )


def order_hash(*parts: str | Column) -> Column:
    """Text key for a reproducible pseudo-random order; every engine with md5 gives the same one."""
    return F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))


def hash_integer(text: Column, start: int = 1, digits: int = 12) -> Column:
    """Part of an md5 text read as a base-16 integer (12 digits stay below 2^48)."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def derived_seed(base: int | str | Column, *parts: str | Column) -> Column:
    """Stable integer seed of a base seed and task indices."""
    first = base if isinstance(base, Column) else (F.col(base) if isinstance(base, str) else F.lit(base))
    text = F.concat_ws("|", first.cast("string"), *[col(p).cast("string") for p in parts])
    return hash_integer(text, 1, 8)


def prefix_columns(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select([F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({c: c[len(prefix):] for c in df.columns if c.startswith(prefix)})


def fixed_precision_text(c: str | Column, digits: int = 12) -> Column:
    """Text of a double with the given significant digits and no trailing zeros, for CSV export."""
    text = F.format_string(f"%.{digits}g", col(c).cast("double"))
    mantissa, exponent = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1)
    short = F.when(mantissa.contains("."), F.regexp_replace(mantissa, r"\.?0+$", "")).otherwise(mantissa)
    return F.when(text.contains("e"), F.concat(short, F.lit("e"), exponent)).otherwise(short)


THRESHOLD_EDGES = [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 1.000001]


def threshold_bin(c: str | Column, edges: list[float] = THRESHOLD_EDGES) -> Column:
    """Left-closed bin label of a threshold; null outside the edges."""
    x = col(c)
    pairs = list(zip(edges[:-1], edges[1:]))
    return F.coalesce(*[F.when((x >= lo) & (x < hi), F.lit(f"[{lo}, {hi})")) for lo, hi in pairs])


def snap_to_grid(c: str | Column, grid: list[float], atol: float = 1e-10) -> Column:
    """Grid value within the tolerance, null when none matches."""
    x = col(c)
    return F.coalesce(*[F.when(F.abs(x - F.lit(g)) <= max(atol, 1e-9 * abs(g)), F.lit(float(g))) for g in grid])


# Leading digits from which a value counts as the 3, or as the next 1, of the series 1, 3, 10, 30, ...
SERIES_CUTS = {1: (1.5, 5.0), -1: (2.0, 7.0)}


def series_step(c: str | Column, step: int, limit: float | None = None) -> Column:
    """The value one place up (step 1) or down (step -1) the 1-3-10 series, not beyond the limit.

    The series is numbered: place 2k is 10^k, place 2k + 1 is 3 * 10^k.  A value takes the place that its leading digits give
    it and moves by one.
    """
    x = col(c)
    decade = F.floor(F.log10(x))
    lead = x / F.pow(F.lit(10.0), decade)
    place = 2 * decade + sum((lead >= F.lit(cut)).cast("int") for cut in SERIES_CUTS[step]) + step
    value = F.pow(F.lit(10.0), F.floor(place / 2)) * F.when(F.pmod(place, F.lit(2)) == 0, 1.0).otherwise(3.0)
    if limit is None:
        return value
    return F.least(value, F.lit(float(limit))) if step > 0 else F.greatest(value, F.lit(float(limit)))


def join_reasons(reasons: list[Column], separator: str = ";") -> Column:
    """Text of the non-null reasons in the given order."""
    return F.array_join(F.array_compact(F.array(*reasons)), separator)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
