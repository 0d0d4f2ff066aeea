"""Quality rules as a bitmask ledger; DataFrame functions only.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per failed rule; policies (sets of
rules with a version) and ablations work on the bits and never read texts again.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of, without, words_of

#: Rule -> failure condition over the measurements.  The order fixes the bits.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 3 and 10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "capitals": "10 * n_capitals > 4 * word_chars",
    "no_text": "n_words = 0",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "short_words", "long_words", "no_text"),
    "v2": tuple(RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`value` as a column that is computed once: a generator of one row stands between it and its uses."""
    return df.withColumn(name, F.explode(F.array(value)))


def _covered(positions: Column, width: int) -> Column:
    """How many places the stretches of `width` that begin at the sorted `positions` cover together."""
    def step(x, i):
        after = F.coalesce(F.get(positions, i + 1), x + width)
        return F.least(after - x, F.lit(width))

    return F.aggregate(F.transform(positions, step), F.lit(0), lambda a, x: a + x)

#: Columns that `measure` makes on the way.
HELPERS = ("_words", "_windows", "_again", "_text", "_lines")


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with the MEASURES of its text.

    Words stand between ASCII white space.  n_repeat_words counts the words inside 3-word windows that occur at least twice in
    the text, the first occurrence included: the windows' hashes are sorted with their places, and equal neighbours give the
    places that count.  Work per document is that of one sort.  Columns of `docs` with the name of a measure, or of one of the
    HELPERS, give way; all others stay.
    """
    rows = without(docs, *MEASURES, *HELPERS)
    rows = _once(rows, "_words", words_of(text_of()))
    places = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>"))
    window = F.transform(places, lambda i: F.struct(F.xxhash64(*[F.get("_words", i + k) for k in range(3)]).alias("h"), i.alias("i")))
    rows = _once(rows, "_windows", F.sort_array(window))

    def repeats(x, i):
        return (F.get("_windows", i - 1)["h"] == x["h"]) | (F.get("_windows", i + 1)["h"] == x["h"])

    rows = _once(rows, "_again", F.sort_array(F.transform(F.filter("_windows", repeats), lambda x: x["i"])))
    lines = F.split(text_of(), "\n")
    rows = _once(rows, "_lines", F.filter(lines, lambda s: F.length(F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    joined = F.array_join("_words", "")
    return rows.select(
        *[F.col(f"`{c}`") for c in rows.columns if c not in HELPERS],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(joined).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text_of(), r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("_again"), 3).cast("bigint").alias("n_repeat_words"),
        F.length(F.regexp_replace(text_of(), r"[^A-Z]+", "")).cast("bigint").alias("n_capitals"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """`docs` with its measurements and `failed`: bit i is set if rule i fails.

    Null or empty texts measure 0 throughout and fail few_words and no_text.  Repeated rows and null ids are judged row by row.
    Empty table: no rows.  Columns of `docs` named like a result column are replaced.
    """
    measured = measure(without(docs, "failed"))
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)) for name, condition in RULES.items()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("bigint"))


def policy_mask(rules: tuple[str, ...]) -> int:
    return sum(BIT[r] for r in rules)


def apply_policy(entries: DataFrame, version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """The ledger with `kept` under a policy: none of its rules failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy_mask(policies[version]))) == 0)


def ablations(entries: DataFrame, version: str, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that are kept without it.

    One aggregation over the masks (at most 2^rules different ones, summed before the shuffle) serves all rules.
    """
    rules, whole = policies[version], policy_mask(policies[version])
    masks = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("mask")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in rules])).alias("r")
    per = masks.select("mask", "n", each).select("mask", "n", "r.*")
    left = F.col("mask").bitwiseAND(F.bitwise_not("bit"))
    has = F.col("mask").bitwiseAND(F.col("bit")) != 0
    return per.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(has & (left == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(left == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
