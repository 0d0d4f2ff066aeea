"""Repeat-level summaries, paired comparisons, rank tests, multiplicity adjustment and resampling intervals.

Groups here are repeats of a study (tens to hundreds of rows per model and metric), so windows over a (metric, pair) group
are small by construction.  Sample-level inputs are reduced to repeat metrics before any of these operators.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if, hash_integer, order_hash
from ..session import materialize, spread
from .joins import pairs_of
from .metrics import confusion, ranking_from_blocks, ranking_metrics, rates
from .ranking import positions, running_totals, unit_level

METRICS = ["roc_auc", "pr_auc", "sensitivity_recall", "specificity", "f1"]


def repeat_metrics(preds: DataFrame, keys: list[str], score: str = "p", label: str = "y", predicted: str | Column = "predicted_label") -> DataFrame:
    """Pooled out-of-fold metrics per repeat and model."""
    return confusion(preds, keys, label, predicted).join(ranking_metrics(preds, keys, score, label), keys)


def long_metrics(metrics: DataFrame, keys: list[str], names: list[str] = METRICS) -> DataFrame:
    return metrics.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]).unpivot(keys, names, "metric", "value")


def distribution(value: str) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.count(value).alias("n_repeats"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q[1].alias("median"), q[0].alias("q1"),
        q[2].alias("q3"), F.min(value).alias("min"), F.max(value).alias("max"),
    ]


def bootstrap_mean(values: DataFrame, keys: list[str], order: str, reps: int, seed: int = 1) -> DataFrame:
    """Percentile interval of the mean over repeats drawn with replacement.

    Draw i of replicate r picks the repeat at position hash(seed, r, i) mod n of its group.
    """
    ranked = values.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")).select("*", F.explode(F.sequence(F.lit(0), (F.col("_n") - 1).cast("int"))).alias("draw"))
    pick = hash_integer(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string"))) % F.col("_n")
    means = draws.withColumn("_pos", pick.cast("int")).join(ranked.select(*keys, "_pos", "value"), [*keys, "_pos"]).groupBy(*keys, "rep").agg(F.avg("value").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(q[0].alias("ci_lower"), q[1].alias("ci_upper"))


def performance_summary(long: DataFrame, keys: list[str], reps: int = 5000, seed: int = 1, order: str = "outer_repeat") -> DataFrame:
    stats = long.groupBy(*keys).agg(*distribution("value"))
    return stats.join(bootstrap_mean(long, keys, order, reps, seed), keys)


def paired_values(long: DataFrame, models: list[str], repeat: str = "outer_repeat") -> DataFrame:
    pairs = pairs_of(long, ["metric", repeat], "model", models, "value")
    named = pairs.withColumnsRenamed({"item_a": "model_a", "item_b": "model_b"}).dropna(subset=["value_a", "value_b"])
    return named.withColumn("difference", F.col("value_b") - F.col("value_a"))


PAIR = ["metric", "model_a", "model_b"]


def paired_summary(paired: DataFrame) -> DataFrame:
    d = F.col("difference")
    q = F.percentile("difference", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    wins, losses = count_if(d > 0), count_if(d < 0)
    out = paired.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n_repeats"), F.avg("value_a").alias("mean_a"), F.avg("value_b").alias("mean_b"), F.avg(d).alias("mean_difference"),
        q[1].alias("median_difference"), q[0].alias("q1_difference"), q[2].alias("q3_difference"),
        wins.alias("wins"), count_if(d == 0).alias("ties"), losses.alias("losses"),
    )
    decided = F.col("wins") + F.col("losses")
    sign = F.when(decided > 0, (F.col("wins") - F.col("losses")) / decided).otherwise(F.lit(0.0))
    return out.withColumn("rank_biserial_signs", sign)


def average_rank(keys: list[str], value: str) -> Column:
    """1-based rank where equal values share the mean of their ranks."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def wilcoxon(paired: DataFrame, digits: int = 12) -> DataFrame:
    """Signed-rank sums per pair: zeros dropped, average ranks of |d|; all-zero pairs give statistic 0.

    Differences are rounded before ranking so that equal differences computed along different paths stay tied.
    """
    d = paired.select(*PAIR, F.round("difference", digits).alias("d"))
    ranked = d.filter("d <> 0").withColumn("a", F.abs("d")).withColumn("r", average_rank(PAIR, "a"))
    sums = ranked.groupBy(*PAIR).agg(
        F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(F.lit(0.0))).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(F.lit(0.0))).alias("w_minus"),
        F.count(F.lit(1)).alias("n_nonzero"),
    )
    tied = ranked.groupBy(*PAIR, "a").agg(F.count(F.lit(1)).alias("t")).groupBy(*PAIR).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie_term"))
    pairs = d.groupBy(*PAIR).agg(count_if(F.col("d") == 0).alias("n_zero"))
    full = pairs.join(sums, PAIR, "left").join(tied, PAIR, "left").fillna(0.0)
    total = F.col("w_plus") + F.col("w_minus")
    return full.select(
        *PAIR, "w_plus", "w_minus", "n_nonzero", "n_zero", "tie_term", F.least("w_plus", "w_minus").alias("statistic"),
        F.when(total > 0, (F.col("w_plus") - F.col("w_minus")) / total).otherwise(F.lit(0.0)).alias("rank_biserial"),
    )


def _signed_rank_p(n: int, statistic: float, tie_term: float, n_zero: int, method: str) -> float:
    """Two-sided p-value of the signed-rank statistic, exact or by the tie-corrected normal approximation."""
    if n == 0:
        return 1.0
    if method == "exact" or method == "auto" and tie_term == 0 and n_zero == 0 and n <= 50:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for rank in range(1, n + 1):
            for s in range(len(ways) - 1, rank - 1, -1):
                ways[s] += ways[s - rank]
        return min(1.0, 2.0 * sum(ways[: int(statistic) + 1]) / 2**n)
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48
    return math.erfc(abs(statistic - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def _chi_square_p(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution by its series for integer degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= half / (i + 0.5)
    return total


def with_wilcoxon_p(tests: DataFrame, method: str = "auto") -> DataFrame:
    """Add p-values; one row per (metric, pair), so the Python batches hold tens of rows.

    `method`: "exact", "approx", or "auto", the usual convention of statistics libraries: exact for up to 50 differences
    without ties and zeros, else approximate.
    """
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method: {method}")

    @F.pandas_udf("double")
    def p_value(n: pd.Series, w: pd.Series, t: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([_signed_rank_p(int(a), float(b), float(c), int(d), method) for a, b, c, d in zip(n, w, t, z)])

    return tests.withColumn("p_value_raw", p_value("n_nonzero", "statistic", "tie_term", "n_zero"))


def friedman(long: DataFrame, models: list[str], repeat: str = "outer_repeat", digits: int = 12) -> DataFrame:
    """Friedman chi-square per metric with tie correction; all-equal rows give 0."""
    block = ["metric", repeat]
    v = long.filter(F.col("model").isin(models)).withColumn("v", F.round("value", digits))
    ranked = v.withColumn("r", average_rank(block, "v"))
    per_model = ranked.groupBy("metric", "model").agg(F.sum("r").alias("rank_sum"), F.count(F.lit(1)).alias("n"))
    sums = per_model.groupBy("metric").agg(F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ss"), F.max("n").alias("n"))
    tied = ranked.groupBy(*block, "v").agg(F.count(F.lit(1)).alias("t")).groupBy("metric").agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("tie_term"))
    k, n = len(models), F.col("n")
    correction = F.lit(1.0) - F.col("tie_term") / (n * (k * k - 1) * k)
    raw = F.lit(12.0 / (k * (k + 1))) * F.col("ss") / n - 3 * n * (k + 1)
    return sums.join(tied, "metric").select("metric", n.alias("n_repeats"), F.when(correction <= 0, F.lit(0.0)).otherwise(raw / correction).alias("statistic"), F.lit(k - 1).alias("df"))


def with_chi_square_p(tests: DataFrame) -> DataFrame:
    @F.pandas_udf("double")
    def p_value(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_chi_square_p(float(a), int(b)) for a, b in zip(x, df)])

    return tests.withColumn("p_value", p_value("statistic", "df"))


def holm(tests: DataFrame, within: list[str], p: str, tie: list[str], name: str = "p_value_holm") -> DataFrame:
    """Step-down adjustment inside each family: running maximum of (m - rank) * p, at most 1."""
    w = Window.partitionBy(*within).orderBy(p, *tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*within))
    stepped = tests.withColumn("_s", (m - F.row_number().over(w) + 1) * F.col(p))
    running = F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(name, F.least(running, F.lit(1.0))).drop("_s")


def stratified_bootstrap(
    scored: DataFrame, reps: int, threshold: float, seed: int = 1, sample: str = "sample_id", score: str = "p", label: str = "y", hash_cols: list[str] | None = None
) -> DataFrame:
    """Metrics of replicates that redraw positives and negatives separately, one row per replicate.

    Row positions inside a label come from sliced running totals; draws join by (label, position) and fold to score blocks
    before anything else, so the work is reps x rows and no label is held by one task.
    """
    hashed = scored.select(sample, score, label, order_hash(F.lit(seed), *(hash_cols or [sample])).alias("_h"))
    placed = materialize(positions(hashed, [label], "_h", sample).select(label, "position", score))
    sizes = placed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    draws = spread(placed.select(label, F.col("position").alias("draw")), "draw", reps).join(sizes, label).select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col(label).cast("string"), F.col("draw").cast("string"))
    picks = draws.select("rep", label, (hash_integer(text) % F.col("_n")).alias("position"))
    drawn = picks.groupBy("rep", label, "position").agg(F.count(F.lit(1)).alias("times")).join(placed.select(label, "position", score), [label, "position"])
    return replicate_metrics(drawn, ["rep"], score, label, "times", threshold)


def replicate_metrics(drawn: DataFrame, keys: list[str], score: str, label: str, times: str, threshold: float) -> DataFrame:
    """The eight metrics of weighted rows."""
    y = F.col(label) == 1
    hat = F.col(score) >= threshold
    w = F.col(times)

    def mass(cond: Column) -> Column:
        return F.sum(F.when(cond, w).otherwise(F.lit(0)))

    d = F.col(score) - F.col(label)
    counts = drawn.groupBy(*keys).agg(
        mass(~y & ~hat).alias("TN"), mass(~y & hat).alias("FP"), mass(y & ~hat).alias("FN"), mass(y & hat).alias("TP"), (F.sum(w * d * d) / F.sum(w)).alias("brier_score")
    )
    blocks = drawn.groupBy(*keys, F.col(score).alias("threshold")).agg(mass(y).alias("pos"), mass(~y).alias("neg"))
    ranked = running_totals(blocks, keys, [F.col("threshold").desc()], ["pos", "neg"], unit_level("threshold"), level_descending=True)
    ranked = ranked.select("*", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("neg_before") + F.col("neg")).alias("fp"))
    r = rates(F.col("TP"), F.col("FP"), F.col("FN"), F.col("TN"))
    named = counts.select(*keys, "brier_score", *[c.alias(n) for n, c in r.items()])
    return named.join(ranking_from_blocks(ranked, keys), keys)


BOOTSTRAP_METRICS = ["roc_auc", "pr_auc", "accuracy", "sensitivity_recall", "specificity", "precision", "f1", "brier_score"]


def bootstrap_intervals(replicates: DataFrame, names: list[str] = BOOTSTRAP_METRICS) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    long = replicates.unpivot(["rep"], names, "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q[0].alias("ci_lower"), q[1].alias("ci_upper"), F.count("value").alias("n_valid"))


def sample_means(preds: DataFrame, keys: list[str], threshold: float, score: str = "p", label: str = "y") -> DataFrame:
    """Out-of-fold probability of a sample across repeats, with the label at a locked threshold."""
    return preds.groupBy(*keys).agg(
        F.max(label).alias("true_label"), F.avg(score).alias("mean_probability"), F.stddev_samp(score).alias("sd_probability"), F.percentile(score, 0.5).alias("median_probability"),
        F.min(score).alias("min_probability"), F.max(score).alias("max_probability"), F.count(F.lit(1)).alias("n_predictions"),
    ).withColumn("predicted_label", (F.col("mean_probability") >= threshold).cast("int"))
