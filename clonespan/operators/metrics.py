"""Binary classification metrics, curves and threshold rules, keyed by any grouping.

Scores fold to one row per distinct value and group (`score_blocks`); every metric reads those blocks, so a group of any
size costs one map-side aggregation plus sliced running totals over its distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if, safe_ratio
from .ranking import attach_totals, score_blocks


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, sensitivity, specificity (null without negatives), precision and F1 (0 on zero division)."""
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {
        "accuracy": safe_ratio(tp + tn, tp + fp + fn + tn),
        "sensitivity_recall": recall,
        "specificity": F.when((tn + fp) > 0, tn / (tn + fp)),
        "precision": precision,
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion(df: DataFrame, keys: list[str], label: str = "y", predicted: str | Column = "predicted_label") -> DataFrame:
    y = F.col(label) == 1
    hat = (F.col(predicted) if isinstance(predicted, str) else predicted) == 1
    counts = df.groupBy(*keys).agg(
        count_if(~y & ~hat).alias("TN"), count_if(~y & hat).alias("FP"), count_if(y & ~hat).alias("FN"), count_if(y & hat).alias("TP")
    )
    r = rates(F.col("TP"), F.col("FP"), F.col("FN"), F.col("TN"))
    return counts.select("*", *[c.alias(n) for n, c in r.items()])


def at_threshold(score: str, threshold: str | float) -> Column:
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return (F.col(score) >= t).cast("int")


def ranking_metrics(df: DataFrame, keys: list[str], score: str = "p", label: str = "y") -> DataFrame:
    """ROC AUC (ties count half) and average precision (ties grouped), exact."""
    return ranking_from_blocks(score_blocks(df, keys, score, label), keys)


def ranking_from_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    pos, neg = F.col("pos"), F.col("neg")
    sums = blocks.groupBy(*keys).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        F.sum(pos * (F.col("neg_before") + neg / 2)).alias("_above"),
        F.sum(F.when(pos > 0, pos * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))).alias("_ap"),
    )
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.lit(1.0) - F.col("_above") / (F.col("_p") * F.col("_n")))
    return sums.select(*keys, auc.alias("roc_auc"), F.when(F.col("_p") > 0, F.col("_ap") / F.col("_p")).alias("pr_auc"))


def brier(df: DataFrame, keys: list[str], score: str = "p", label: str = "y") -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.groupBy(*keys).agg(F.avg(d * d).alias("brier_score"))


def full_metrics(df: DataFrame, keys: list[str], score: str = "p", label: str = "y", predicted: str | Column = "predicted_label") -> DataFrame:
    """All metrics of a group in one table."""
    parts = [confusion(df, keys, label, predicted), ranking_metrics(df, keys, score, label), brier(df, keys, score, label)]
    if keys:
        return parts[0].join(parts[1], keys).join(parts[2], keys)
    return attach_totals(attach_totals(parts[0], parts[1], []), parts[2], [])


# -- curves and threshold rules ----------------------------------------------------------------------------------------

def threshold_table(df: DataFrame, keys: list[str], score: str = "p", label: str = "y", extra: list[float] | None = None) -> DataFrame:
    """Counts and rates when everything at or above each distinct score is called positive."""
    return _threshold_rows(df, keys, score, label, extra).drop("observed")


def _threshold_rows(df: DataFrame, keys: list[str], score: str, label: str, extra: list[float] | None) -> DataFrame:
    """The threshold table, and whether the threshold is a score of the data (`observed`)."""
    blocks = score_blocks(df, keys, score, label, extra)
    totals = blocks.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    t = attach_totals(blocks, totals, keys)
    counted = t.select(
        *keys, "threshold", ((F.col("pos") + F.col("neg")) > 0).alias("observed"), F.col("tp").alias("TP"), F.col("fp").alias("FP"), (F.col("_p") - F.col("tp")).alias("FN"), (F.col("_n") - F.col("fp")).alias("TN")
    )
    r = rates(F.col("TP"), F.col("FP"), F.col("FN"), F.col("TN"))
    fpr = F.when((F.col("FP") + F.col("TN")) > 0, F.col("FP") / (F.col("FP") + F.col("TN")))
    return counted.select("*", *[c.alias(n) for n, c in r.items()], fpr.alias("fpr"))


def roc_curve(df: DataFrame, keys: list[str], score: str = "p", label: str = "y") -> DataFrame:
    return threshold_table(df, keys, score, label).select(*keys, "threshold", "fpr", F.col("sensitivity_recall").alias("tpr"))


def pr_curve(df: DataFrame, keys: list[str], score: str = "p", label: str = "y") -> DataFrame:
    return threshold_table(df, keys, score, label).select(*keys, "threshold", "precision", F.col("sensitivity_recall").alias("recall"))


def _closeness() -> Column:
    return F.abs(F.col("threshold") - 0.5)


def _youden_order() -> tuple[Column, Column]:
    """Largest tpr - fpr; ties go to the threshold closest to 0.5, then the larger."""
    j = F.col("sensitivity_recall") - F.col("fpr")
    return j.isNotNull(), F.struct(-j, _closeness(), -F.col("threshold"))


def _f1_order() -> Column:
    return F.struct(-F.col("f1"), -F.coalesce("specificity", F.lit(-1.0)), _closeness(), F.col("threshold"))


def _target_order(target: float) -> tuple[Column, Column]:
    order = F.struct(-F.coalesce("specificity", F.lit(-1.0)), -F.col("precision"), _closeness(), F.col("threshold"))
    return F.col("sensitivity_recall") + F.lit(1e-12) >= target, order


def _best(value: str | Column, ok: Column, order: Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(F.when(ok, value), F.when(ok, order))


def youden(table: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold of the largest tpr - fpr; ties go to the one closest to 0.5, then the larger; 0.5 when undefined."""
    return table.groupBy(*keys).agg(F.coalesce(_best("threshold", *_youden_order()), F.lit(0.5)).alias("threshold"))


def max_f1(table: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold of the largest F1; ties: higher specificity, then closeness to 0.5, then the smaller."""
    return table.groupBy(*keys).agg(F.min_by("threshold", _f1_order()).alias("threshold"))


def sensitivity_target(table: DataFrame, keys: list[str], target: float = 0.80) -> DataFrame:
    """Among thresholds reaching the target sensitivity: highest specificity, precision, closeness to 0.5; 0 when none does."""
    return table.groupBy(*keys).agg(F.coalesce(_best("threshold", *_target_order(target)), F.lit(0.0)).alias("threshold"))


CANDIDATE_CUTS = [0.0, 0.5, 1.0]


def threshold_rules(df: DataFrame, keys: list[str], score: str = "p", label: str = "y", target: float = 0.80) -> DataFrame:
    """The three rules side by side with the metrics at each chosen threshold.

    One aggregate over one threshold table: each rule takes a whole row of it.  Youden's rule looks at scores of the data only.
    """
    table = _threshold_rows(df, keys, score, label, CANDIDATE_CUTS)
    row = F.struct(*[c for c in table.columns if c not in (*keys, "observed")])
    fixed = lambda cut: F.max(F.when(F.col("threshold") == cut, row))
    defined, order = _youden_order()
    rules = table.groupBy(*keys).agg(
        F.coalesce(_best(row, defined & F.col("observed"), order), fixed(0.5)).alias("youden"),
        F.min_by(row, _f1_order()).alias("max_f1"),
        F.coalesce(_best(row, *_target_order(target)), fixed(0.0)).alias("sensitivity_target"),
    )
    names = ("youden", "max_f1", "sensitivity_target")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("row")) for n in names]))
    chosen = rules.select(*keys, each.alias("_chosen")).filter("_chosen.row is not null")
    return chosen.select(*keys, "_chosen.row.threshold", "_chosen.rule", *[f"_chosen.row.{c}" for c in table.columns if c not in (*keys, "threshold", "observed")])


def score_class_report(metrics: DataFrame) -> DataFrame:
    """Confusion matrix of a one-row metric table in long form."""
    cells = [("0", "0", "TN"), ("0", "1", "FP"), ("1", "0", "FN"), ("1", "1", "TP")]
    rows = [F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"), F.col(c).alias("n")) for t, p, c in cells]
    return metrics.select(F.inline(F.array(*rows)))
