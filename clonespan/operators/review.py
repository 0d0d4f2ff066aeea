"""Collected cross-validation results: coefficient stability, parameter review, audits and integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import THRESHOLD_EDGES, count_if, fixed_precision_text, join_reasons, series_step, threshold_bin
from .joins import compare_with_tolerance

INTERCEPT = "__INTERCEPT__"


def feature_source(name: str, prefixes: dict[str, str]) -> Column:
    """Clinical, receptor (by prefix), material or other."""
    n = F.col(name)
    out = F.when((n == "age") | n.startswith("sex__"), F.lit("clinical"))
    for prefix, label in prefixes.items():
        out = out.when(n.startswith(prefix), F.lit(label))
    return out.when((n == "material") | n.startswith("material__"), F.lit("material")).otherwise(F.lit("other"))


def coefficient_stability(
    coefs: DataFrame, expected_tasks: int, prefixes: dict[str, str], tolerance: float = 1e-12, min_frequency: float = 0.50, min_sign: float = 0.80,
    labels: tuple[str, str] = ("negative", "positive"), task: str = "task",
) -> DataFrame:
    """Per (model, feature): how often it is selected over the tasks, in which direction, and how large.

    A (model, feature) group has one row per task, so the exact percentiles stay small.
    """
    c = F.col("coefficient")
    chosen = F.abs(c) > tolerance
    value, size = F.when(chosen, c), F.when(chosen, F.abs(c))
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = coefs.filter(F.col("feature_name") != INTERCEPT).groupBy("model", "feature_name").agg(
        F.count_distinct(task).alias("observed_tasks"), count_if(chosen).alias("selected_count"), count_if(chosen & (c > 0)).alias("positive_count"),
        count_if(chosen & (c < 0)).alias("negative_count"), (F.sum(c) / expected_tasks).alias("coefficient_mean_all_tasks_zero_filled"),
        F.coalesce(q[1], F.lit(0.0)).alias("coefficient_median_selected"), F.coalesce(q[0], F.lit(0.0)).alias("coefficient_q1_selected"),
        F.coalesce(q[2], F.lit(0.0)).alias("coefficient_q3_selected"), F.coalesce(F.percentile(size, 0.5), F.lit(0.0)).alias("absolute_coefficient_median_selected"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("absolute_coefficient_mean_selected"),
    )
    n, pos, neg = F.col("selected_count"), F.col("positive_count"), F.col("negative_count")
    sign = F.when(n > 0, F.greatest(pos, neg) / n)
    frequency = n / F.lit(expected_tasks)
    return s.select(
        "*", feature_source("feature_name", prefixes).alias("feature_source"), (F.col("observed_tasks") / F.lit(expected_tasks)).alias("availability_frequency"),
        frequency.alias("selection_frequency"), (n / F.col("observed_tasks")).alias("selection_frequency_among_observed"), sign.alias("sign_consistency_among_selected"),
        F.when(pos > neg, labels[1]).when(neg > pos, labels[0]).otherwise("tie_or_not_selected").alias("predominant_direction"),
        ((pos - neg) / F.lit(expected_tasks)).alias("signed_selection_frequency"),
        ((frequency >= min_frequency) & (n > 0) & F.coalesce(sign >= min_sign, F.lit(False))).alias("is_stable"),
    )


def stable_features(stability: DataFrame) -> DataFrame:
    return stability.filter("is_stable")


def stable_counts(stability: DataFrame, models: list[str]) -> DataFrame:
    """Stable and evaluated features per model, zero models kept."""
    counts = stability.groupBy("model").agg(count_if(F.col("is_stable")).alias("stable"), F.count(F.lit(1)).alias("evaluated"))
    folded = counts.agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("stable", "evaluated")))).alias("_m"))
    rows = folded.select("_m", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    hit = F.col("_m")[F.col("model")]
    return rows.select("model", F.coalesce(hit["stable"], F.lit(0)).alias("stable"), F.coalesce(hit["evaluated"], F.lit(0)).alias("evaluated"))


# -- selected parameters -----------------------------------------------------------------------------------------------

def selection_frequency(params: DataFrame) -> DataFrame:
    """Per (model, alpha, lambda): count, share of the model's tasks, means of threshold and inner metrics."""
    totals = params.groupBy("model").agg(F.count(F.lit(1)).alias("_t"))
    combos = params.groupBy("model", "l1_ratio_alpha", "lambda").agg(
        F.count(F.lit(1)).alias("count"), F.avg("threshold").alias("threshold_mean"), F.percentile("threshold", 0.5).alias("threshold_median"),
        F.avg("inner_roc_auc").alias("inner_roc_auc_mean"), F.stddev_samp("inner_roc_auc").alias("inner_roc_auc_sd"), F.avg("inner_pr_auc").alias("inner_pr_auc_mean"),
    )
    j = combos.join(totals, "model")
    return j.withColumns({"selection_frequency": F.col("count") / F.col("_t"), "percentage": 100.0 * F.col("count") / F.col("_t")}).drop("_t")


def value_frequency(params: DataFrame, column: str, grid: list[float]) -> DataFrame:
    """Per model: every grid value with its count and share, zeros kept, boundaries marked."""
    wide = params.groupBy("model").agg(F.count(F.lit(1)).alias("_t"), *[count_if(F.col(column) == g).alias(f"_c{i}") for i, g in enumerate(grid)])
    rows = [F.struct(F.lit(float(g)).alias(column), F.col(f"_c{i}").alias("count")) for i, g in enumerate(grid)]
    return wide.select("model", "_t", F.inline(F.array(*rows))).select(
        "model", column, "count", (100.0 * F.col("count") / F.col("_t")).alias("percentage"), (F.col("count") / F.col("_t")).alias("selection_frequency"),
        (F.col(column) == min(grid)).alias("is_lower_grid_boundary"), (F.col(column) == max(grid)).alias("is_upper_grid_boundary"),
    )


def threshold_distribution(params: DataFrame, keys: list[str]) -> DataFrame:
    t = "threshold"
    q = F.percentile(t, F.array(*[F.lit(x) for x in (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)]))
    names = ["q05", "q10", "q25", "median", "q75", "q90", "q95"]
    out = params.groupBy(*keys).agg(F.count(t).alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("sd"), F.min(t).alias("min"), q.alias("_q"), F.max(t).alias("max"))
    return out.select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], (F.col("_q")[4] - F.col("_q")[2]).alias("IQR")).drop("_q")


def threshold_bins(params: DataFrame, edges: list[float] = THRESHOLD_EDGES) -> DataFrame:
    """Per model: counts in the fixed bins, empty bins kept."""
    labels = [f"[{lo}, {hi})" for lo, hi in zip(edges[:-1], edges[1:])]
    binned = params.withColumn("_b", threshold_bin("threshold", edges))
    wide = binned.groupBy("model").agg(F.count(F.lit(1)).alias("_t"), *[count_if(F.col("_b") == b).alias(f"_c{i}") for i, b in enumerate(labels)])
    rows = [F.struct(F.lit(b).alias("threshold_interval"), F.col(f"_c{i}").alias("count")) for i, b in enumerate(labels)]
    return wide.select("model", "_t", F.inline(F.array(*rows))).select(
        "model", "threshold_interval", "count", (100.0 * F.col("count") / F.col("_t")).alias("percentage"))


def shortest_interval(frequency: DataFrame, column: str, coverage: float) -> DataFrame:
    """Per model: narrowest run of grid values whose mass reaches the coverage; ties by value span, then the left end.

    A model has one row per grid value, so the run search is an expression over one short array.
    """
    cells = F.array_sort(F.collect_list(F.struct(F.col(column).alias("v"), F.col("selection_frequency").alias("m"))))
    a = frequency.groupBy("model").agg(cells.alias("a"))
    n = F.size("a")

    def mass(left: Column, right: Column) -> Column:
        return F.aggregate(F.slice("a", left, right - left + 1), F.lit(0.0), lambda s, x: s + x["m"])

    def runs(left: Column) -> Column:
        rights = F.filter(F.sequence(left, n), lambda r: mass(left, r) + F.lit(1e-12) >= coverage)
        right = F.array_min(rights)
        span = F.element_at("a", right)["v"] - F.element_at("a", left)["v"]
        return F.when(right.isNotNull(), F.struct((right - left).alias("width"), span.alias("span"), left.alias("l"), right.alias("r")))

    best = F.array_min(F.array_compact(F.transform(F.sequence(F.lit(1), n), runs)))
    picked = a.withColumn("best", best)
    left, right = F.coalesce(F.col("best.l"), F.lit(1)), F.coalesce(F.col("best.r"), n)
    return picked.select(
        "model", F.element_at("a", left)["v"].alias("interval_min"), F.element_at("a", right)["v"].alias("interval_max"), mass(left, right).alias("interval_coverage"))


def grid_recommendation(
    alpha_frequency: DataFrame, lambda_frequency: DataFrame, alpha_grid: list[float], lambda_grid: list[float], coverage: float = 0.80, boundary: float = 0.20
) -> DataFrame:
    """Per model: central intervals, boundary warnings, pattern labels and the suggested grids."""
    share, n = F.col("selection_frequency"), F.col("count")

    def at(flag: str) -> Column:
        return F.max(F.when(F.col(flag), share))

    a = F.col("l1_ratio_alpha")
    alpha = alpha_frequency.groupBy("model").agg(
        at("is_lower_grid_boundary").alias("alpha_lower"), at("is_upper_grid_boundary").alias("alpha_upper"), (F.sum(a * n) / F.sum(n)).alias("alpha_weighted_mean"),
        F.sum(F.when(a >= 0.8, share).otherwise(0.0)).alias("alpha_ge_0_8_selection_frequency"))
    lam = F.col("lambda")
    lambda_ = lambda_frequency.groupBy("model").agg(
        at("is_lower_grid_boundary").alias("lambda_lower"), at("is_upper_grid_boundary").alias("lambda_upper"),
        F.pow(F.lit(10.0), F.sum(F.log10(lam) * n) / F.sum(n)).alias("lambda_weighted_mean"), F.sum(F.when(lam >= 3.0, share).otherwise(0.0)).alias("lambda_ge_3_selection_frequency"),
        F.sum(F.when(lam >= 10.0, share).otherwise(0.0)).alias("lambda_ge_10_selection_frequency"))
    spans = [(alpha_frequency, "l1_ratio_alpha", "alpha"), (lambda_frequency, "lambda", "lambda")]
    joined = alpha.join(lambda_, "model")
    for table, column, name in spans:
        i = shortest_interval(table, column, coverage)
        joined = joined.join(i.withColumnsRenamed({f"interval_{x}": f"{name}_interval_{x}" for x in ("min", "max", "coverage")}), "model")

    def grid(values: list[float], lower: Column, upper: Column) -> Column:
        cells = F.array(*[F.lit(float(g)) for g in values])
        full = F.array_sort(F.array_distinct(F.concat(cells, F.array_compact(F.array(lower, upper)))))
        return F.array_join(F.transform(full, lambda x: fixed_precision_text(F.round(x, 12), 6)), ",")

    warn = {c: F.col(c) >= boundary for c in ("alpha_lower", "alpha_upper", "lambda_lower", "lambda_upper")}
    low_a, high_a = F.lit(min(alpha_grid)), max(alpha_grid)
    more_alpha = grid(alpha_grid, F.when(warn["alpha_lower"] & (low_a > 0.01), series_step(low_a, -1, 0.01)), F.when(warn["alpha_upper"] & F.lit(high_a < 1.0), F.lit(1.0)))
    more_lambda = grid(lambda_grid, F.when(warn["lambda_lower"], series_step(F.lit(float(min(lambda_grid))), -1, 1e-6)), F.when(warn["lambda_upper"], series_step(F.lit(float(max(lambda_grid))), 1)))
    return joined.select(
        "*", *[c.alias(f"{n}_boundary_warning") for n, c in warn.items()],
        F.when(F.col("alpha_ge_0_8_selection_frequency") >= 0.5, "strongly_sparse_leaning").when(F.col("alpha_weighted_mean") >= 0.6, "moderately_sparse_leaning").otherwise("mixed_penalty").alias("alpha_pattern"),
        F.when(F.col("lambda_ge_10_selection_frequency") >= 0.5, "very_strong_regularization").when(F.col("lambda_ge_3_selection_frequency") >= 0.5, "strong_regularization").otherwise("mixed_regularization").alias("lambda_pattern"),
        more_alpha.alias("suggested_alpha_grid"), more_lambda.alias("suggested_lambda_grid"),
    )


# -- audits ------------------------------------------------------------------------------------------------------------

def metric_audit(stored: DataFrame, recomputed: DataFrame, keys: list[str], metrics: list[str], tol: float = 1e-10) -> DataFrame:
    """Stored metrics that differ from recomputed ones."""
    return compare_with_tolerance(stored, recomputed, keys, metrics, tol)


def task_integrity(tasks: DataFrame, tables: dict[str, tuple[DataFrame, int]], keys: list[str]) -> DataFrame:
    """PASS or FAIL per task: every table must hold the expected number of rows of the task.

    `tables` maps a name to (table, expected rows per task); all tables fold to counts in one union.
    """
    tagged = [t.select(*keys).withColumn("_t", F.lit(n)) for n, (t, _) in tables.items()]
    counts = reduce(lambda a, b: a.unionByName(b), tagged).groupBy(*keys).agg(*[count_if(F.col("_t") == n).alias(f"_{n}") for n in tables])
    j = tasks.select(*keys).distinct().join(counts, keys, "left")
    reasons = [F.when(F.coalesce(F.col(f"_{n}"), F.lit(0)) != e, F.concat(F.lit(f"{n}: "), F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("string"), F.lit(f" rows, expected {e}"))) for n, (_, e) in tables.items()]
    text = join_reasons(reasons, "; ")
    return j.select(*keys, F.when(text == "", "PASS").otherwise("FAIL").alias("status"), text.alias("message"))


def collection_checks(preds: DataFrame, models: int, repeats: int) -> DataFrame:
    """Global checks of collected predictions: totals, uniqueness, complete coverage, consistent labels."""
    one = F.lit(1)
    per_key = preds.groupBy("model", "outer_repeat", "sample_id").agg(F.count(one).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    per_sample = per_key.groupBy("sample_id").agg(F.count(one).alias("keys"), F.sum("n").alias("rows"), count_if(F.col("n") > 1).alias("repeated"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wide = per_sample.agg(
        F.sum("rows").alias("total_rows"), F.sum("repeated").alias("repeated_predictions"), count_if(F.col("keys") != models * repeats).alias("incomplete_samples"),
        count_if(F.col("lo") != F.col("hi")).alias("inconsistent_labels"), F.count(one).alias("samples"))
    rows = [F.struct(F.lit(c).alias("check_name"), F.col(c).alias("value")) for c in ("total_rows", "repeated_predictions", "incomplete_samples", "inconsistent_labels", "samples")]
    return wide.select(F.inline(F.array(*rows)))


def frozen_invariants(assignments: DataFrame, sample: str = "sample_id", label: str = "y") -> DataFrame:
    """Samples whose label changes between repeats and folds that miss a label."""
    moved = assignments.groupBy(sample).agg(F.count_distinct(label).alias("n")).agg(F.lit("label_changes").alias("check_name"), count_if(F.col("n") > 1).alias("violations"))
    thin = assignments.groupBy("outer_repeat", "outer_fold").agg(F.count_distinct(label).alias("n")).agg(F.lit("fold_misses_label").alias("check_name"), count_if(F.col("n") < 2).alias("violations"))
    return moved.unionByName(thin)


def configuration_audit(config: DataFrame, expected: dict[str, str], keys: list[str]) -> DataFrame:
    """All configuration fields of a task that differ from their expected value, reported together."""
    reasons = [F.when(~F.col(c).cast("string").eqNullSafe(F.lit(e)), F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c, e in expected.items()]
    text = join_reasons(reasons, "; ")
    return config.select(*keys, text.alias("problems"), (text == "").alias("valid"))
