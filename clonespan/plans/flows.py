"""Compositions of the operators: one function per stage of a study.

Each flow returns the tables of its stage.  Tables that several branches read and that are small (splits, schedules,
summaries) are materialised with a reliable checkpoint; large tables are meant to be written with `sources.writers` and
read back by the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones as C
from ..operators import comparison as K
from ..operators import features as X
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import modeling as O
from ..operators import public as P
from ..operators import review as R
from ..operators import splits as L
from ..operators import stability as B
from ..session import materialize
from ..sources import readers


def clone_tables(lines: DataFrame, keys: list[str] = ["sample_id"], policy: str = "skip", source: str = "auto") -> dict[str, DataFrame]:
    """Raw lines -> clone table, sample summary, rejection reports, excluded samples."""
    parsed = C.parse_tokens(readers.clone_tokens(lines))
    summary = C.sample_summary(parsed, keys, source)
    return {
        "clones": C.aa_clone_table(C.apply_invalid_policy(parsed, policy), keys, source), "summary": summary, "invalid": C.invalid_summary(parsed),
        "invalid_by_sample": C.invalid_by_sample(parsed, keys), "excluded": C.excluded_samples(summary, keys),
    }


def clone_tables_from_files(spark: SparkSession, path: str, suffix: str, has_header: bool = False) -> dict[str, DataFrame]:
    return clone_tables(readers.read_clone_lines(spark, path, suffix, has_header))


def sample_features(
    clones: DataFrame, summary: DataFrame, vocabulary: DataFrame | None = None, max_kmers: int = 0, key: str = "sample_id", **limits
) -> dict[str, DataFrame]:
    """Core features, vocabulary and merged matrix.  Test mode passes the training vocabulary, which is then frozen."""
    core = X.core_table(clones, summary, [key])
    vocab = vocabulary
    if vocab is None:
        n = clones.select(key).distinct().agg(F.count(F.lit(1)).alias("n_samples"))
        every = materialize(X.kmer_features(clones, [key]))
        vocab = materialize(X.kmer_vocabulary(every, n, max_kmers=max_kmers, **limits))
        kmers = X.in_vocabulary(every, vocab)
    else:
        kmers = X.kmer_features(clones, [key], vocab)
    names = X.retained_kmers(vocab)
    return {"core": core, "vocabulary": vocab, "kmers": kmers, "matrix": X.merged_matrix(core, kmers, names, key), "mismatches": X.summary_mismatches(clones, summary, [key])}


def threshold_stability(
    cells: DataFrame, meta: DataFrame, iterations: int = 100, fraction: float = 0.8, seed: int = 1, max_rows: int = 0, schemes: list[P.Scheme] = P.SCHEMES
) -> dict[str, DataFrame]:
    """Repeated subsampling of the reference samples and its summaries."""
    splits = materialize(B.reference_subsamples(meta, iterations, fraction, seed))
    labelled = P.with_cohort(cells, meta).join(meta.select("sample_id", "batch"), "sample_id")
    smallest = min(min(s.global_min_count, s.group_min_count) for s in schemes)
    flags = B.iteration_flags(B.iteration_counts(labelled, splits, iterations, min_count=smallest), splits, meta, schemes)
    table = materialize(B.iteration_table(flags, splits, schemes))
    held = materialize(B.held_out_features(labelled, flags, splits, schemes))
    per_sample = B.sample_stability(held)
    overview, features = B.stability_overview(table), B.feature_overview(held, per_sample)
    selection = B.selection_frequency(flags, iterations, meta, schemes)
    return {
        "iterations": table, "held_out": held, "sample_stability": per_sample, "overview": overview, "features": features,
        "selection": B.most_selected(selection, max_rows, schemes) if max_rows else selection, "screening": B.screening(overview, features),
    }


def public_reference(cells: DataFrame, meta: DataFrame, scheme: P.Scheme = P.MAIN, min_samples: int = 2) -> dict[str, DataFrame]:
    """Training catalog, reference sets and descriptive features (with self-inclusion, for quality control only)."""
    if min_samples > min(scheme.global_min_count, scheme.group_min_count):
        raise ValueError("candidate filter above the smallest count threshold would lose clones")
    kept = P.incidence(cells, [], min_samples)
    counts, sizes = P.presence_counts(P.with_cohort(kept, meta)), P.cohort_sizes(meta)
    reference = P.reference_table(counts, sizes, [], scheme)
    descriptive = P.overlap_features(cells, reference)
    return {
        "catalog": P.catalog(counts, sizes, [], scheme), "reference": reference, "set_summary": P.set_summary(reference, sizes, [], scheme),
        "definition": P.reference_definition(reference, sizes, scheme), "descriptive": descriptive, "checks": P.range_check(descriptive),
    }


def apply_reference(cells: DataFrame, reference: DataFrame) -> dict[str, DataFrame]:
    """Fixed training reference applied to unseen samples; labels are not used."""
    descriptive = P.overlap_features(cells, reference)
    return {"descriptive": descriptive, "features": P.reference_view(descriptive), "log": P.application_log(descriptive)}


def feature_matrices(meta: DataFrame, static: DataFrame, descriptive: DataFrame, reference: DataFrame | None = None, key: str = "sample_id") -> dict[str, DataFrame]:
    """Base, descriptive and (test only) final matrices with their manifest."""
    base = J.checked_left_join(meta, static, [key])
    out = {"base": base, "descriptive": J.checked_left_join(meta.select(key), descriptive, [key])}
    if reference is not None:
        out["final"] = J.checked_left_join(base, reference, [key])
    out["manifest"] = O.manifest(dict(out))
    return out


def nested_schedule(meta: DataFrame, k: int = 5, repeats: int = 20, outer_candidates: int = 300, inner_candidates: int = 100, seed: int = 1) -> dict[str, DataFrame]:
    """Repeated nested cross-validation schedule with balance tables and checks."""
    outer = materialize(L.outer_schedule(meta, k, repeats, outer_candidates, seed))
    inner = materialize(L.inner_schedule(outer, k, inner_candidates, seed))
    return {
        "outer": outer, "inner": inner, "tasks": L.outer_tasks(outer, k), "balance": L.balance_table(outer, ["outer_repeat"], "outer_fold", k, list(L.BALANCE_WEIGHTS)),
        "violations": L.schedule_violations(outer, inner, k),
    }


def public_features_of_tasks(cells: DataFrame, outer: DataFrame, k: int = 5, scheme: P.Scheme = P.MAIN) -> dict[str, DataFrame]:
    """Public features of all outer tasks in one job: external for validation rows, leave-one-out for training rows.

    Training counts of a task are total minus own fold, so no task rebuilds its reference from incidences.
    """
    labelled = cells.join(outer.select("outer_repeat", "sample_id", "cohort", F.col("outer_fold").cast("int").alias("task_fold")), "sample_id")
    counts = P.training_counts(labelled, ["outer_repeat"], "task_fold", k)
    external = P.crossfit(cells, outer.withColumnRenamed("outer_fold", "task_fold"), ["outer_repeat"], "task_fold", k, scheme)
    training = L.outer_tasks(outer, k).filter("role = 'training'").select("outer_repeat", "task_fold", "sample_id", "cohort")
    return {"external": external, "leave_one_out": P.leave_one_out(cells, training, ["outer_repeat", "task_fold"], scheme, counts=counts)}


def outer_task(
    rows: DataFrame, fold: str, task: int, k: int, candidates: list[O.Candidate], numeric: list[str], categorical: list[str]
) -> dict[str, DataFrame]:
    """One outer task: tune on the inner folds of the training rows, refit the winner, predict the validation rows.

    `rows` carries `fold` (outer) and `inner_fold` (1..k on the training rows).
    """
    training = materialize(rows.filter(F.col(fold) != task))
    preds, log = O.tune(training, "inner_fold", k, candidates, numeric, categorical)
    preds = materialize(preds)
    keys = ["l1_ratio_alpha", "lambda"]
    results = M.ranking_metrics(preds, keys)
    best = materialize(O.best_parameters(results.withColumn("_all", F.lit(1)), ["_all"]).drop("_all"))
    winner = best.first()
    mine = preds.filter((F.col("l1_ratio_alpha") == winner.l1_ratio_alpha) & (F.col("lambda") == winner["lambda"]))
    cut = M.youden(M.threshold_table(mine, []), []).first().threshold
    design, names = O.scaled_task(rows, task, fold, numeric, categorical)
    fitted = O.fit_elastic_net(design.filter(F.col(fold) != task), names, O.Candidate(winner.l1_ratio_alpha, winner["lambda"]))
    held = O.score(fitted, design.filter(F.col(fold) == task), ["sample_id", "y"])
    scored = held.withColumn("threshold", F.lit(cut)).withColumn("predicted_label", M.at_threshold("p", cut))
    return {"tuning": results, "fits": log, "best": best, "predictions": scored, "coefficients": O.coefficient_rows(fitted, rows.sparkSession)}


def collected_analysis(preds: DataFrame, coefs: DataFrame, params: DataFrame, models: list[str], expected_tasks: int, prefixes: dict[str, str], reps: int = 5000) -> dict[str, DataFrame]:
    """Repeat metrics, summaries, paired tests and stability of collected results."""
    keys = ["outer_repeat", "model"]
    metrics = materialize(K.repeat_metrics(preds, keys, predicted=M.at_threshold("p", "threshold")))
    long = K.long_metrics(metrics, keys)
    paired = K.paired_values(long, models)
    tests = K.holm(K.with_wilcoxon_p(K.wilcoxon(paired)), ["metric"], "p_value_raw", ["model_a", "model_b"])
    return {
        "metrics": metrics, "summary": K.performance_summary(long, ["model", "metric"], reps), "paired": K.paired_summary(paired), "tests": tests,
        "friedman": K.with_chi_square_p(K.friedman(long, models)), "stability": R.coefficient_stability(coefs, expected_tasks, prefixes), "parameters": R.selection_frequency(params),
    }


def final_selection(preds: DataFrame, fits: DataFrame, rule: str = "one_se", target: float = 0.80) -> dict[str, DataFrame]:
    """Candidate summary, the selected candidate, its threshold rules and per-repeat thresholds."""
    keys = ["l1_ratio_alpha", "lambda"]
    repeats = M.ranking_metrics(preds, [*keys, "outer_repeat"])
    means = K.sample_means(preds, [*keys, "sample_id"], 0.5)
    pooled = M.ranking_metrics(means, keys, "mean_probability", "true_label")
    summary = materialize(O.candidate_summary(repeats, fits, pooled))
    chosen = materialize(O.select_candidate(summary, rule))
    mine = preds.join(chosen.select(*keys), keys, "left_semi")
    pooled_rows = means.join(chosen.select(*keys), keys, "left_semi").select("sample_id", F.col("true_label").alias("y"), F.col("mean_probability").alias("p"))
    return {"summary": summary, "selected": chosen, "thresholds": M.threshold_rules(pooled_rows, [], target=target), "repeat_thresholds": M.threshold_rules(mine, ["outer_repeat"], target=target)}


def locked_test(
    long: DataFrame, preprocessing: DataFrame, coefficients: DataFrame, intercept: float, threshold: float, reps: int = 5000, seed: int = 1
) -> dict[str, DataFrame]:
    """Locked transform, metrics, curves and bootstrap intervals; `long` has (sample_id, y, feature, value)."""
    scored = materialize(O.locked_score(long, preprocessing, coefficients, intercept, ["sample_id", "y"], threshold))
    report = M.full_metrics(scored, [])
    return {
        "predictions": scored, "metrics": report, "confusion": M.score_class_report(report), "roc": M.roc_curve(scored, []), "pr": M.pr_curve(scored, []),
        "intervals": K.bootstrap_intervals(K.stratified_bootstrap(scored, reps, threshold, seed)),
    }


def train_test_split(meta: DataFrame, strata: list[str], seeds: range, ratio: float = 0.7, singleton: str = "train", singleton_aware: bool = False) -> dict[str, DataFrame]:
    """Search over seeds, the best split, its integrity, distributions and stratum status."""
    ranked = materialize(L.ranked_seeds(L.split_scores(L.stratified_split(meta, strata, seeds, ratio, singleton), ratio, singleton_aware)))
    best = ranked.filter("is_selected_best").first().seed
    chosen = materialize(L.stratified_split(meta, strata, range(best, best + 1), ratio, singleton))
    return {
        "scores": ranked, "split": chosen, "integrity": L.split_integrity(meta, chosen), "distribution": L.distribution_table(chosen, strata), "strata": L.strata_status(chosen, strata),
    }
