"""Hand-worked metrics, rank tests, schedules, solver optimality and locked scoring."""

import math

import numpy as np
import pytest

from clonespan.operators import comparison as K
from clonespan.operators import metrics as M
from clonespan.operators import modeling as O
from clonespan.operators import splits as L
from clonespan.operators import stability as B
from clonespan.operators.public import MAIN
from clonespan.plans import flows


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_auc_and_ap_with_ties(spark):
    r = M.ranking_metrics(frame(spark, [(1, 0.8), (0, 0.8), (1, 0.6), (0, 0.3), (0, 0.1)]), []).first()
    assert math.isclose(r.roc_auc, 4.5 / 6) and math.isclose(r.pr_auc, 0.5 * (1 / 2) + 0.5 * (2 / 3))
    assert M.ranking_metrics(frame(spark, [(1, 0.5), (0, 0.5), (0, 0.5)]), []).first().roc_auc == 0.5


def test_degenerate_rates(spark):
    r = M.confusion(frame(spark, [(1, 0.1), (1, 0.2)]), [], predicted=M.at_threshold("p", 0.5)).first()
    assert (r.precision, r.f1, r.specificity) == (0.0, 0.0, None)


def test_threshold_rules(spark):
    df = frame(spark, [(1, 0.9), (1, 0.7), (0, 0.6), (1, 0.4), (0, 0.2)])
    got = {r.rule: r.threshold for r in M.threshold_rules(df, [], target=0.9).collect()}
    assert got == {"youden": 0.7, "max_f1": 0.4, "sensitivity_target": 0.4}


def test_wilcoxon_and_holm(spark):
    pairs = [("m", "a", "b", float(d)) for d in (1, 2, 3, -4, 5)] + [("m", "a", "c", 0.0)] * 3
    df = spark.createDataFrame(pairs, "metric string, model_a string, model_b string, difference double")
    got = {r.model_b: r for r in K.with_wilcoxon_p(K.wilcoxon(df)).collect()}
    assert (got["b"].w_plus, got["b"].w_minus, got["b"].statistic) == (11.0, 4.0, 4.0)
    assert math.isclose(got["b"].p_value_raw, 2 * 7 / 32)  # 7 of 32 sign patterns reach a rank sum of at most 4
    assert (got["c"].statistic, got["c"].p_value_raw) == (0.0, 1.0)
    t = spark.createDataFrame([("m", "x", 0.01), ("m", "y", 0.04), ("m", "z", 0.03)], "metric string, k string, p double")
    adj = {r.k: r.q for r in K.holm(t, ["metric"], "p", ["k"], "q").collect()}
    assert all(math.isclose(adj[k], v) for k, v in {"x": 0.03, "z": 0.06, "y": 0.06}.items())


def test_friedman(spark):
    rows = [("m", r, f"M{i}", v) for r, vs in enumerate([(1, 2, 3), (1, 3, 2), (1, 2, 3), (1, 2, 3)]) for i, v in enumerate(map(float, vs))]
    df = spark.createDataFrame(rows, "metric string, outer_repeat int, model string, value double")
    r = K.with_chi_square_p(K.friedman(df, ["M0", "M1", "M2"])).first()
    assert math.isclose(r.statistic, 6.5) and math.isclose(r.p_value, math.exp(-3.25))
    assert math.isclose(K._chi_square_p(7.814727903251179, 3), 0.05, rel_tol=1e-9)


@pytest.fixture(scope="module")
def subjects(spark):
    rows = [(i, "A" if i % 5 < 3 else "B", str(i % 4), str(i % 3), str(i % 2), i) for i in range(97)]
    return spark.createDataFrame(rows, "sample_id int, cohort string, batch string, material string, sex string, patient int")


def test_nested_schedule_is_valid(subjects):
    s = flows.nested_schedule(subjects, 5, 3, 8, 3)
    assert {r.check_name: r.violations for r in s["violations"].collect()} == dict.fromkeys(
        ["sample_not_once_per_repeat", "fold_missing", "label_counts_uneven", "partition_repeated", "validation_row_in_inner", "training_row_not_in_inner", "inner_row_repeated"], 0)
    sizes = [r["count"] for r in s["outer"].groupBy("outer_repeat", "outer_fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and s["inner"].count() == 97 * 3 * 4


def test_split_respects_strata(subjects):
    out = flows.train_test_split(subjects, ["cohort", "batch"], range(1, 6))
    assert all(r.violations == 0 for r in out["integrity"].collect())
    for r in out["strata"].collect():
        assert r.train_n == min(max(math.floor(r.total_n * 0.7 + 0.5), 1), r.total_n - 1)


def test_singleton_policy(spark, subjects):
    lone = subjects.unionByName(spark.createDataFrame([(500, "A", "9", "0", "0", 500)], subjects.schema))
    for policy, side in (("train", "train"), ("test", "test")):
        assert L.stratified_split(lone, ["cohort", "batch"], range(1, 2), singleton=policy).filter("sample_id = 500").first().split == side
    ref = B.reference_subsamples(lone, 2)
    assert {r.role for r in ref.filter("sample_id = 500").collect()} == {"reference"}


def test_jaccard_of_empty_sets_is_one(spark, subjects):
    cells = spark.createDataFrame([(i, i, 1.0) for i in range(97)], "sample_id int, cdr3_aa int, frequency_norm double")
    out = flows.threshold_stability(cells, subjects, 2)
    overview = out["overview"].collect()
    assert overview and all(r.median_jaccard_to_full == 1.0 and r.empty_rate == 1.0 for r in overview)
    assert {r.status for r in out["screening"].collect()} == {"REVIEW"}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=120) > 0.3).astype(int)
    data = [(i, int(y[i]), *map(float, x[i]), "u" if i % 3 else "w", i % 3 + 1, i % 2 + 1) for i in range(120)]
    return spark.createDataFrame(data, "sample_id int, y int, a double, b double, c double, d double, m string, fold int, inner_fold int")


def test_elastic_net_is_optimal(rows):
    names = ["a", "b", "c", "d"]
    lam, alpha = 3.0, 0.5
    fit = O.fit_elastic_net(rows, names, O.Candidate(alpha, lam), tol=1e-10)
    data = rows.toPandas()
    x, y = data[names].to_numpy(), data["y"].to_numpy()
    w = len(y) / (2 * np.where(y == 1, y.sum(), len(y) - y.sum()))
    beta = np.array(fit.coefficients)
    p = 1 / (1 + np.exp(-(x @ beta + fit.intercept)))
    grad = x.T @ (w * (p - y)) / lam + (1 - alpha) * beta  # gradient of C * loss + ridge part, C = 1 / lambda
    for g, b in zip(grad, beta):
        assert abs(g + alpha * np.sign(b)) < 1e-3 if abs(b) > 1e-9 else abs(g) <= alpha + 1e-3


def test_outer_task_predicts_only_validation_rows(rows):
    out = flows.outer_task(rows, "fold", 2, 2, [O.Candidate(0.5, 1.0), O.Candidate(0.9, 5.0)], ["a", "b", "c", "d"], ["m"])
    want = {r.sample_id for r in rows.filter("fold = 2").collect()}
    got = out["predictions"].collect()
    assert {r.sample_id for r in got} == want and all(0 < r.p < 1 for r in got)
    assert "m__w_vs_u" in {r.feature_name for r in out["coefficients"].collect()}


def test_fold_statistics_merge(rows):
    long = rows.unpivot(["sample_id", "fold"], ["a", "b"], "feature", "value")
    data = rows.toPandas()
    for r in O.fold_statistics(long, "fold", 3).collect():
        v = data.loc[data.fold != r.task_fold, r.feature]
        assert r.n == len(v) and math.isclose(r["mean"], v.mean(), abs_tol=1e-12) and math.isclose(r.sd, v.std(ddof=0), rel_tol=1e-12)


def test_unseen_category_stops_locked_scoring(spark):
    df = spark.createDataFrame([(1, "u"), (2, "z")], "sample_id int, m string")
    assert O.dummy_code(df, "m", ["u", "w"], ["sample_id"]).count() == 2
    with pytest.raises(Exception, match="unseen m: z"):
        O.dummy_code(df, "m", ["u", "w"], ["sample_id"], locked=True).collect()


def test_locked_test_report(spark, rows):
    long = rows.unpivot(["sample_id", "y", "fold"], ["a", "b"], "feature", "value")
    pre = O.preprocessing_table(long.filter("fold <> 1"))
    coefs = spark.createDataFrame([("a", 1.0), ("b", -0.5)], "feature string, coefficient double")
    out = flows.locked_test(long.filter("fold = 1"), pre, coefs, 0.0, 0.5, 30)
    m = out["metrics"].first()
    ci = {r.metric: r for r in out["intervals"].collect()}
    assert m.TN + m.FP + m.FN + m.TP == 40 and ci["roc_auc"].ci_lower <= m.roc_auc <= ci["roc_auc"].ci_upper
    assert sum(r.n for r in out["confusion"].collect()) == 40


def test_candidate_filter_guard(spark, subjects):
    cells = spark.createDataFrame([(1, 1, 1.0)], "sample_id int, cdr3_aa int, frequency_norm double")
    with pytest.raises(ValueError):
        flows.public_reference(cells, subjects, MAIN, min_samples=4)


def test_manifest_roles(spark):
    t = spark.createDataFrame([("s", "A", 1.0, 1.0, 2, 1.0)], "sample_id string, cohort string, Y_frequency double, Shannon double, aa_clone_number int, all_ref_public_clone_ratio double")
    got = {r.feature_name: (r.feature_role, r.model_default) for r in O.manifest({"train_base": t}).collect()}
    assert got["Y_frequency"] == ("composition_reference_drop", "no") and got["Shannon"] == ("candidate_predictor", "yes")
    assert got["aa_clone_number"] == ("qc_or_sensitivity_predictor", "sensitivity") and got["all_ref_public_clone_ratio"][1] == "dynamic"


def test_manifest_sources_notes_and_ordered_predictors(spark):
    base = spark.createDataFrame([(1, "A", 0.5, None, 0.1)], "sample_id int, cohort string, Gini double, Shannon double, Y_frequency double")
    desc = spark.createDataFrame([(1, 0.2)], "sample_id int, A_specific_ref_frequency_sum double")
    m = O.manifest({"train_base": base, "train_descriptive": desc}, {"train_base": "features"}, ["sample_id", "cohort"])
    got = {r.feature_name: (r.source_file, r.reference_drop, r.notes != "", r.present_in_train_descriptive) for r in m.collect()}
    assert got == {
        "sample_id": ("metadata", False, False, True), "cohort": ("metadata", False, False, False), "Gini": ("features", False, False, False),
        "Shannon": ("features", False, False, False), "Y_frequency": ("features", True, False, False),
        "A_specific_ref_frequency_sum": ("train_descriptive", False, True, True),
    }
    known = spark.createDataFrame([("Gini", 1), ("Shannon", 0), ("Y_frequency", 1)], "feature_name string, n int")
    assert [(r.feature_name, r.position) for r in O.ordered_predictors(m, known).collect()] == [("Gini", 1)]
