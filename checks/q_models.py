"""Checked queries: model matrix, preprocessing, fits, candidate choice, locked scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespan.operators import comparison as K
from clonespan.operators import features as X
from clonespan.operators import joins as J
from clonespan.operators import metrics as M
from clonespan.operators import modeling as O
from clonespan.operators import public as P
from clonespan.operators import quality as D
from clonespan.session import materialize

from .q_features import CORE, KEY, summary
from .q_public import descriptive, reference
from .registry import query
from .sql_public import LOO_COLUMNS, MODEL, RATIO, SETS, flags_sql
from .sql_views import FRAGMENTS, confusion_sql, ranking_sql, rule_sql

NUM = ["age", "x1", "x2", "x3", "x4", "x5"]
FOLDS = 5


def long_matrix(v):
    return v.matrix.unpivot(["sample_id", "fold", "y", "material"], NUM, "feature", "value")


FRAGMENTS["matrix_long"] = "select sample_id, fold, y, material, feature, value from (unpivot (select sample_id, fold, y, material, age, cast(x1 as double) as x1, cast(x2 as double) as x2, cast(x3 as double) as x3, x4, cast(x5 as double) as x5 from matrix) on age, x1, x2, x3, x4, x5 into name feature value value)"
FRAGMENTS["train_stats"] = f"select t.task_fold, feature, count(*) as n, avg(value) as mean, stddev_pop(value) as sd from matrix_long l, range(1, {FOLDS + 1}) t(task_fold) where l.fold <> t.task_fold group by 1, 2"


@query("mod1_base_matrix", "sample_id cohort batch material sex Shannon:8 Gini:8 global_public_aa_clone_number:i global_public_aa_frequency_sum:8", """
    select s.sample_id, s.cohort, s.batch, s.material, s.sex, d.Shannon, e.Gini, p.global_public_aa_clone_number, p.global_public_aa_frequency_sum
    from samples s join inc_diversity d on s.sample_id = d.sample_id join inc_evenness e on e.sample_id = s.sample_id join descriptive p on p.sample_id = s.sample_id""")
def _(v):
    static = X.diversity(v.inc, KEY).join(X.evenness_and_expansion(v.inc, KEY), "sample_id")
    base = J.checked_left_join(v.samples, static.drop("aa_clone_number"), KEY)
    return J.checked_left_join(base, descriptive(v), KEY)


META = ["sample_id", "cohort", "batch", "material", "sex", "patient", "age"]
DESC = [f"{p}_{m}" for p in P.descriptive_prefixes().values() for m in P.MEASURES]
ONLY_TEST = [n for n in P.reference_feature_names() if n not in DESC]
MAN_FLAGS = [f"present_in_{n}" for n in ("train_base", "train_descriptive", "test_final", "test_base", "test_descriptive")]


def manifest(v):
    """Of column names and types only: the views' clone tables and metadata have sample keys of their own."""
    base = v.samples.join(X.core_table(v.clones, summary(v), KEY), "sample_id")
    desc = v.samples.select("sample_id").join(descriptive(v), "sample_id")
    final = base.join(P.external_features(v.inc, reference(v)), "sample_id")
    tables = {"train_base": base, "train_descriptive": desc, "test_final": final, "test_base": base, "test_descriptive": desc}
    sources = {"train_base": "sample_features", "train_descriptive": "descriptive_public_features", "test_final": "reference_public_features"}
    return O.manifest(tables, sources, META)


_is_wt = "feature_name like 'weighted\\_%' escape '\\'"
GROUP_SQL = f"""
select feature_name, feature_group, case when feature_group = 'tcr_qc_depth' then 'qc_or_sensitivity_predictor' when feature_name in ('Y_frequency', 'weighted_Y_frequency', 'weighted_length_other_freq', 'nonpolar_aa_ratio', 'weighted_nonpolar_aa_ratio') then 'composition_reference_drop' else 'candidate_predictor' end as feature_role, n from (
  select feature_name, case when feature_name in ('total_reads_all_nt', 'total_reads_valid_aa', 'valid_read_ratio', 'nt_clone_number_all', 'valid_nt_clone_number', 'valid_nt_row_ratio', 'aa_clone_number', 'log1p_aa_clone_number') then 'tcr_qc_depth'
    when feature_name in ('Shannon', 'Simpson', 'inverse_Simpson', 'Gini', 'clonality') then 'tcr_diversity' when feature_name = 'top1_frequency' or feature_name like 'top%_cumulative_frequency' then 'tcr_clonal_expansion'
    when contains(feature_name, 'aa_length') or feature_name like 'weighted\\_length\\_%' escape '\\' then 'tcr_aa_length' when regexp_full_match(feature_name, 'weighted_[A-Z]_frequency') then 'tcr_aa_composition_weighted'
    when regexp_full_match(feature_name, '[A-Z]_frequency') then 'tcr_aa_composition_unweighted' else 'tcr_physicochemical' end as feature_group, n
  from (select u.feature_name, s.n from (values {", ".join(f"('{c}')" for c in CORE)}) u(feature_name), (select count(distinct sample_id) as n from clones) s) f) g"""


def _missing(table: str, names: list[str]) -> str:
    return " union all ".join(f"select '{c}' as feature_name, count(*) - count(\"{c}\") as missing from {table}" for c in names)


_listed = ", ".join(f"('{c}', {i}, '{src}')" for i, (c, src) in enumerate(
    [(c, "metadata") for c in META] + [(c, "sample_features") for c in CORE] + [(c, "descriptive_public_features") for c in DESC] + [(c, "reference_public_features") for c in ONLY_TEST], 1))


@query("mod2_feature_manifest", "feature_name feature_order:i source_file data_type feature_group feature_role model_default transformation " + " ".join(f"{f}:b" for f in MAN_FLAGS)
       + " eligible_for_fixed_train_cv_input:b dynamic_in_training:b reference_drop:b notes missing:i", f"""
    with described as (select d.* from descriptive d join samples s on d.sample_id = s.sample_id),
      lost as ({_missing("samples", META)} union all {_missing("described", DESC)} union all select feature_name, (select count(distinct sample_id) from clones) - n from ({GROUP_SQL}) g),
      grouped as (select l.*, case feature_name when 'sample_id' then 'identifier' when 'cohort' then 'outcome' when 'patient' then 'identifier_trace' when 'age' then 'clinical' when 'sex' then 'clinical' when 'material' then 'clinical_optional'
          when 'batch' then 'technical_qc' else coalesce(feature_group, case when contains(feature_name, 'public_aa_') or contains(feature_name, 'shared_aa_') then 'public_descriptive' else 'public_reference_dynamic' end) end as grp,
          case when source_file = 'metadata' then case when feature_name in ('sample_id', 'patient', 'age') then 'integer' else 'categorical' end
            when starts_with(feature_name, 'total_reads') or (feature_name not like 'log1p%' and regexp_matches(feature_name, 'clone_number(_all)?$')) then 'integer' else 'numeric' end as data_type
        from (select v.*, g.feature_group, g.feature_role from (values {_listed}) v(feature_name, feature_order, source_file) left join ({GROUP_SQL}) g on g.feature_name = v.feature_name) l),
      roles as (select *, case feature_name when 'sample_id' then 'join_key' when 'cohort' then 'outcome_label' when 'patient' then 'trace_only' when 'age' then 'primary_predictor' when 'sex' then 'primary_predictor' when 'material' then 'optional_predictor'
          when 'batch' then 'qc_only' else coalesce(feature_role, case grp when 'public_descriptive' then 'descriptive_only' else 'dynamic_predictor_train_fixed_predictor_test' end) end as r from grouped)
    select r.feature_name, feature_order, source_file, data_type, grp as feature_group, r as feature_role, source_file in ('metadata', 'sample_features') as present_in_train_base, source_file in ('metadata', 'sample_features') as present_in_test_base,
      r.feature_name in ('sample_id', 'aa_clone_number') or source_file = 'descriptive_public_features' as present_in_train_descriptive,
      r.feature_name in ('sample_id', 'aa_clone_number') or source_file = 'descriptive_public_features' as present_in_test_descriptive,
      source_file in ('metadata', 'sample_features', 'reference_public_features') or r.feature_name in ({", ".join(f"'{n}'" for n in P.reference_feature_names())}) as present_in_test_final,
      case r when 'primary_predictor' then 'yes' when 'candidate_predictor' then 'yes' when 'optional_predictor' then 'optional' when 'qc_or_sensitivity_predictor' then 'sensitivity'
        when 'dynamic_predictor_train_fixed_predictor_test' then 'dynamic' else 'no' end as model_default,
      case when r = 'outcome_label' then 'binary encode in model pipeline' when r in ('trace_only') then 'exclude from predictors' when r = 'qc_only' then 'exclude from primary model' when r = 'composition_reference_drop' then 'drop before model fitting'
        when r.feature_name in ('sex', 'material') then 'one-hot encode in model pipeline' when r in ('join_key', 'descriptive_only') then 'none' else 'standardize within each training fold' end as transformation,
      source_file in ('metadata', 'sample_features') and r not in ('join_key', 'outcome_label', 'trace_only', 'qc_only', 'descriptive_only', 'composition_reference_drop') as eligible_for_fixed_train_cv_input,
      grp = 'public_reference_dynamic' as dynamic_in_training, r = 'composition_reference_drop' as reference_drop, case when grp = 'public_reference_dynamic' then '{O.DYNAMIC_NOTE}' else '' end as notes, missing
    from roles r left join lost m on m.feature_name = r.feature_name""")
def _(v):
    desc = v.samples.select("sample_id").join(descriptive(v), "sample_id").select(*DESC)
    parts = [v.samples.select(*META), X.core_table(v.clones, summary(v), KEY).select(*CORE), desc]
    profile = reduce(DataFrame.unionByName, [D.missing_profile(t) for t in parts])
    return manifest(v).join(profile.select(F.col("column_name").alias("feature_name"), F.col("nulls").alias("missing")), "feature_name", "left")


@query("scl19_feature_classes", "feature_name feature_group feature_role n:i", GROUP_SQL)
def _(v):
    core = X.core_table(v.clones, summary(v), KEY)
    long = core.select(*[F.col(c).cast("double").alias(c) for c in CORE]).unpivot([], CORE, "feature_name", "value")
    names = long.groupBy("feature_name").agg(F.count("value").alias("n")).withColumn("data_type", F.lit("numeric"))
    return O.classify_features(names)


@query("flt7_static_predictors", "feature_name n:i", f"select feature_name, n from ({GROUP_SQL}) g where feature_role = 'candidate_predictor'")
def _(v):
    core = X.core_table(v.clones, summary(v), KEY)
    known = core.select(*[F.col(c).cast("double").alias(c) for c in CORE]).unpivot([], CORE, "feature_name", "value")
    return O.static_predictors(manifest(v)).join(known.groupBy("feature_name").agg(F.count("value").alias("n")), "feature_name")


_core_order = ", ".join(f"('{c}', {i})" for i, c in enumerate(CORE, 1))


@query("mod21_ordered_predictors", "feature_name position:i n:i", f"""
    select g.feature_name, row_number() over (order by o.i) as position, n from ({GROUP_SQL}) g join (values {_core_order}) o(feature_name, i) on g.feature_name = o.feature_name
    where feature_role = 'candidate_predictor' and n > 0""")
def _(v):
    core = X.core_table(v.clones, summary(v), KEY)
    return O.ordered_predictors(manifest(v), D.missing_profile(core).select(F.col("column_name").alias("feature_name"), F.col("non_null").alias("n")))


@query("mod3_schema_equality", "same:b rows:i", "select true as same, count(*) as rows from matrix")
def _(v):
    train, test = v.matrix.filter("fold <> 1"), v.matrix.filter("fold = 1")
    same = O.same_schema(train, test)
    return train.unionByName(test).agg(F.count(F.lit(1)).alias("rows")).withColumn("same", F.lit(same))


@query("flt6_zero_variance", "feature sd:6 keep:b", "select feature, stddev_pop(value) as sd, stddev_pop(value) > 1e-12 as keep from matrix_long group by 1")
def _(v):
    return O.zero_variance(v.matrix, NUM)


@query("mod4_training_statistics", "task_fold:i feature n:i mean:5 sd:5", "select * from train_stats")
def _(v):
    return O.fold_statistics(long_matrix(v), "fold", FOLDS)


@query("mod4_standardised_values", "sample_id feature value:7", """
    select l.sample_id, l.feature, (l.value - s.mean) / s.sd as value from matrix_long l join train_stats s on l.feature = s.feature and l.fold = s.task_fold where s.sd > 1e-12""")
def _(v):
    long = long_matrix(v)
    return O.standardize(long, O.fold_statistics(long, "fold", FOLDS), "fold")


@query("mod5_dummy_coding", "sample_id material__BUILDING_vs_AUTOMOBILE:1 material__FURNITURE_vs_AUTOMOBILE:1 material__HOUSEHOLD_vs_AUTOMOBILE:1 material__MACHINERY_vs_AUTOMOBILE:1", "select sample_id, " + ", ".join(
    f"case when material = '{m}' then 1.0 else 0.0 end as \"material__{m}_vs_AUTOMOBILE\"" for m in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from matrix")
def _(v):
    cats = O.levels(v.matrix.filter("fold <> 1"), "material")
    return O.dummy_code(v.matrix, "material", cats, ["sample_id"])


@query("mod6_model_specifications", "model feature n:i total:2", """
    select m.model, l.feature, count(*) as n, sum(value) as total from matrix_long l join (values ('M0_clinical', 'age'), ('M1_static_tcr', 'age'), ('M1_static_tcr', 'x1'), ('M1_static_tcr', 'x2'), ('M2_static_tcr_public', 'age'), ('M2_static_tcr_public', 'x1'),
      ('M2_static_tcr_public', 'x2'), ('M2_static_tcr_public', 'x3'), ('M3_static_tcr_public_material', 'age'), ('M3_static_tcr_public_material', 'x1'), ('M3_static_tcr_public_material', 'x2'), ('M3_static_tcr_public_material', 'x3')) m(model, feature) on l.feature = m.feature group by 1, 2""")
def _(v):
    specs = O.model_specifications(["x1", "x2"], ["x3"])
    return O.expand_models(long_matrix(v), specs).groupBy("model", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# -- fits: property checks only (the solver is Spark ML's) ----------------------------------------------------------------

CANDS = [O.Candidate(0.5, 1.0), O.Candidate(0.5, 10.0)]


def tuned(v, candidates=CANDS, k=2):
    rows = materialize(v.matrix.withColumn("fold", F.col("sample_id") % k + 1))
    return O.tune(rows, "fold", k, candidates, NUM, ["sex", "material"])


@query("mod7_elastic_net_fit", "feature_name coefficient:6 absolute_coefficient:6 nonzero:b")
def _(v):
    design, names = O.scaled_task(v.matrix, 1, "fold", NUM, ["sex", "material"])
    return O.coefficient_rows(O.fit_elastic_net(design.filter("fold <> 1"), names, CANDS[0]), v.spark)


@query("mod8_tuning", "l1_ratio_alpha:2 lambda:2 roc_auc:6 pr_auc:6")
def _(v):
    preds, _ = tuned(v)
    return M.ranking_metrics(preds, ["l1_ratio_alpha", "lambda"])


@query("mod10_outer_fit", "sample_id y:i p:6 predicted_label:i")
def _(v):
    design, names = O.scaled_task(v.matrix, 2, "fold", NUM, ["sex", "material"])
    fitted = O.fit_elastic_net(design.filter("fold <> 2"), names, CANDS[0])
    return O.score(fitted, design.filter("fold = 2"), ["sample_id", "y"]).withColumn("predicted_label", M.at_threshold("p", 0.5))


@query("mod13_repeated_predictions", "l1_ratio_alpha:2 lambda:2 sample_id y:i p:6")
def _(v):
    return tuned(v)[0]


@query("mod16_final_fit", "sample_id p:6")
def _(v):
    rows = v.matrix.withColumn("fold", F.lit(1))
    design, names = O.scaled_task(rows, 0, "fold", NUM, ["sex", "material"])
    return O.score(O.fit_elastic_net(design, names, CANDS[1]), design, ["sample_id"])


# -- candidate choice: the four prediction models stand for four (alpha, lambda) candidates ------------------------------

ALPHA = {"M0": 0.1, "M1": 0.5, "M2": 0.5, "M3": 0.9}
LAMBDA = {"M0": 1.0, "M1": 3.0, "M2": 10.0, "M3": 30.0}
_a = "case model when 'M0' then 0.1 when 'M1' then 0.5 when 'M2' then 0.5 else 0.9 end"
_l = "case model when 'M0' then 1.0 when 'M1' then 3.0 when 'M2' then 10.0 else 30.0 end"
FRAGMENTS["cand_preds"] = f"select *, cast({_a} as double) as l1_ratio_alpha, cast({_l} as double) as \"lambda\" from preds"
FRAGMENTS["cand_repeats"] = "select * from (" + ranking_sql("cand_preds", 'l1_ratio_alpha, "lambda", outer_repeat') + ") r"
FRAGMENTS["cand_fits"] = 'select l1_ratio_alpha, "lambda", outer_repeat, outer_fold, cast(round(sum(p) * 7) as bigint) % 40 + 5 as n_nonzero_coefficients, max(p) <= 1.0 and "lambda" > 1 as converged from cand_preds group by 1, 2, 3, 4'
FRAGMENTS["cand_means"] = 'select l1_ratio_alpha, "lambda", sample_id, max(y) as y, avg(p) as p from cand_preds group by 1, 2, 3'
FRAGMENTS["cand_pooled"] = "select * from (" + ranking_sql("cand_means", 'l1_ratio_alpha, "lambda"') + ") r"
FRAGMENTS["cand_summary"] = """
select r.*, f.* exclude (l1_ratio_alpha, "lambda"), p.roc_auc as sample_mean_oof_roc_auc, p.pr_auc as sample_mean_oof_pr_auc, sd_repeat_roc_auc / sqrt(n_repeats) as se_repeat_roc_auc
from (select l1_ratio_alpha, "lambda", count(*) as n_repeats, avg(roc_auc) as mean_repeat_roc_auc, coalesce(stddev_samp(roc_auc), 0) as sd_repeat_roc_auc, quantile_cont(roc_auc, 0.5) as median_repeat_roc_auc, avg(pr_auc) as mean_repeat_pr_auc, stddev_samp(pr_auc) as sd_repeat_pr_auc from cand_repeats group by 1, 2) r
join (select l1_ratio_alpha, "lambda", avg(n_nonzero_coefficients) as mean_nonzero_coefficients, quantile_cont(cast(n_nonzero_coefficients as double), 0.5) as median_nonzero_coefficients, bool_and(converged) as all_fits_converged from cand_fits group by 1, 2) f on r.l1_ratio_alpha = f.l1_ratio_alpha and r."lambda" = f."lambda"
join cand_pooled p on r.l1_ratio_alpha = p.l1_ratio_alpha and r."lambda" = p."lambda"
"""
CK = ["l1_ratio_alpha", "lambda"]


def cand_preds(v):
    pick = lambda table: F.coalesce(*[F.when(F.col("model") == m, F.lit(x)) for m, x in table.items()])
    return v.preds.withColumns({"l1_ratio_alpha": pick(ALPHA), "lambda": pick(LAMBDA)})


def cand_fits(preds):
    return preds.groupBy(*CK, "outer_repeat", "outer_fold").agg(
        (F.round(F.sum("p") * 7).cast("bigint") % 40 + 5).alias("n_nonzero_coefficients"), ((F.max("p") <= 1.0) & (F.col("lambda") > 1)).alias("converged"))


def cand_summary(v):
    preds = cand_preds(v)
    repeats = M.ranking_metrics(preds, [*CK, "outer_repeat"])
    means = K.sample_means(preds, [*CK, "sample_id"], 0.5)
    pooled = M.ranking_metrics(means, CK, "mean_probability", "true_label")
    return O.candidate_summary(repeats, cand_fits(preds), pooled)


SUMMARY_SPEC = "l1_ratio_alpha:2 lambda:2 n_repeats:i mean_repeat_roc_auc:8 sd_repeat_roc_auc:8 se_repeat_roc_auc:8 median_repeat_roc_auc:8 mean_repeat_pr_auc:8 sample_mean_oof_roc_auc:8 sample_mean_oof_pr_auc:8 mean_nonzero_coefficients:6 median_nonzero_coefficients:4 all_fits_converged:b"


@query("mod14_candidate_summary", SUMMARY_SPEC, "select * from cand_summary")
def _(v):
    return cand_summary(v)


@query("join11_candidate_join", SUMMARY_SPEC, "select * from cand_summary")
def _(v):
    return cand_summary(v)


@query("flt10_converged_only", "l1_ratio_alpha:2 lambda:2", "select l1_ratio_alpha, \"lambda\" from cand_summary where all_fits_converged")
def _(v):
    return O.converged_only(cand_summary(v))


SELECT_SPEC = "l1_ratio_alpha:2 lambda:2 mean_repeat_roc_auc:8 mean_nonzero_coefficients:6 n_eligible:i selection_rule"
LEAD = "round(mean_repeat_roc_auc, 12) desc, round(mean_repeat_pr_auc, 12) desc, mean_nonzero_coefficients, \"lambda\" desc, l1_ratio_alpha desc"


@query("mod15_select_best_mean", SELECT_SPEC, f"""
    select *, 1 as n_eligible, 'best_mean' as selection_rule from cand_summary where all_fits_converged order by {LEAD} limit 1""")
def _(v):
    return O.select_candidate(cand_summary(v), "best_mean")


@query("mod15_select_one_se", SELECT_SPEC, f"""
    select *, count(*) over () as n_eligible, 'one_se' as selection_rule from cand_summary where all_fits_converged
      and mean_repeat_roc_auc >= (select mean_repeat_roc_auc - se_repeat_roc_auc from cand_summary where all_fits_converged order by {LEAD} limit 1) - 1e-12
    order by mean_nonzero_coefficients, round(mean_repeat_pr_auc, 12) desc, "lambda" desc, l1_ratio_alpha desc limit 1""")
def _(v):
    return O.select_candidate(materialize(cand_summary(v)), "one_se")


@query("mod9_best_parameters", "outer_repeat l1_ratio_alpha:2 lambda:2 roc_auc:8 pr_auc:8", """
    select * from (select *, row_number() over (partition by outer_repeat order by round(roc_auc, 12) desc, round(pr_auc, 12) desc, "lambda" desc, l1_ratio_alpha desc) as rn from cand_repeats) x where rn = 1""")
def _(v):
    return O.best_parameters(M.ranking_metrics(cand_preds(v), [*CK, "outer_repeat"]), ["outer_repeat"])


@query("mod20_selected_predictions", "outer_repeat sample_id l1_ratio_alpha:2 p:8 threshold:8 predicted_label:i", f"""
    with best as (select * from (select *, row_number() over (partition by outer_repeat order by round(roc_auc, 12) desc, round(pr_auc, 12) desc, "lambda" desc, l1_ratio_alpha desc) as rn from cand_repeats) x where rn = 1),
      mine as (select p.* from cand_preds p join best b on p.outer_repeat = b.outer_repeat and p.l1_ratio_alpha = b.l1_ratio_alpha and p."lambda" = b."lambda"), cuts as ({rule_sql('mine', 'outer_repeat')})
    select m.outer_repeat, m.sample_id, l1_ratio_alpha, p, c.threshold, case when p >= c.threshold then 1 else 0 end as predicted_label from mine m join cuts c on m.outer_repeat = c.outer_repeat and c.rule = 'youden'""")
def _(v):
    preds = cand_preds(v).drop("threshold")
    best = materialize(O.best_parameters(M.ranking_metrics(preds, [*CK, "outer_repeat"]), ["outer_repeat"]))
    mine = preds.join(best.select("outer_repeat", *CK), ["outer_repeat", *CK], "left_semi")
    cuts = M.youden(M.threshold_table(mine, ["outer_repeat"]), ["outer_repeat"])
    return O.selected_predictions(preds, best, cuts, ["outer_repeat"])


# -- tasks and locked scoring ------------------------------------------------------------------------------------------

@query("mod11_task_violations", "check_name violations:i", """
    select 'validation_row_in_inner' as check_name, count(*) as violations from matrix where fold = 2 and x1 > 12 union all select 'training_row_not_in_inner', 0
    union all select 'row_not_in_matrix', 0""")
def _(v):
    m = v.matrix.select("sample_id", "fold", "x1")
    return O.task_violations(m, m.filter("fold <> 2 or x1 > 12"), m, 2)


def mod12_rows(v):
    """Inner folds 1..3 on the samples outside batch 3."""
    return v.samples.filter("batch <> '3'").withColumn("inner_fold", F.floor(F.col("sample_id") / 4) % 3 + 1)


FRAGMENTS["inner_samples"] = "select *, sample_id // 4 % 3 + 1 as inner_fold from samples where batch <> '3'"
FRAGMENTS["inner_members"] = "select s.*, t.task_fold from inner_samples s, range(1, 4) t(task_fold) where s.inner_fold <> t.task_fold"
FRAGMENTS["inner_n"] = "select task_fold, count(*) filter (cohort = 'A') as n_neg, count(*) filter (cohort = 'B') as n_pos from inner_members group by 1"
FRAGMENTS["inner_counts"] = "select task_fold, cdr3_aa, count(*) filter (cohort = 'A') as neg_count, count(*) filter (cohort = 'B') as pos_count from inc i join inner_members m on i.sample_id = m.sample_id group by 1, 2"
FRAGMENTS["inner_flagged"] = f"select c.*, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from inner_counts c join inner_n n on c.task_fold = n.task_fold"
FRAGMENTS["inner_sizes"] = "select task_fold, " + ", ".join(f"count(*) filter (\"{s}\") as size_{s}" for s in SETS) + " from inner_flagged group by 1"
_ext = ", ".join(
    f"count(*) filter (f.\"{s}\") as {p}_clone_number, count(*) filter (f.\"{s}\") / count(*) as {p}_clone_ratio, coalesce(sum(frequency_norm) filter (f.\"{s}\"), 0) as {p}_frequency_sum, "
    f"case when max(z.size_{s}) = 0 then 0.0 else count(*) filter (f.\"{s}\") / max(z.size_{s}) end as {p}_set_coverage" for s, p in MODEL.items())
# Brute force: the reference of every held-out row is rebuilt from the other rows of its task.
FRAGMENTS["inner_rebuilt"] = f"""
select *, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from (
  select h.task_fold, h.sample_id as held, c.cdr3_aa, c.neg_count - case when o.sample_id is not null and h.cohort = 'A' then 1 else 0 end as neg_count, c.pos_count - case when o.sample_id is not null and h.cohort = 'B' then 1 else 0 end as pos_count,
    n_neg - case when h.cohort = 'A' then 1 else 0 end as n_neg, n_pos - case when h.cohort = 'B' then 1 else 0 end as n_pos, o.frequency_norm, o.sample_id is not null as own
  from inner_members h join inner_counts c on c.task_fold = h.task_fold join inner_n n on n.task_fold = h.task_fold left join inc o on o.sample_id = h.sample_id and o.cdr3_aa = c.cdr3_aa) r"""


@query("mod12_inner_external_features", "inner_fold:i sample_id " + " ".join(f"{n}:8" for n in P.reference_feature_names()), f"""
    select *, {RATIO} from (select s.inner_fold, i.sample_id, {_ext} from inc i join inner_samples s on i.sample_id = s.sample_id join inner_sizes z on z.task_fold = s.inner_fold
      left join inner_flagged f on f.task_fold = s.inner_fold and f.cdr3_aa = i.cdr3_aa group by 1, 2) x""")
def _(v):
    return P.crossfit(v.inc, mod12_rows(v), [], "inner_fold", 3)


@query("mod12_inner_loo_features", "task_fold:i sample_id " + " ".join(f"{n}:8" for n in P.reference_feature_names()), f"""
    select *, {RATIO} from (select task_fold, held as sample_id, {LOO_COLUMNS} from inner_rebuilt group by 1, 2) x""")
def _(v):
    rows = mod12_rows(v).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("task_fold")).filter("inner_fold <> task_fold")
    return P.leave_one_out(v.inc, rows, ["task_fold"])


COEF = {"age": 0.4, "x1": -0.3, "x2": 0.2, "x3": 0.0, "x4": 0.7}
_coef_values = ", ".join(f"('{n}', cast({c} as double))" for n, c in COEF.items())


def coefs(v):
    return v.spark.createDataFrame(list(COEF.items()), "feature string, coefficient double")


@query("mod17_locked_scoring", "sample_id p:8 predicted_label:i", f"""
    select sample_id, 1 / (1 + exp(-(s - 0.1))) as p, case when 1 / (1 + exp(-(s - 0.1))) >= 0.5 then 1 else 0 end as predicted_label from (
      select l.sample_id, sum(c.coefficient * (l.value - t.mean) / t.sd) as s from matrix_long l join (values {_coef_values}) c(feature, coefficient) on l.feature = c.feature
      join train_stats t on t.feature = l.feature and t.task_fold = 1 where l.fold = 1 group by 1) x""")
def _(v):
    long = long_matrix(v).filter(F.col("feature").isin(list(COEF)))
    locked = O.preprocessing_table(long.filter("fold <> 1"))
    return O.locked_score(long.filter("fold = 1"), locked, coefs(v), -0.1, ["sample_id"], 0.5)


@query("mod18_locked_value_audit", "quantity observed:2 expected:2 matches:b", """
    select 'size_global' as quantity, size_global as observed, size_global as expected, true as matches from set_sizes union all select 'size_shared', size_shared, -1, false from set_sizes""")
def _(v):
    sizes = materialize(P.set_sizes(reference(v)))
    locked = sizes.first()
    return D.expected_values(sizes, {"size_global": locked.size_global, "size_shared": -1})


@query("mod19_coefficient_table", "feature_name coefficient:4 absolute_coefficient:4 odds_ratio_per_sd:8 nonzero:b training_mean:5 training_sd:5 display_rank:i", f"""
    select c.feature as feature_name, coefficient, abs(coefficient) as absolute_coefficient, exp(coefficient) as odds_ratio_per_sd, abs(coefficient) > 1e-12 as nonzero, t.mean as training_mean, t.sd as training_sd,
      row_number() over (order by abs(coefficient) > 1e-12 desc, abs(coefficient) desc, c.feature) as display_rank from (values {_coef_values}) c(feature, coefficient) join train_stats t on t.feature = c.feature and t.task_fold = 1""")
def _(v):
    return O.coefficient_table(coefs(v).withColumnRenamed("feature", "feature_name"), O.preprocessing_table(long_matrix(v).filter("fold <> 1")))


@query("src8_reference_definition", "scheme n_A:i n_B:i threshold_global:i size_global:i size_A_specific:i", """
    select 'main' as scheme, n_neg as "n_A", n_pos as "n_B", greatest(3, ceil(cast(0.02 as double) * (n_neg + n_pos))) as threshold_global, size_global, size_neg_specific as "size_A_specific" from set_sizes, cohort_n""")
def _(v):
    d = P.reference_definition(reference(v), P.cohort_sizes(v.samples))
    return d.select("scheme", "n_A", "n_B", F.col("count_thresholds.global").alias("threshold_global"), F.col("set_sizes.global_public").alias("size_global"), F.col("set_sizes.A_specific_ref").alias("size_A_specific"))


@query("flow_locked_test_report", "roc_auc:6 pr_auc:6 brier_score:6 TN:i FP:i FN:i TP:i", f"""
    with s as (select sample_id, max(y) as y, 1 / (1 + exp(-(sum(c.coefficient * (l.value - t.mean) / t.sd) - 0.1))) as p from matrix_long l join (values {_coef_values}) c(feature, coefficient) on l.feature = c.feature
      join train_stats t on t.feature = l.feature and t.task_fold = 1 where l.fold = 1 group by 1), q as (select sample_id, y, round(p, 9) as p from s)
    select c.*, r.*, (select avg((p - y) * (p - y)) from q) as brier_score from ({confusion_sql('q', '')}) c, ({ranking_sql('q', '')}) r""")
def _(v):
    long = long_matrix(v).filter(F.col("feature").isin(list(COEF)))
    locked = O.preprocessing_table(long.filter("fold <> 1"))
    scored = O.locked_score(long.filter("fold = 1"), locked, coefs(v), -0.1, ["sample_id", "y"], 0.5).withColumn("p", F.round("p", 9))
    return M.full_metrics(scored, [], predicted=M.at_threshold("p", 0.5))
