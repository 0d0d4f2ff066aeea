"""Checked queries: whole stages (compositions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonespan.operators import features as X
from clonespan.operators import modeling as O
from clonespan.operators import public as P
from clonespan.plans import flows as W

from .q_clones import CLONE_SPEC
from .q_features import KEY, spec, summary
from .q_metrics import MODELS
from .q_models import COEF, FOLDS, LEAD, NUM, cand_fits, cand_preds, coefs, long_matrix
from .q_public import MODEL_SPEC
from .q_splits import CANDS, FRAGMENTS, K, REPEATS, SEEDS, STRATA
from .registry import query
from .sql_public import MODEL, RATIO, SETS, flags_sql
from .sql_views import rule_sql


@query("flow1_clone_tables", CLONE_SPEC, "select * from aa_table_lines")
def _(v):
    return W.clone_tables(v.nt_lines)["clones"]


@query("flow2_sample_features", "sample_id columns:i " + spec(["Shannon", "Gini", "top10_cumulative_frequency", "mean_hydrophobicity"], 7), """
    select sample_id, 97 + 2 * least(100, (select count(*) from vocab where keep)) as columns, Shannon, Gini, top10_cumulative_frequency, mean_hydrophobicity from core""")
def _(v):
    m = W.sample_features(v.clones, summary(v), max_kmers=100)["matrix"]
    return m.withColumn("columns", F.lit(len(m.columns)))


@query("flow3_threshold_stability", "scheme category mean_set_size:8 median_jaccard_to_full:8 empty_rate:8", "select * from stb_overview")
def _(v):
    return W.threshold_stability(v.inc, v.samples, 6)["overview"]


@query("flow4_public_reference", "sample_id " + MODEL_SPEC, "select * from model_features")
def _(v):
    return W.apply_reference(v.inc, W.public_reference(v.inc, v.samples)["reference"])["features"]


@query("flow5_feature_matrices", "sample_id cohort batch Shannon:8 all_ref_public_clone_ratio:8 B_A_specific_ref_frequency_log_ratio:6", """
    select s.sample_id, s.cohort, s.batch, d.Shannon, m.all_ref_public_clone_ratio, m."B_A_specific_ref_frequency_log_ratio" from samples s join inc_diversity d on s.sample_id = d.sample_id join model_features m on m.sample_id = s.sample_id""")
def _(v):
    ref = W.public_reference(v.inc, v.samples)
    applied = W.apply_reference(v.inc, ref["reference"])
    return W.feature_matrices(v.samples, X.diversity(v.inc, KEY).drop("aa_clone_number"), ref["descriptive"], applied["features"])["final"]


@query("flow6_nested_schedule", "outer_repeat:i outer_fold:i inner_fold:i sample_id", "select * from inner_rows")
def _(v):
    return W.nested_schedule(v.subjects, K, REPEATS, CANDS, 3)["inner"]


FRAGMENTS["task_rows"] = f"select s.*, r.outer_repeat, (s.sample_id // r.outer_repeat) % 4 + 1 as outer_fold from samples s, range(1, 3) r(outer_repeat)"
FRAGMENTS["task_counts"] = """
select m.outer_repeat, t.task_fold, cdr3_aa, count(*) filter (cohort = 'A') as neg_count, count(*) filter (cohort = 'B') as pos_count from inc i join task_rows m on i.sample_id = m.sample_id, range(1, 5) t(task_fold) where m.outer_fold <> t.task_fold group by 1, 2, 3
"""
FRAGMENTS["task_n"] = "select m.outer_repeat, t.task_fold, count(*) filter (cohort = 'A') as n_neg, count(*) filter (cohort = 'B') as n_pos from task_rows m, range(1, 5) t(task_fold) where m.outer_fold <> t.task_fold group by 1, 2"
FRAGMENTS["task_flagged"] = f"select c.*, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from task_counts c join task_n n on c.outer_repeat = n.outer_repeat and c.task_fold = n.task_fold"
FRAGMENTS["task_sizes"] = "select outer_repeat, task_fold, " + ", ".join(f"count(*) filter (\"{s}\") as size_{s}" for s in SETS) + " from task_flagged group by 1, 2"
_ext = ", ".join(
    f"count(*) filter (f.\"{s}\") as {p}_clone_number, count(*) filter (f.\"{s}\") / count(*) as {p}_clone_ratio, coalesce(sum(frequency_norm) filter (f.\"{s}\"), 0) as {p}_frequency_sum, "
    f"case when max(z.size_{s}) = 0 then 0.0 else count(*) filter (f.\"{s}\") / max(z.size_{s}) end as {p}_set_coverage" for s, p in MODEL.items())


def task_rows(v):
    rows = v.samples.select("*", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("outer_repeat"))
    return rows.withColumn("outer_fold", (F.floor(F.col("sample_id") / F.col("outer_repeat")) % 4 + 1).cast("int"))


@query("flow7_task_public_features", "outer_repeat:i task_fold:i sample_id " + " ".join(f"{n}:8" for n in P.reference_feature_names()), f"""
    select *, {RATIO} from (select m.outer_repeat, m.outer_fold as task_fold, i.sample_id, {_ext} from inc i join task_rows m on i.sample_id = m.sample_id join task_sizes z on z.outer_repeat = m.outer_repeat and z.task_fold = m.outer_fold
      left join task_flagged f on f.outer_repeat = m.outer_repeat and f.task_fold = m.outer_fold and f.cdr3_aa = i.cdr3_aa group by 1, 2, 3) x""")
def _(v):
    return W.public_features_of_tasks(v.inc, task_rows(v), 4)["external"]


@query("flow7_task_leave_one_out", "outer_repeat:i task_fold:i sample_id " + " ".join(f"{n}:8" for n in P.reference_feature_names()))
def _(v):
    return W.public_features_of_tasks(v.inc, task_rows(v), 4)["leave_one_out"]


@query("flow7_outer_task", "sample_id y:i p:6 threshold:6 predicted_label:i")
def _(v):
    rows = v.matrix.withColumn("inner_fold", F.floor(F.col("sample_id") / 5) % 2 + 1)
    return W.outer_task(rows, "fold", 1, 2, [O.Candidate(0.5, 1.0), O.Candidate(0.5, 10.0)], NUM, ["sex", "material"])["predictions"]


@query("flow8_collected_analysis", "metric model_a model_b statistic:4 p_value_raw:8 p_value_holm:8")
def _(v):
    return W.collected_analysis(v.preds, v.coefs, v.params, MODELS, 100, {}, 200)["tests"]


@query("flow9_final_selection", "rule threshold:8", f"""
    with chosen as (select * from cand_summary where all_fits_converged and mean_repeat_roc_auc >= (select mean_repeat_roc_auc - se_repeat_roc_auc from cand_summary where all_fits_converged order by {LEAD} limit 1) - 1e-12
        order by mean_nonzero_coefficients, round(mean_repeat_pr_auc, 12) desc, "lambda" desc, l1_ratio_alpha desc limit 1),
      mine as (select m.sample_id, m.y, m.p from cand_means m join chosen c on m.l1_ratio_alpha = c.l1_ratio_alpha and m."lambda" = c."lambda")
    select * from ({rule_sql('mine', '')}) r""")
def _(v):
    preds = cand_preds(v)
    return W.final_selection(preds, cand_fits(preds))["thresholds"]


@query("flow10_locked_test", "sample_id y:i p:8 predicted_label:i", f"""
    select sample_id, y, 1 / (1 + exp(-(s - 0.1))) as p, case when 1 / (1 + exp(-(s - 0.1))) >= 0.5 then 1 else 0 end as predicted_label from (
      select l.sample_id, max(y) as y, sum(c.coefficient * (l.value - t.mean) / t.sd) as s from matrix_long l join (values {", ".join(f"('{n}', cast({c} as double))" for n, c in COEF.items())}) c(feature, coefficient) on l.feature = c.feature
      join train_stats t on t.feature = l.feature and t.task_fold = {FOLDS} where l.fold = {FOLDS} group by 1) x""")
def _(v):
    long = long_matrix(v).filter(F.col("feature").isin(list(COEF)))
    pre = O.preprocessing_table(long.filter(F.col("fold") != FOLDS))
    return W.locked_test(long.filter(F.col("fold") == FOLDS), pre, coefs(v), -0.1, 0.5, 20)["predictions"]


@query("flow11_train_test_split", "sample_id split", "select r.sample_id, r.split from split_rows r join best_seed b on r.seed = b.seed")
def _(v):
    return W.train_test_split(v.subjects, STRATA, range(1, SEEDS + 1))["split"]


