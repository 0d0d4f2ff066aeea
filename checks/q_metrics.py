"""Checked queries: classification metrics, thresholds, comparisons, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonespan.functions.scalars import order_hash
from clonespan.operators import comparison as K
from clonespan.operators import joins as J
from clonespan.operators import metrics as M

from .registry import query
from .sql_views import FRAGMENTS, confusion_sql, ranking_sql, rule_sql, threshold_sql

RATES = "TN:i FP:i FN:i TP:i accuracy:8 sensitivity_recall:8 specificity:8 precision:8 f1:8"
MODELS = ["M0", "M1", "M2", "M3"]
RK = ["outer_repeat", "model"]


def rep(v):
    return K.repeat_metrics(v.preds, RK, predicted=M.at_threshold("p", "threshold"))


def long(v):
    return K.long_metrics(rep(v), RK)


def paired(v):
    return K.paired_values(long(v), MODELS)


@query("eva1_confusion", RATES, confusion_sql("scored", ""))
def _(v):
    return M.confusion(v.scored, [], predicted=M.at_threshold("p", 0.5))


@query("eva1_confusion_by_fold", "outer_repeat outer_fold model " + RATES, confusion_sql("preds", "outer_repeat, outer_fold, model"))
def _(v):
    return M.confusion(v.preds, ["outer_repeat", "outer_fold", "model"], predicted=M.at_threshold("p", "threshold"))


@query("eva2_roc_auc", "roc_auc:8", ranking_sql("scored", ""))
def _(v):
    return M.ranking_metrics(v.scored, [])


@query("eva2_roc_auc_by_fold", "outer_repeat outer_fold model roc_auc:8", ranking_sql("preds", "outer_repeat, outer_fold, model"))
def _(v):
    return M.ranking_metrics(v.preds, ["outer_repeat", "outer_fold", "model"])


@query("eva3_pr_auc", "pr_auc:8", ranking_sql("scored", ""))
def _(v):
    return M.ranking_metrics(v.scored, [])


@query("eva4_brier", "model brier_score:8", "select model, avg((p - y) * (p - y)) as brier_score from preds group by 1")
def _(v):
    return M.brier(v.preds, ["model"])


@query("eva5_roc_curve", "threshold:8 fpr:8 tpr:8", f"select threshold, fpr, sensitivity_recall as tpr from ({threshold_sql('scored', '')}) t")
def _(v):
    return M.roc_curve(v.scored, [])


@query("eva6_pr_curve", "threshold:8 precision:8 recall:8", f"select threshold, \"precision\", sensitivity_recall as recall from ({threshold_sql('scored', '')}) t")
def _(v):
    return M.pr_curve(v.scored, [])


@query("eva7_youden", "model threshold:8", f"select * from ({rule_sql('preds', 'model')}) r where rule = 'youden'")
def _(v):
    return M.youden(M.threshold_table(v.preds, ["model"]), ["model"])


@query("eva8_max_f1", "model threshold:8", f"select * from ({rule_sql('preds', 'model')}) r where rule = 'max_f1'")
def _(v):
    return M.max_f1(M.threshold_table(v.preds, ["model"], extra=M.CANDIDATE_CUTS), ["model"])


@query("eva9_sensitivity_target", "model threshold:8", f"select * from ({rule_sql('preds', 'model')}) r where rule = 'sensitivity_target'")
def _(v):
    return M.sensitivity_target(M.threshold_table(v.preds, ["model"], extra=M.CANDIDATE_CUTS), ["model"])


@query("eva10_threshold_rules", "rule threshold:8 TP:i FP:i FN:i TN:i sensitivity_recall:8 specificity:8 precision:8 f1:8", f"""
    select r.rule, t.* from ({rule_sql('scored', '')}) r join ({threshold_sql('scored', '', True)}) t on r.threshold = t.threshold""")
def _(v):
    return M.threshold_rules(v.scored, [])


@query("eva11_repeat_thresholds", "outer_repeat rule threshold:8", f"""
    with m2 as (select * from preds where model = 'M2') select * from ({rule_sql('m2', 'outer_repeat')}) r""")
def _(v):
    return M.threshold_rules(v.preds.filter("model = 'M2'"), ["outer_repeat"])


@query("eva11_model_repeat_thresholds", "model outer_repeat rule threshold:8", f"select * from ({rule_sql('preds', 'model, outer_repeat')}) r")
def _(v):
    return M.threshold_rules(v.preds, ["model", "outer_repeat"])


@query("eva12_repeat_metrics", "outer_repeat model roc_auc:8 pr_auc:8 " + RATES, "select * from rep_metrics")
def _(v):
    return rep(v)


MEAN_REPS = 5000
BOOT_SQL = f"""
select x.*, b.ci_lower, b.ci_upper from (select model, metric, count(*) as n_repeats, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.25) as q1,
    quantile_cont(value, 0.75) as q3, min(value) as min, max(value) as max from rep_long group by 1, 2) x
join (select model, metric, quantile_cont(m, 0.025) as ci_lower, quantile_cont(m, 0.975) as ci_upper from (
    select d.model, d.metric, d.rep, avg(r.value) as m from (select model, metric, rep, cast('0x' || substr(md5('1|' || rep || '|' || draw), 1, 12) as bigint) % 20 as pos
        from (select distinct model, metric from rep_long) g, range(1, {MEAN_REPS + 1}) t(rep), range(0, 20) u(draw)) d
    join (select *, row_number() over (partition by model, metric order by outer_repeat) - 1 as pos from rep_long) r on r.model = d.model and r.metric = d.metric and r.pos = d.pos group by 1, 2, 3) e group by 1, 2) b
  on x.model = b.model and x.metric = b.metric"""


@query("eva13_performance_summary", "model metric n_repeats:i mean:8 sd:8 median:8 q1:8 q3:8 min:8 max:8 ci_lower:8 ci_upper:8", BOOT_SQL)
def _(v):
    return K.performance_summary(long(v), ["model", "metric"], MEAN_REPS)


@query("spl17_bootstrap_mean", "model metric ci_lower:8 ci_upper:8", BOOT_SQL)
def _(v):
    return K.bootstrap_mean(long(v), ["model", "metric"], "outer_repeat", MEAN_REPS)


@query("join9_model_pairs", "metric outer_repeat model_a model_b difference:8", "select * from paired")
def _(v):
    return paired(v)


PAIRED_SQL = """
select *, case when wins + losses = 0 then 0 else (wins - losses) / (wins + losses) end as rank_biserial_signs from (
 select metric, model_a, model_b, count(*) as n_repeats, avg(value_a) as mean_a, avg(value_b) as mean_b, avg(difference) as mean_difference, quantile_cont(difference, 0.5) as median_difference,
  quantile_cont(difference, 0.25) as q1_difference, quantile_cont(difference, 0.75) as q3_difference, count(*) filter (difference > 0) as wins, count(*) filter (difference = 0) as ties, count(*) filter (difference < 0) as losses
 from paired group by 1, 2, 3) s"""
PAIRED_SPEC = "metric model_a model_b n_repeats:i mean_a:8 mean_b:8 mean_difference:8 median_difference:8 q1_difference:8 q3_difference:8"


@query("eva14_paired_differences", PAIRED_SPEC, PAIRED_SQL)
def _(v):
    return K.paired_summary(paired(v))


@query("eva15_wilcoxon", "metric model_a model_b w_plus:4 w_minus:4 n_nonzero:i statistic:4", "select * from wilcoxon")
def _(v):
    return K.wilcoxon(paired(v))


LOWER_GAMMA = "list_sum(list_transform(range(0, 400), lambda i: exp(-h + (i + {a}) * ln(h) - lgamma(i + {a} + 1))))"
FRAGMENTS["signed_rank"] = """
select w.*, coalesce(t.tie, 0) as tie, z.n_zero from wilcoxon w
join (select metric, model_a, model_b, count(*) filter (round(difference, 12) = 0) as n_zero from paired group by 1, 2, 3) z on w.metric = z.metric and w.model_a = z.model_a and w.model_b = z.model_b
left join (select metric, model_a, model_b, sum(c * c * c - c) as tie from (select metric, model_a, model_b, a, count(*) as c from signed group by all) x group by 1, 2, 3) t
  on w.metric = t.metric and w.model_a = t.model_a and w.model_b = t.model_b
"""


@query("eva15_wilcoxon_p_values", "metric model_a model_b statistic:4 p_value_raw:10", f"""
    with recursive ways as (  -- subsets of the first k ranks by their sum
      select 0 as k, list_transform(range(0, 1276), lambda i: case when i = 0 then 1::bigint else 0::bigint end) as w
      union all select k + 1, list_transform(range(1, 1277), lambda i: w[i] + case when i > k + 1 then w[i - k - 1] else 0 end) from ways where k < 50),
    z as (select *, n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24 - tie / 48 as var from signed_rank),
    h as (select *, case when var > 0 then power(statistic - n_nonzero * (n_nonzero + 1) / 4, 2) / var / 2 else 0 end as h from z)
    select metric, model_a, model_b, statistic, case when n_nonzero = 0 then 1.0
      when tie = 0 and n_zero = 0 and n_nonzero <= 50 then least(1.0, 2.0 * list_sum(w[1 : floor(statistic)::int + 1]) / power(2, n_nonzero))
      when h <= 0 then 1.0 else 1 - {LOWER_GAMMA.format(a=0.5)} end as p_value_raw
    from h left join ways on k = n_nonzero""")
def _(v):
    return K.with_wilcoxon_p(K.wilcoxon(paired(v)))


FRAGMENTS["friedman_test"] = """
    with ranked as (select metric, outer_repeat, model, v, rank() over (partition by metric, outer_repeat order by v) + (count(*) over (partition by metric, outer_repeat, v) - 1) / 2 as r
      from (select *, round(value, 12) as v from rep_long) x),
    sums as (select metric, sum(s * s) as ss, max(n) as n from (select metric, model, sum(r) as s, count(*) as n from ranked group by 1, 2) y group by 1),
    tied as (select metric, sum(t * t * t - t) as tie from (select metric, outer_repeat, v, count(*) as t from ranked group by 1, 2, 3) z group by 1)
    select s.metric, n as n_repeats, case when 1 - tie / (n * 60) <= 0 then 0.0 else (12.0 / 20 * ss / n - 15 * n) / (1 - tie / (n * 60)) end as statistic from sums s join tied t on s.metric = t.metric"""


@query("eva16_friedman", "metric n_repeats:i statistic:6", "select * from friedman_test")
def _(v):
    return K.friedman(long(v), MODELS)


@query("eva16_friedman_p_values", "metric statistic:6 p_value:10", f"select metric, statistic, case when h <= 0 then 1.0 else 1 - {LOWER_GAMMA.format(a=1.5)} end as p_value from (select *, statistic / 2 as h from friedman_test) x")
def _(v):
    return K.with_chi_square_p(K.friedman(long(v), MODELS))


@query("eva17_holm", "metric model_a model_b p:8 p_value_holm:8", """
    select metric, model_a, model_b, p, least(1, max(s) over (partition by metric order by p, model_a, model_b rows unbounded preceding)) as p_value_holm
    from (select *, (count(*) over (partition by metric) - row_number() over (partition by metric order by p, model_a, model_b) + 1) * p as s
          from (select metric, model_a, model_b, (least(w_plus, w_minus) + 1) / 500 as p from wilcoxon) x) y""")
def _(v):
    w = K.wilcoxon(paired(v)).withColumn("p", (F.col("statistic") + 1) / 500)
    return K.holm(w, ["metric"], "p", ["model_a", "model_b"])


@query("eva18_rank_biserial", "metric model_a model_b rank_biserial:8 rank_biserial_signs:8", f"""
    select w.metric, w.model_a, w.model_b, rank_biserial, rank_biserial_signs from wilcoxon w join ({PAIRED_SQL}) s on w.metric = s.metric and w.model_a = s.model_a and w.model_b = s.model_b""")
def _(v):
    p = paired(v)
    return K.wilcoxon(p).join(K.paired_summary(p), K.PAIR)


@query("eva19_sample_means", "model sample_id true_label:i mean_probability:8 sd_probability:8 median_probability:8 min_probability:8 max_probability:8 n_predictions:i predicted_label:i", """
    select model, sample_id, max(y) as true_label, avg(p) as mean_probability, stddev_samp(p) as sd_probability, quantile_cont(p, 0.5) as median_probability, min(p) as min_probability, max(p) as max_probability,
      count(*) as n_predictions, case when avg(p) >= 0.45 then 1 else 0 end as predicted_label from preds group by 1, 2""")
def _(v):
    return K.sample_means(v.preds, ["model", "sample_id"], 0.45)


REPS = 50
BOOT_CTE = f"""
with placed as (select *, row_number() over (partition by y order by md5('1|' || sample_id), sample_id) - 1 as pos from scored), n as (select y, count(*) as n from scored group by 1),
drawn as (select d.rep, d.y, p.p from (select rep, x.y, cast('0x' || substr(md5('1|' || rep || '|' || x.y || '|' || x.pos), 1, 12) as bigint) % n.n as pos from placed x join n on x.y = n.y, range(1, {REPS + 1}) t(rep)) d
  join placed p on p.y = d.y and p.pos = d.pos),
metrics as (select c.*, r.roc_auc, r.pr_auc, b.brier_score from ({confusion_sql('drawn', 'rep')}) c join ({ranking_sql('drawn', 'rep')}) r on c.rep = r.rep
  join (select rep, avg((p - y) * (p - y)) as brier_score from drawn group by 1) b on b.rep = c.rep)"""


@query("spl18_bootstrap_replicates", "rep " + " ".join(f"{m}:8" for m in K.BOOTSTRAP_METRICS), f"{BOOT_CTE} select * from metrics")
def _(v):
    return K.stratified_bootstrap(v.scored, REPS, 0.5)


@query("spl18_bootstrap_intervals", "metric mean:8 sd:8 ci_lower:8 ci_upper:8 n_valid:i", f"""{BOOT_CTE}
    select metric, avg(value) as mean, stddev_samp(value) as sd, quantile_cont(value, 0.025) as ci_lower, quantile_cont(value, 0.975) as ci_upper, count(*) as n_valid
    from (unpivot (select rep, roc_auc, pr_auc, cast(accuracy as double) as accuracy, cast(sensitivity_recall as double) as sensitivity_recall, cast(specificity as double) as specificity, cast("precision" as double) as "precision", cast(f1 as double) as f1, brier_score from metrics)
      on roc_auc, pr_auc, accuracy, sensitivity_recall, specificity, "precision", f1, brier_score into name metric value value) u group by 1""")
def _(v):
    return K.bootstrap_intervals(K.stratified_bootstrap(v.scored, REPS, 0.5))


@query("eva29_test_report", "model roc_auc:8 pr_auc:8 brier_score:8 " + RATES, f"""
    select c.*, r.roc_auc, r.pr_auc, b.brier_score from ({confusion_sql('preds', 'model')}) c join ({ranking_sql('preds', 'model')}) r on c.model = r.model
    join (select model, avg((p - y) * (p - y)) as brier_score from preds group by 1) b on c.model = b.model""")
def _(v):
    return M.full_metrics(v.preds, ["model"], predicted=M.at_threshold("p", "threshold"))


@query("eva29_confusion_matrix", "true_label predicted_label n:i", """
    select cast(y as varchar) as true_label, case when p >= 0.5 then '1' else '0' end as predicted_label, count(*) as n from scored group by 1, 2""")
def _(v):
    return M.score_class_report(M.confusion(v.scored, [], predicted=M.at_threshold("p", 0.5)))


@query("rsh1_widen", "metric outer_repeat M0:8 M1:8 M2:8 M3:8", """select metric, outer_repeat, max(value) filter (model = 'M0') as "M0", max(value) filter (model = 'M1') as "M1", max(value) filter (model = 'M2') as "M2", max(value) filter (model = 'M3') as "M3" from rep_long group by 1, 2""")
def _(v):
    return J.widen(long(v), ["metric", "outer_repeat"], "model", MODELS, "value")


@query("rsh2_lengthen", "outer_repeat model metric value:8", "select * from rep_long")
def _(v):
    return long(v)
