"""Checked queries: splits, folds, schedules and stability of reference sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonespan.operators import joins as J
from clonespan.operators import public as P
from clonespan.operators import splits as L
from clonespan.operators import stability as B
from clonespan.session import materialize

from .registry import query
from .sql_public import MODEL, flags_sql
from .sql_views import FRAGMENTS

SEEDS, ITER = 20, 6
STRATA = ["cohort", "batch"]

FRAGMENTS["split_rows"] = f"""
select *, case when n = 1 then 'train' when position < least(greatest(floor(n * cast(0.7 as double) + 0.5), 1), n - 1) then 'train' else 'test' end as split
from (select t.seed, s.*, count(*) over (partition by t.seed, cohort, batch) as n, row_number() over (partition by t.seed, cohort, batch order by md5(t.seed || '|' || sample_id), sample_id) - 1 as position
      from subjects s, range(1, {SEEDS + 1}) t(seed)) x
"""
_specs = " union all ".join(
    f"select seed, split, '{n}' as spec, {w} as weight, {' || chr(124) || '.join(cols)} as category from split_rows" for n, cols, w in L.DISTRIBUTIONS)
_pen = "case spec " + " ".join(f"when '{s}' then {p}" for s, p in L.MISSING_PENALTIES.items()) + " else 0 end"
FRAGMENTS["split_counts"] = f"select seed, spec, weight, category, count(*) filter (split = 'train') as a, count(*) filter (split = 'test') as b from ({_specs}) s group by all"
FRAGMENTS["split_totals"] = "select seed, count(*) filter (split = 'train') as nt, count(*) filter (split = 'test') as ns from split_rows group by 1"


def score_sql(aware: bool) -> str:
    miss = "b = 0 and a + b >= 2" if aware else "b = 0"
    devs = ", ".join(f"max(dev) filter (spec = '{n}') as dev_{n}" for n, _, _ in L.DISTRIBUTIONS)
    return f"""
select seed, nt as n_train, ns as n_test, nt / (nt + ns) as actual_train_ratio, sum(weight * dev) / sum(weight) as base_score, {devs}, sum(cp) as missing_test_category_penalty, sum(np) as missing_nonrare_cohort_batch_penalty,
  sum(weight * dev) / sum(weight) + sum(cp) + sum(np) as score, abs(nt / (nt + ns) - cast(0.7 as double)) as ratio_deviation
from (select c.seed, spec, weight, nt, ns, 50 * (sum(abs(a / nt - (a + b) / (nt + ns))) / 2 + sum(abs(b / ns - (a + b) / (nt + ns))) / 2) as dev, sum(case when {miss} then {_pen} else 0 end) as cp,
        sum(case when spec = 'cohort_x_batch' and b = 0 and a + b >= 2 then 100 else 0 end) as np
      from split_counts c join split_totals t on c.seed = t.seed group by all) d group by seed, nt, ns"""


FRAGMENTS["split_scores"] = score_sql(False)
FRAGMENTS["best_seed"] = "select arg_min(seed, struct_pack(a := round(score, 10), b := round(ratio_deviation, 10), c := seed)) as seed from split_scores"


def split_rows(v):
    return L.stratified_split(v.subjects, STRATA, range(1, SEEDS + 1))


def one_split(v):
    return L.stratified_split(v.subjects, STRATA, range(7, 8))


@query("spl1_stratified_split", "seed:i sample_id split", "select seed, sample_id, split from split_rows")
def _(v):
    return split_rows(v)


SCORE_SPEC = "seed:i n_train:i n_test:i actual_train_ratio:8 base_score:6 missing_test_category_penalty:4 missing_nonrare_cohort_batch_penalty:4 score:6 " + " ".join(f"dev_{n}:6" for n, _, _ in L.DISTRIBUTIONS)


@query("spl2_seed_search", "seed:i score:6 rank:i is_selected_best:b", """
    select s.seed, s.score, rank() over (order by round(s.score, 10)) as rank, s.seed = b.seed as is_selected_best from split_scores s, best_seed b""")
def _(v):
    return L.ranked_seeds(L.split_scores(split_rows(v)))


@query("spl3_imbalance_score", SCORE_SPEC, "select * from split_scores")
def _(v):
    return L.split_scores(split_rows(v))


@query("spl4_singleton_aware_score", SCORE_SPEC, score_sql(True))
def _(v):
    return L.split_scores(split_rows(v), singleton_aware=True)


@query("win4_min_rank", "seed:i rank:i", "select seed, rank() over (order by round(score, 10)) as rank from split_scores")
def _(v):
    return L.ranked_seeds(L.split_scores(split_rows(v)))


@query("spl5_split_integrity", "check_name violations:i", """
    select 'repeated_ids' as check_name, 0 as violations union all select 'ids_on_both_sides', 0 union all select 'uncovered_ids', (select count(*) from customer where c_acctbal < 0)
    union all select 'patients_on_both_sides', count(*) from (select patient from (select cast(sample_id as bigint) // 2 as patient, split, sample_id from split_rows where seed = 7) s join customer c on c.c_custkey = s.sample_id where c_acctbal >= 0 group by 1 having count(distinct split) > 1) x""")
def _(v):
    poor = v.table("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("sample_id"))
    a = one_split(v).join(poor, "sample_id", "left_anti").withColumn("patient", F.floor(F.col("sample_id") / 2))
    return L.split_integrity(v.subjects, a)


@query("spl6_distribution_table", "category overall_n:i overall_pct:6 train_n:i train_pct:6 test_n:i test_pct:6", """
    select cohort || ' || ' || material as category, count(*) as overall_n, 100 * count(*) / max(t) as overall_pct, count(*) filter (split = 'train') as train_n, 100 * count(*) filter (split = 'train') / max(nt) as train_pct,
      count(*) filter (split = 'test') as test_n, 100 * count(*) filter (split = 'test') / max(ns) as test_pct from split_rows r, (select nt, ns, nt + ns as t from split_totals where seed = 7) z where r.seed = 7 group by 1""")
def _(v):
    return L.distribution_table(one_split(v), ["cohort", "material"])


@query("spl7_strata_status", "stratum total_n:i train_n:i test_n:i warning", """
    select *, case when total_n = 1 then 'singleton: cannot be on both sides' when train_n = 0 or test_n = 0 then 'missing from one side' when test_n = 1 then 'fragile: one test row' else '' end as warning from (
     select cohort || ' || ' || age as stratum, count(*) as total_n, count(*) filter (split = 'train') as train_n, count(*) filter (split = 'test') as test_n from split_rows where seed = 7 group by 1) x""")
def _(v):
    return L.strata_status(one_split(v), ["cohort", "age"])


# -- folds: 12 candidates, 5 folds, 3 repeats ---------------------------------------------------------------------------

K, CANDS, REPEATS = 5, 12, 3
FRAGMENTS["fold_rows"] = f"""
select candidate, x.*, (position + offs) % {K} + 1 as fold from (
  select t.candidate, s.*, row_number() over (partition by t.candidate, s.cohort order by md5('1|' || t.candidate || '|' || sample_id), sample_id) - 1 as position from subjects s, range(1, {CANDS + 1}) t(candidate)) x
join (select cohort, coalesce(sum(n) over (order by n desc, cohort rows between unbounded preceding and 1 preceding), 0) as offs from (select cohort, count(*) as n from subjects group by 1) c) o on x.cohort = o.cohort
"""


def fold_score_sql(table: str, keys: str) -> str:
    parts = [f"select {keys}, fold, '__size__' as variable, 'all' as category, 0.25 as weight from {table}"]
    for name, w in L.BALANCE_WEIGHTS.items():
        parts.append(f"select {keys}, fold, '{name}', {name}, {w} from {table}")
        parts.append(f"select {keys}, fold, 'cohort|{name}', cohort || '|' || {name}, {1.5 * w} from {table}")
    return f"""
select {keys}, sum(weight * term) as score from (
  select {keys}, variable, category, weight, sum(power((coalesce(n, 0) - e) / greatest(e, 1.0), 2)) as term from (
    select g.*, f.fold, c.n, g.total / {K}.0 as e from (select {keys}, variable, category, weight, count(*) as total from ({' union all '.join(parts)}) u group by all) g
    cross join range(1, {K + 1}) f(fold)
    left join (select {keys}, variable, category, fold, count(*) as n from ({' union all '.join(parts)}) u group by all) c
      on c.variable = g.variable and c.category = g.category and c.fold = f.fold and {' and '.join(f'c.{k} = g.{k}' for k in keys.split(', '))}) y group by all) z group by all"""


FRAGMENTS["fold_scored"] = fold_score_sql("fold_rows", "candidate")
FRAGMENTS["fold_ranked"] = "select candidate, score, row_number() over (order by round(score, 9), candidate) as repeat from fold_scored"
FRAGMENTS["outer_pool"] = f"""
select outer_repeat, candidate, x.*, (position + offs) % {K} + 1 as fold from (
  select r.outer_repeat, t.candidate, s.*, row_number() over (partition by r.outer_repeat, t.candidate, s.cohort order by md5('1|' || r.outer_repeat || '|' || t.candidate || '|' || sample_id), sample_id) - 1 as position
  from subjects s, range(1, {REPEATS + 1}) r(outer_repeat), range(1, {CANDS + 1}) t(candidate)) x
join (select cohort, coalesce(sum(n) over (order by n desc, cohort rows between unbounded preceding and 1 preceding), 0) as offs from (select cohort, count(*) as n from subjects group by 1) c) o on x.cohort = o.cohort
"""
FRAGMENTS["outer_scored"] = fold_score_sql("outer_pool", "outer_repeat, candidate")
FRAGMENTS["outer_best"] = "select outer_repeat, candidate from (select *, row_number() over (partition by outer_repeat order by round(score, 9), candidate) as r from outer_scored) x where r = 1"
FRAGMENTS["outer_rows"] = "select p.*, p.fold as outer_fold from outer_pool p join outer_best b on p.outer_repeat = b.outer_repeat and p.candidate = b.candidate"
FRAGMENTS["training_rows"] = f"select o.outer_repeat, t.task_fold, o.sample_id, o.cohort, o.batch, o.material, o.sex from outer_rows o, range(1, {K + 1}) t(task_fold) where o.outer_fold <> t.task_fold"
FRAGMENTS["inner_pool"] = f"""
select x.*, (position + offs) % {K} + 1 as fold from (
  select c.candidate, s.*, row_number() over (partition by outer_repeat, task_fold, c.candidate, cohort order by md5('1|' || outer_repeat || '|' || task_fold || '|' || c.candidate || '|' || sample_id), sample_id) - 1 as position
  from training_rows s, range(1, 4) c(candidate)) x
join (select outer_repeat, task_fold, cohort, coalesce(sum(n) over (partition by outer_repeat, task_fold order by n desc, cohort rows between unbounded preceding and 1 preceding), 0) as offs
      from (select outer_repeat, task_fold, cohort, count(*) as n from training_rows group by all) c) o on x.outer_repeat = o.outer_repeat and x.task_fold = o.task_fold and x.cohort = o.cohort
"""
FRAGMENTS["inner_scored"] = fold_score_sql("inner_pool", "outer_repeat, task_fold, candidate")
FRAGMENTS["inner_best"] = "select * from (select *, row_number() over (partition by outer_repeat, task_fold order by round(score, 9), candidate) as rn from inner_scored) x where rn = 1"
FRAGMENTS["inner_rows"] = """
select p.outer_repeat, p.task_fold as outer_fold, p.sample_id, p.cohort, p.fold as inner_fold from inner_pool p join inner_best b on p.outer_repeat = b.outer_repeat and p.task_fold = b.task_fold and p.candidate = b.candidate
"""


def pool(v):
    return L.fold_candidates(v.subjects, [], K, CANDS)


def outer(v):
    return materialize(L.outer_schedule(v.subjects, K, REPEATS, CANDS))


def inner(v, rows=None):
    return L.inner_schedule(rows or outer(v), K, 3)


@query("spl8_fold_candidates", "candidate:i sample_id fold:i", "select candidate, sample_id, fold from fold_rows")
def _(v):
    return pool(v)


@query("spl9_fold_scores", "candidate:i score:8", "select * from fold_scored")
def _(v):
    return L.fold_scores(pool(v), ["candidate"], K)


@query("spl10_best_distinct", "candidate:i repeat:i score:8", f"select * from fold_ranked where repeat <= {REPEATS}")
def _(v):
    return L.best_distinct(pool(v), [], K, REPEATS)


@query("spl11_outer_schedule", "outer_repeat:i outer_fold:i sample_id", "select * from outer_rows")
def _(v):
    return outer(v)


@query("spl11_inner_schedule", "outer_repeat:i outer_fold:i inner_fold:i sample_id", "select * from inner_rows")
def _(v):
    return inner(v)


@query("spl12_outer_tasks", "outer_repeat:i task_fold:i sample_id role", f"""
    select outer_repeat, t.task_fold, sample_id, case when outer_fold = t.task_fold then 'validation' else 'training' end as role from outer_rows, range(1, {K + 1}) t(task_fold)""")
def _(v):
    return L.outer_tasks(outer(v), K)


@query("spl13_balance_table", "outer_repeat:i fold:i variable category count:i fold_size:i proportion_within_fold:8", f"""
    with long as (select outer_repeat, outer_fold, '__fold__' as variable, 'all' as category from outer_rows union all select outer_repeat, outer_fold, 'material', material from outer_rows union all select outer_repeat, outer_fold, 'batch', batch from outer_rows)
    select g.outer_repeat, f.fold, g.variable, g.category, coalesce(c.n, 0) as count, s.n as fold_size, coalesce(c.n, 0) / s.n as proportion_within_fold
    from (select distinct outer_repeat, variable, category from long) g cross join range(1, {K + 1}) f(fold)
    left join (select outer_repeat, outer_fold, variable, category, count(*) as n from long group by all) c on c.outer_repeat = g.outer_repeat and c.outer_fold = f.fold and c.variable = g.variable and c.category = g.category
    join (select outer_repeat, outer_fold, count(*) as n from outer_rows group by all) s on s.outer_repeat = g.outer_repeat and s.outer_fold = f.fold""")
def _(v):
    return L.balance_table(outer(v), ["outer_repeat"], "outer_fold", K, ["material", "batch"])


@query("spl14_schedule_violations", "check_name violations:i", " union all ".join(
    f"select '{c}' as check_name, (select count(*) from subjects where sample_id < 0) as violations" for c in (
        "sample_not_once_per_repeat", "fold_missing", "label_counts_uneven", "partition_repeated", "validation_row_in_inner", "training_row_not_in_inner", "inner_row_repeated")))
def _(v):
    rows = outer(v)
    return L.schedule_violations(rows, materialize(inner(v, rows)), K)


@query("spl15_schedule_alignment", "sample_id column_name a b", """
    select sample_id, 'batch' as column_name, batch as a, batch || 'x' as b from subjects where age = 33 union all select sample_id, 'sex', sex, null from subjects where age = 44""")
def _(v):
    other = v.subjects.select("sample_id", F.when(F.col("age") == 33, F.concat("batch", F.lit("x"))).otherwise(F.col("batch")).alias("batch"), F.when(F.col("age") != 44, F.col("sex")).alias("sex"), "cohort")
    return J.null_safe_differences(v.subjects, other, "sample_id", ["cohort", "batch", "sex"])


@query("spl16_round_robin", "sample_id fold:i", f"""
    select sample_id, (row_number() over (partition by cohort order by md5('1|' || sample_id), sample_id) - 1 + cast('0x' || substr(md5('1|' || cohort), 1, 8) as bigint) % {K}) % {K} + 1 as fold from subjects""")
def _(v):
    return L.round_robin_folds(v.subjects, K)


@query("spl19_task_roles", "sample_id outer_fold:i role", "select sample_id, outer_fold, case when outer_fold = 2 then 'validation' else 'training' end as role from outer_rows where outer_repeat = 1")
def _(v):
    return L.task_roles(outer(v), 1, 2)


# -- stability ---------------------------------------------------------------------------------------------------------

FRAGMENTS["stb_splits"] = f"""
select *, case when position < case when n = 1 then 1 else least(greatest(round_even(n * cast(0.8 as double), 0), 1), n - 1) end then 'reference' else 'held_out' end as role
from (select t.iteration, s.*, count(*) over (partition by t.iteration, cohort, batch) as n, row_number() over (partition by t.iteration, cohort, batch order by md5('1|' || t.iteration || '|' || sample_id), sample_id) - 1 as position
      from samples s, range(1, {ITER + 1}) t(iteration)) x
"""
FRAGMENTS["stb_counts"] = f"""
select g.iteration, c.cdr3_aa, c.neg_count as full_neg, c.pos_count as full_pos, coalesce(r.a, 0) as neg_count, coalesce(r.b, 0) as pos_count, z.n_neg, z.n_pos, n.n_neg as full_n_neg, n.n_pos as full_n_pos
from range(1, {ITER + 1}) g(iteration) cross join counts c cross join cohort_n n
join (select iteration, count(*) filter (cohort = 'A') as n_neg, count(*) filter (cohort = 'B') as n_pos from stb_splits where role = 'reference' group by 1) z on z.iteration = g.iteration
left join (select s.iteration, i.cdr3_aa, count(*) filter (s.cohort = 'A') as a, count(*) filter (s.cohort = 'B') as b from inc i join stb_splits s on i.sample_id = s.sample_id where s.role = 'reference' group by 1, 2) r
  on r.iteration = g.iteration and r.cdr3_aa = c.cdr3_aa
"""
FRAGMENTS["stb_flags"] = " union all ".join(
    f"select iteration, '{s}' as scheme, cdr3_aa, full_neg, full_pos, n_neg, n_pos, full_n_neg, full_n_pos, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos', s, '_r')}, {flags_sql('full_neg', 'full_pos', 'full_n_neg', 'full_n_pos', s, '_f')} from stb_counts"
    for s in ("loose", "main", "strict"))
CATS = {"global": "global_public", "neg_specific": "A_specific", "pos_specific": "B_specific", "shared": "shared"}
FRAGMENTS["stb_table"] = "select iteration, scheme, " + ", ".join(
    f"count(*) filter ({m}_r) as {c}_set_size, count(*) filter ({m}_f) as {c}_full_set_size, case when count(*) filter ({m}_r or {m}_f) = 0 then 1.0 else count(*) filter ({m}_r and {m}_f) / count(*) filter ({m}_r or {m}_f) end as {c}_jaccard_to_full"
    for m, c in CATS.items()) + " from stb_flags group by 1, 2"
_held = ", ".join(f"count(*) filter (f.{m}_r) as {p}_clone_number, count(*) filter (f.{m}_r) / count(*) as {p}_clone_ratio, coalesce(sum(frequency_norm) filter (f.{m}_r), 0) as {p}_frequency_sum" for m, p in MODEL.items())
FRAGMENTS["stb_held"] = f"""
select *, B_specific_ref_frequency_sum - A_specific_ref_frequency_sum as B_A_specific_ref_frequency_delta, ln((B_specific_ref_frequency_sum + 1e-8) / (A_specific_ref_frequency_sum + 1e-8)) as B_A_specific_ref_frequency_log_ratio
from (select s.iteration, f.scheme, s.sample_id, s.cohort, s.batch, {_held} from inc i join stb_splits s on i.sample_id = s.sample_id and s.role = 'held_out' join stb_flags f on f.iteration = s.iteration and f.cdr3_aa = i.cdr3_aa group by 1, 2, 3, 4, 5) x
"""
_feat = B.feature_names()
FRAGMENTS["stb_long"] = "select iteration, scheme, sample_id, cohort, batch, feature, value from (unpivot (select iteration, scheme, sample_id, cohort, batch, " + ", ".join(f'cast({f} as double) as "{f}"' for f in _feat) + " from stb_held) on " + ", ".join(f'"{f}"' for f in _feat) + " into name feature value value)"
FRAGMENTS["stb_sample"] = """
select *, case when abs(mean) > 1e-12 then sd / abs(mean) end as cv from (select scheme, sample_id, cohort, batch, feature, count(*) as repeat_count, avg(value) as mean, quantile_cont(value, 0.5) as median, stddev_pop(value) as sd,
  avg(case when abs(value) <= 1e-8 then 1.0 else 0.0 end) as zero_rate, min(value) as min, max(value) as max from stb_long group by 1, 2, 3, 4, 5) x
"""
_over = " union all ".join(f"select scheme, '{c}' as category, {c}_set_size as size, {c}_full_set_size as full_size, {c}_jaccard_to_full as jaccard from stb_table" for c in CATS.values())
FRAGMENTS["stb_overview"] = f"""
select *, case when mean_set_size > 0 then sd_set_size / mean_set_size end as cv_set_size from (select scheme, category, max(full_size) as full_train_set_size, avg(size) as mean_set_size, quantile_cont(size, 0.5) as median_set_size, stddev_pop(size) as sd_set_size,
  quantile_cont(size, 0.25) as q1_set_size, quantile_cont(size, 0.75) as q3_set_size, min(size) as min_set_size, max(size) as max_set_size, avg(case when size = 0 then 1.0 else 0.0 end) as empty_rate,
  avg(jaccard) as mean_jaccard_to_full, quantile_cont(jaccard, 0.5) as median_jaccard_to_full, min(jaccard) as min_jaccard_to_full, max(jaccard) as max_jaccard_to_full
  from (select scheme, category, cast(size as double) as size, full_size, cast(jaccard as double) as jaccard from ({_over}) o) y group by 1, 2) z
"""
FRAGMENTS["stb_features"] = """
select l.*, s.median_within_sample_cv, s.median_within_sample_zero_rate from (select scheme, feature, count(*) as oof_observation_count, avg(case when abs(value) > 1e-8 then 1.0 else 0.0 end) as nonzero_rate, avg(value) as mean, stddev_pop(value) as sd,
  min(value) as min, max(value) as max, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from stb_long group by 1, 2) l
join (select scheme, feature, quantile_cont(cv, 0.5) as median_within_sample_cv, quantile_cont(zero_rate, 0.5) as median_within_sample_zero_rate from stb_sample group by 1, 2) s on l.scheme = s.scheme and l.feature = s.feature
"""


def subsamples(v):
    return B.reference_subsamples(v.samples, ITER)


def labelled(v):
    return v.inc.join(v.samples.select("sample_id", "cohort", "batch"), "sample_id")


def flags(v):
    return B.iteration_flags(B.iteration_counts(labelled(v), subsamples(v), ITER, min_count=min(min(s.global_min_count, s.group_min_count) for s in B.SCHEMES)), subsamples(v), v.samples)


def held(v):
    return B.held_out_features(labelled(v), flags(v), subsamples(v))


def table(v):
    return B.iteration_table(flags(v), subsamples(v))


@query("stb1_reference_subsamples", "iteration:i sample_id role", "select iteration, sample_id, role from stb_splits")
def _(v):
    return subsamples(v)


SIZE_SPEC = "iteration:i scheme " + " ".join(f"{c}_set_size:i {c}_full_set_size:i" for c in CATS.values())


@query("stb2_iteration_sizes", SIZE_SPEC, "select * from stb_table")
def _(v):
    return table(v)


@query("stb3_jaccard_to_full", "iteration:i scheme " + " ".join(f"{c}_jaccard_to_full:8" for c in CATS.values()), "select * from stb_table")
def _(v):
    return table(v)


@query("stb4_held_out_features", "iteration:i scheme sample_id cohort batch " + " ".join(f"{f}:8" for f in _feat), "select * from stb_held")
def _(v):
    return held(v)


@query("stb5_stability_overview", "scheme category full_train_set_size:i mean_set_size:8 median_set_size:8 sd_set_size:8 q1_set_size:8 q3_set_size:8 min_set_size:i max_set_size:i cv_set_size:8 empty_rate:8 mean_jaccard_to_full:8 median_jaccard_to_full:8 min_jaccard_to_full:8 max_jaccard_to_full:8", "select * from stb_overview")
def _(v):
    return B.stability_overview(table(v))


@query("stb6_sample_stability", "scheme sample_id cohort batch feature repeat_count:i mean:8 median:8 sd:8 zero_rate:8 min:8 max:8", "select * from stb_sample")
def _(v):
    return B.sample_stability(held(v))


@query("stb7_feature_overview", "scheme feature oof_observation_count:i nonzero_rate:8 mean:8 sd:8 min:8 max:8 q1:8 median:8 q3:8 median_within_sample_zero_rate:8", "select * from stb_features")
def _(v):
    h = materialize(held(v))
    return B.feature_overview(h, B.sample_stability(h))


SELECT_SQL = "select scheme, cdr3_aa, " + ", ".join(f"count(*) filter ({m}_r) as {c}_selection_count" for m, c in CATS.items()) + \
    f", greatest({', '.join(f'count(*) filter ({m}_r)' for m in CATS)}) / {ITER} as max_selection_frequency, max(case when neg_specific_f then 'A_specific' when pos_specific_f then 'B_specific' when shared_f then 'shared' when global_f then 'other_global_public' else 'not_public' end) as full_reference_category from stb_flags group by 1, 2"


@query("stb8_selection_frequency", "scheme cdr3_aa full_reference_category max_selection_frequency:8 " + " ".join(f"{c}_selection_count:i" for c in CATS.values()), f"select * from ({SELECT_SQL}) s where max_selection_frequency > 0")
def _(v):
    return B.selection_frequency(flags(v), ITER, v.samples)


@query("top2_most_selected_clones", "scheme cdr3_aa max_selection_frequency:8", f"select scheme, cdr3_aa, max_selection_frequency from (select *, row_number() over (partition by scheme order by max_selection_frequency desc, cdr3_aa) as rn from ({SELECT_SQL}) s where max_selection_frequency > 0) t where rn <= 40")
def _(v):
    return B.most_selected(B.selection_frequency(flags(v), ITER, v.samples), 40)


@query("flt9_empirical_screen", "scheme status reasons", """
    select *, case when reasons = '' then 'PASS_EMPIRICAL_SCREEN' else 'REVIEW' end as status from (
      select o.scheme, concat_ws('; ', case when ea > 0.05 then 'A_specific empty_rate=' || printf('%.3f', round(ea, 3)) || '>0.05' end, case when eb > 0.05 then 'B_specific empty_rate=' || printf('%.3f', round(eb, 3)) || '>0.05' end, case when jg < 0.5 then 'global_public median_jaccard=' || printf('%.3f', round(jg, 3)) || '<0.50' end,
        case when js < 0.5 then 'shared median_jaccard=' || printf('%.3f', round(js, 3)) || '<0.50' end, case when ja < 0.3 then 'A_specific median_jaccard=' || printf('%.3f', round(ja, 3)) || '<0.30' end, case when jb < 0.3 then 'B_specific median_jaccard=' || printf('%.3f', round(jb, 3)) || '<0.30' end,
        case when za < 0.2 then 'A_specific_ref_frequency_sum nonzero_rate=' || printf('%.3f', round(za, 3)) || '<0.20' end, case when zb < 0.2 then 'B_specific_ref_frequency_sum nonzero_rate=' || printf('%.3f', round(zb, 3)) || '<0.20' end) as reasons
      from (select scheme, max(empty_rate) filter (category = 'A_specific') as ea, max(empty_rate) filter (category = 'B_specific') as eb, max(median_jaccard_to_full) filter (category = 'global_public') as jg,
              max(median_jaccard_to_full) filter (category = 'shared') as js, max(median_jaccard_to_full) filter (category = 'A_specific') as ja, max(median_jaccard_to_full) filter (category = 'B_specific') as jb from stb_overview group by 1) o
      join (select scheme, max(nonzero_rate) filter (feature = 'A_specific_ref_frequency_sum') as za, max(nonzero_rate) filter (feature = 'B_specific_ref_frequency_sum') as zb from stb_features group by 1) z on o.scheme = z.scheme) x""")
def _(v):
    h = materialize(held(v))
    return B.screening(B.stability_overview(table(v)), B.feature_overview(h, B.sample_stability(h)))
