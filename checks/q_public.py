"""Checked queries: public clones, reference sets, leave-one-out and cross-fitted features."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonespan.operators import joins as J
from clonespan.operators import public as P
from clonespan.operators.clones import first_per_group

from .registry import query
from .sql_public import DESCRIPTIVE, MODEL, RATIO, SETS, flags_sql, overlap_sql

FEATURES = P.reference_feature_names()
MODEL_SPEC = " ".join(f"{n}:i" if n.endswith("number") else f"{n}:8" for n in FEATURES)
DESC_SPEC = " ".join(f"{p}_{m}" + (":i" if m == "clone_number" else ":8") for p in P.descriptive_prefixes().values() for m in P.MEASURES)


def counts(v):
    return P.presence_counts(P.with_cohort(v.inc, v.samples))


def reference(v, scheme=P.MAIN):
    return P.reference_table(counts(v), P.cohort_sizes(v.samples), [], scheme)


def descriptive(v):
    return P.overlap_features(v.inc, reference(v))


def folds(v):
    return v.samples.withColumn("fold", F.floor(F.col("sample_id") / 5) % 4 + 1)


@query("src7_incidence", "sample_id cdr3_aa frequency_norm:8", """
    select * from inc where cdr3_aa in (select cdr3_aa from inc group by 1 having count(*) >= 20)""")
def _(v):
    return P.incidence(v.inc, [], 20)


@query("flt5_candidate_clones", "cdr3_aa sample_count:i", "select cdr3_aa, count(*) as sample_count from inc group by 1 having count(*) >= 2")
def _(v):
    return P.candidates(v.inc, [], 2)


@query("pub1_presence_counts", "cdr3_aa neg_count:i pos_count:i", "select * from counts")
def _(v):
    return counts(v)


@query("pub2_frequency_sums", "cdr3_aa total:8 neg_freq:8 pos_freq:8", "select cdr3_aa, neg_freq + pos_freq as total, neg_freq, pos_freq from counts")
def _(v):
    return counts(v).select("cdr3_aa", (F.col("neg_freq") + F.col("pos_freq")).alias("total"), "neg_freq", "pos_freq")


CATALOG_SPEC = ("cdr3_aa total_sample_count:i total_sample_prevalence:8 A_sample_count:i A_sample_prevalence:8 B_sample_count:i B_sample_prevalence:8 prevalence_delta_B_minus_A:8 "
                "total_frequency_sum:8 total_mean_frequency_all_samples:10 total_mean_frequency_present_samples:10 A_frequency_sum:8 A_mean_frequency_all_A_samples:10 A_mean_frequency_present_A_samples:10 "
                "B_frequency_sum:8 B_mean_frequency_all_B_samples:10 B_mean_frequency_present_B_samples:10 is_global_public:i is_A_group_public:i is_B_group_public:i is_between_group_shared:i "
                "is_A_specific_ref:i is_B_specific_ref:i reference_category")
CATEGORY_SQL = "case when neg_specific then 'A_specific' when pos_specific then 'B_specific' when shared then 'shared' when \"global\" then 'other_global_public' else 'not_public' end"
CATALOG_SQL = f"""
select cdr3_aa, neg_count + pos_count as total_sample_count, (neg_count + pos_count) / (n_neg + n_pos) as total_sample_prevalence, neg_count as "A_sample_count", neg_count / n_neg as "A_sample_prevalence",
  pos_count as "B_sample_count", pos_count / n_pos as "B_sample_prevalence", pos_count / n_pos - neg_count / n_neg as "prevalence_delta_B_minus_A", neg_freq + pos_freq as total_frequency_sum,
  (neg_freq + pos_freq) / (n_neg + n_pos) as total_mean_frequency_all_samples, (neg_freq + pos_freq) / (neg_count + pos_count) as total_mean_frequency_present_samples,
  neg_freq as "A_frequency_sum", neg_freq / n_neg as "A_mean_frequency_all_A_samples", case when neg_count = 0 then 0 else neg_freq / neg_count end as "A_mean_frequency_present_A_samples",
  pos_freq as "B_frequency_sum", pos_freq / n_pos as "B_mean_frequency_all_B_samples", case when pos_count = 0 then 0 else pos_freq / pos_count end as "B_mean_frequency_present_B_samples",
  cast("global" as int) as is_global_public, cast(neg_group as int) as "is_A_group_public", cast(pos_group as int) as "is_B_group_public", cast(shared as int) as is_between_group_shared,
  cast(neg_specific as int) as "is_A_specific_ref", cast(pos_specific as int) as "is_B_specific_ref", {CATEGORY_SQL} as reference_category from flagged"""


@query("pub3_catalog", CATALOG_SPEC, CATALOG_SQL)
def _(v):
    return P.catalog(counts(v), P.cohort_sizes(v.samples))


@query("src10_reference_subset", "cdr3_aa total_sample_count:i reference_category", f"select * from ({CATALOG_SQL}) c where is_global_public = 1")
def _(v):
    return P.catalog(counts(v), P.cohort_sizes(v.samples)).filter("is_global_public = 1")


@query("pub4_scheme_thresholds", "scheme n_neg:i n_pos:i global_count_threshold:i A_count_threshold:i B_count_threshold:i", """
    select scheme, n_neg, n_pos, greatest(gc, ceil(gp * (n_neg + n_pos))) as global_count_threshold, greatest(c, ceil(p * n_neg)) as "A_count_threshold", greatest(c, ceil(p * n_pos)) as "B_count_threshold"
    from cohort_n, (values ('loose', cast(0.01 as double), 2, cast(0.03 as double), 2), ('main', cast(0.02 as double), 3, cast(0.05 as double), 3), ('strict', cast(0.05 as double), 5, cast(0.10 as double), 4)) t(scheme, gp, gc, p, c)""")
def _(v):
    return P.scheme_thresholds(P.cohort_sizes(v.samples))


@query("pub5_membership", "cdr3_aa " + " ".join(f"{s}:b" for s in P.ALL_SETS), "select * from flagged")
def _(v):
    return P.flagged(counts(v), P.cohort_sizes(v.samples))


@query("pub5_membership_strict", "cdr3_aa " + " ".join(f"{s}:b" for s in P.ALL_SETS), f"select cdr3_aa, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos', 'strict')} from counts, cohort_n")
def _(v):
    return P.flagged(counts(v), P.cohort_sizes(v.samples), [], P.SCHEMES[2])


@query("scl21_set_category", "reference_category n:i", f"select {CATEGORY_SQL} as reference_category, count(*) as n from flagged group by 1")
def _(v):
    return P.catalog(counts(v), P.cohort_sizes(v.samples)).groupBy("reference_category").agg(F.count(F.lit(1)).alias("n"))


@query("scl22_bit_mask", "cdr3_aa bits:i", "select cdr3_aa, " + " + ".join(f"case when \"{s}\" then {1 << i} else 0 end" for i, s in enumerate(SETS)) + " as bits from flagged")
def _(v):
    f = P.flagged(counts(v), P.cohort_sizes(v.samples))
    return f.select("cdr3_aa", P.bit_mask({s: F.col(s) for s in P.ALL_SETS}).alias("bits"))


NAMES = {"global": "global_public", "neg_group": "A_group_public", "pos_group": "B_group_public", "shared": "between_group_shared", "neg_specific": "A_specific_ref", "pos_specific": "B_specific_ref"}
SUMMARY_SQL = " union all ".join(f"select 'main' as scheme, '{n}' as set_name, size_{s} as set_size, n_neg + n_pos as n_training_samples, greatest(3, ceil(cast(0.02 as double) * (n_neg + n_pos))) as global_count_threshold, greatest(3, ceil(cast(0.05 as double) * n_neg)) as \"A_count_threshold\", greatest(3, ceil(cast(0.05 as double) * n_pos)) as \"B_count_threshold\" from set_sizes, cohort_n" for s, n in NAMES.items())


@query("pub6_set_sizes", "scheme set_name set_size:i n_training_samples:i global_count_threshold:i A_count_threshold:i B_count_threshold:i", SUMMARY_SQL)
def _(v):
    return P.set_summary(reference(v), P.cohort_sizes(v.samples))


@query("pub7_overlap_features", "sample_id aa_clone_number:i " + DESC_SPEC, "select * from descriptive")
def _(v):
    return descriptive(v)


@query("join4_reference_lookup", "sample_id matched:i missed:i", "select i.sample_id, count(f.cdr3_aa) as matched, count(*) - count(f.cdr3_aa) as missed from inc i left join (select * from flagged where \"global\") f on i.cdr3_aa = f.cdr3_aa group by 1")
def _(v):
    ref = reference(v).filter(F.col("global")).select("cdr3_aa", F.lit(True).alias("hit"))
    return v.inc.join(ref, "cdr3_aa", "left").groupBy("sample_id").agg(F.count("hit").alias("matched"), (F.count(F.lit(1)) - F.count("hit")).alias("missed"))


@query("pub8_reference_view", "sample_id " + MODEL_SPEC, "select * from model_features")
def _(v):
    return P.reference_view(descriptive(v))


@query("pub9_train_reference", "sample_id aa_clone_number:i " + DESC_SPEC, "select * from descriptive where sample_id >= 0")
def _(v):
    # Candidates first, as in a training run: clones of one sample cannot enter any set.
    cells = P.incidence(v.inc, [], 2)
    ref = P.reference_table(P.presence_counts(P.with_cohort(cells, v.samples)), P.cohort_sizes(v.samples))
    return P.overlap_features(v.inc, ref)


TEST_FLAGGED = f"select cdr3_aa, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from train_counts, train_n"


@query("pub10_test_application", "sample_id aa_clone_number:i matched_all_ref_clone_number:i matched_all_ref_frequency_sum:8 ignored_nonreference_clone_number:i", f"""
    with train_counts as (select cdr3_aa, count(*) filter (cohort = 'A') as neg_count, count(*) filter (cohort = 'B') as pos_count from labelled where batch <> '3' group by 1),
      train_n as (select count(*) filter (cohort = 'A') as n_neg, count(*) filter (cohort = 'B') as n_pos from samples where batch <> '3'), ref as ({TEST_FLAGGED})
    select i.sample_id, count(*) as aa_clone_number, count(*) filter (r."global") as matched_all_ref_clone_number, coalesce(sum(frequency_norm) filter (r."global"), 0) as matched_all_ref_frequency_sum,
      count(*) - count(*) filter (r."global") as ignored_nonreference_clone_number from labelled i left join ref r on i.cdr3_aa = r.cdr3_aa where i.batch = '3' group by 1""")
def _(v):
    train, test = v.samples.filter("batch <> '3'"), v.samples.filter("batch = '3'")
    ref = P.reference_table(P.presence_counts(P.with_cohort(v.inc, train)), P.cohort_sizes(train))
    cells = v.inc.join(test.select("sample_id"), "sample_id", "left_semi")
    return P.application_log(P.overlap_features(cells, ref))


@query("pub11_external_features", "sample_id " + MODEL_SPEC, f"""
    with train_counts as (select cdr3_aa, count(*) filter (cohort = 'A') as neg_count, count(*) filter (cohort = 'B') as pos_count from labelled where batch <> '3' group by 1),
      train_n as (select count(*) filter (cohort = 'A') as n_neg, count(*) filter (cohort = 'B') as n_pos from samples where batch <> '3'), ref as ({TEST_FLAGGED}),
      ref_sizes as (select {", ".join(f'count(*) filter ("{s}") as size_{s}' for s in SETS)} from ref),
      held as (select * from labelled where batch = '3')
    select *, {RATIO} from ({overlap_sql(MODEL, 'held', 'ref', 'ref_sizes')}) x""")
def _(v):
    train, test = v.samples.filter("batch <> '3'"), v.samples.filter("batch = '3'")
    ref = P.reference_table(P.presence_counts(P.with_cohort(v.inc, train)), P.cohort_sizes(train))
    return P.external_features(v.inc.join(test.select("sample_id"), "sample_id", "left_semi"), ref)


@query("pub12_leave_one_out", "sample_id " + MODEL_SPEC, "select * from loo")
def _(v):
    return P.leave_one_out(v.inc, v.samples)


@query("pub15_reference_log", "sample_id context held_out_label n_reference:i n_A_reference:i n_B_reference:i global_threshold:i A_threshold:i B_threshold:i all_ref_public_size:i A_specific_ref_size:i B_specific_ref_size:i shared_ref_size:i",
       "select *, 'outer_training' as context, cohort as held_out_label from loo")
def _(v):
    return P.reference_log(P.leave_one_out(v.inc, v.samples), "outer_training")


@query("pub13_crossfit", "fold:i sample_id " + MODEL_SPEC, "select * from crossfit")
def _(v):
    return P.crossfit(v.inc, folds(v), [], "fold", 4)


@query("pub14_reproduction_check", "set_name rebuilt_size:i set_size:i matches:b", f"""
    select set_name, set_size as rebuilt_size, case when set_name = 'global_public' then set_size + 1 else set_size end as set_size, set_name <> 'global_public' as matches from ({SUMMARY_SQL}) x""")
def _(v):
    published = P.set_summary(reference(v), P.cohort_sizes(v.samples)).withColumn("set_size", F.col("set_size") + (F.col("set_name") == "global_public").cast("int"))
    return P.reproduction_check(reference(v), published)


JOINT = [f"{r}_{n}" for r in ("f", "o") for n in FEATURES if not n.endswith("number")]
_two = ", ".join(
    f"count(*) filter (f.\"{s}\") as {p}_clone_number, count(*) filter (f.\"{s}\") / count(*) as {p}_clone_ratio, coalesce(sum(frequency_norm) filter (f.\"{s}\"), 0) as {p}_frequency_sum, "
    f"case when max(z.size_{s}) = 0 then 0.0 else count(*) filter (f.\"{s}\") / max(z.size_{s}) end as {p}_set_coverage" for s, p in MODEL.items())
_two_pivot = ", ".join(f"max({n}) filter (receptor = '{r.upper()}') as \"{r}_{n}\"" for r in ("f", "o") for n in FEATURES)


@query("pub16_two_receptor_features", "sample_id " + " ".join(f"{n}:8" for n in JOINT), f"""
    select sample_id, {_two_pivot} from (select *, {RATIO} from (select i.receptor, i.sample_id, {_two} from inc_two i join two_sizes z on z.receptor = i.receptor
      left join two_flagged f on f.receptor = i.receptor and f.cdr3_aa = i.cdr3_aa group by 1, 2) x) y group by 1""")
def _(v):
    labelled = v.inc2.join(v.samples.select("sample_id", "cohort"), "sample_id")
    members = labelled.groupBy("receptor", "sample_id", "cohort").agg(F.count(F.lit(1)).alias("n"))
    ref = P.reference_table(P.presence_counts(labelled, ["receptor"]), P.cohort_sizes(members, ["receptor"]), ["receptor"])
    return J.receptor_blocks(P.external_features(v.inc2, ref, ["receptor"]), "receptor", {"F": "f_", "O": "o_"}, "sample_id")


@query("pub17_membership_table", "receptor cdr3_aa is_global_public:b is_A_specific_ref:b is_B_specific_ref:b is_between_group_shared:b", """
    select receptor, cdr3_aa, "global" as is_global_public, neg_specific as "is_A_specific_ref", pos_specific as "is_B_specific_ref", shared as is_between_group_shared
    from two_flagged where "global" or neg_group or pos_group or shared or neg_specific or pos_specific""")
def _(v):
    labelled = v.inc2.join(v.samples.select("sample_id", "cohort"), "sample_id")
    members = labelled.groupBy("receptor", "sample_id", "cohort").agg(F.count(F.lit(1)).alias("n"))
    return P.membership_table(P.reference_table(P.presence_counts(labelled, ["receptor"]), P.cohort_sizes(members, ["receptor"]), ["receptor"]), ["receptor"])


RANGE_COLS = [f"{p}_{m}" for p in DESCRIPTIVE.values() for m in ("clone_ratio", "frequency_sum", "set_coverage")]


@query("pub18_range_check", "feature min_value:8 max_value:8 in_range:b all_zero:b", " union all ".join(
    f"select '{c}' as feature, min({c}) as min_value, max({c}) as max_value, min({c}) >= -1e-10 and max({c}) <= 1 + 1e-8 as in_range, max(abs({c})) <= 1e-8 as all_zero from descriptive" for c in RANGE_COLS))
def _(v):
    return P.range_check(descriptive(v))


@query("pub19_receptor_overview", "receptor samples:i candidate_clones:i incidences:i all_ref_public_size:i A_specific_ref_size:i B_specific_ref_size:i shared_ref_size:i", """
    select f.receptor, max(n_neg + n_pos) as samples, count(*) as candidate_clones, sum(neg_count + pos_count) as incidences, count(*) filter ("global") as all_ref_public_size,
      count(*) filter (neg_specific) as "A_specific_ref_size", count(*) filter (pos_specific) as "B_specific_ref_size", count(*) filter (shared) as shared_ref_size
    from two_flagged f where neg_count + pos_count >= 2 group by 1""")
def _(v):
    return P.receptor_reference_overview(v.inc2, v.samples)


@query("top2_most_shared_clones", "cdr3_aa n:i", "select cdr3_aa, neg_count + pos_count as n from counts order by 2 desc, 1 limit 50")
def _(v):
    c = counts(v).select("cdr3_aa", (F.col("neg_count") + F.col("pos_count")).alias("n"))
    return c.orderBy(F.col("n").desc(), "cdr3_aa").limit(50)
