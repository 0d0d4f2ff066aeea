"""SQL fragments for public clones."""

from __future__ import annotations

from .sql_views import FRAGMENTS

SETS = ["global", "neg_group", "pos_group", "shared", "neg_specific", "pos_specific"]
MODEL = {"global": "all_ref_public", "neg_specific": "A_specific_ref", "pos_specific": "B_specific_ref", "shared": "shared_ref"}
SCHEME_SQL = {"loose": (0.01, 2, 0.03, 2, 0.03), "main": (0.02, 3, 0.05, 3, 0.05), "strict": (0.05, 5, 0.10, 4, 0.10)}


def flags_sql(a: str, b: str, na: str, nb: str, scheme: str = "main", suffix: str = "") -> str:
    """Six boolean columns from count and size expressions."""
    gp, gc, p, c, d = SCHEME_SQL[scheme]
    ta, tb = f"greatest({c}, ceil(cast({p} as double) * ({na})))", f"greatest({c}, ceil(cast({p} as double) * ({nb})))"
    ga, gb = f"(({a}) >= {ta})", f"(({b}) >= {tb})"
    sa = f"({ga} and cast(({a}) as double) / ({na}) - cast(({b}) as double) / ({nb}) >= cast({d} as double))"
    sb = f"({gb} and cast(({b}) as double) / ({nb}) - cast(({a}) as double) / ({na}) >= cast({d} as double))"
    cols = {
        "global": f"(({a}) + ({b}) >= greatest({gc}, ceil(cast({gp} as double) * (({na}) + ({nb})))))", "neg_group": ga, "pos_group": gb,
        "shared": f"({ga} and {gb} and not {sa} and not {sb})", "neg_specific": sa, "pos_specific": sb,
    }
    return ", ".join(f"{v} as {k}{suffix}" for k, v in cols.items()).replace(" as global,", ' as "global",')


FRAGMENTS["cohort_n"] = "select count(*) filter (cohort = 'A') as n_neg, count(*) filter (cohort = 'B') as n_pos from samples"
FRAGMENTS["labelled"] = "select i.*, s.cohort, s.batch from inc i join samples s on i.sample_id = s.sample_id"
FRAGMENTS["counts"] = """
select cdr3_aa, count(*) filter (cohort = 'A') as neg_count, count(*) filter (cohort = 'B') as pos_count,
  coalesce(sum(frequency_norm) filter (cohort = 'A'), 0) as neg_freq, coalesce(sum(frequency_norm) filter (cohort = 'B'), 0) as pos_freq from labelled group by 1
"""
FRAGMENTS["flagged"] = f"select c.*, n_neg, n_pos, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from counts c, cohort_n"
FRAGMENTS["set_sizes"] = "select " + ", ".join(f"count(*) filter (\"{s}\") as size_{s}" for s in SETS) + " from flagged"


def overlap_sql(prefixes: dict[str, str], cells: str = "inc", flagged: str = "flagged", sizes: str = "set_sizes") -> str:
    """Per sample: the four measures of every set."""
    cols = []
    for s, p in prefixes.items():
        cols.append(
            f"count(*) filter (f.\"{s}\") as {p}_clone_number, count(*) filter (f.\"{s}\") / count(*) as {p}_clone_ratio, "
            f"coalesce(sum(frequency_norm) filter (f.\"{s}\"), 0) as {p}_frequency_sum, "
            f"case when max(z.size_{s}) = 0 then 0.0 else count(*) filter (f.\"{s}\") / max(z.size_{s}) end as {p}_set_coverage"
        )
    return f"select i.sample_id, count(*) as aa_clone_number, {', '.join(cols)} from {cells} i left join {flagged} f on i.cdr3_aa = f.cdr3_aa, {sizes} z group by 1"


DESCRIPTIVE = {"global": "global_public_aa", "neg_group": "A_group_public_aa", "pos_group": "B_group_public_aa", "shared": "between_group_shared_aa",
               "neg_specific": "A_specific_ref", "pos_specific": "B_specific_ref"}
RATIO = "B_specific_ref_frequency_sum - A_specific_ref_frequency_sum as B_A_specific_ref_frequency_delta, ln((B_specific_ref_frequency_sum + 1e-8) / (A_specific_ref_frequency_sum + 1e-8)) as B_A_specific_ref_frequency_log_ratio"
FRAGMENTS["descriptive"] = overlap_sql(DESCRIPTIVE)
FRAGMENTS["model_features"] = f"select *, {RATIO} from ({overlap_sql(MODEL)}) m"

# Brute force: the reference of every held-out sample is rebuilt from the other samples.
FRAGMENTS["loo_counts"] = """
select h.sample_id as held, h.cohort as held_cohort, c.cdr3_aa, c.neg_count - coalesce(o.a, 0) as neg_count, c.pos_count - coalesce(o.b, 0) as pos_count,
  n_neg - case when h.cohort = 'A' then 1 else 0 end as n_neg, n_pos - case when h.cohort = 'B' then 1 else 0 end as n_pos, o.frequency_norm, o.sample_id is not null as own
from samples h cross join counts c cross join cohort_n
left join (select sample_id, cdr3_aa, frequency_norm, case when cohort = 'A' then 1 else 0 end as a, case when cohort = 'B' then 1 else 0 end as b from labelled) o
  on o.sample_id = h.sample_id and o.cdr3_aa = c.cdr3_aa
"""
FRAGMENTS["loo_flagged"] = f"select *, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from loo_counts"
LOO_COLUMNS = ", ".join(
    f"count(*) filter (own and \"{s}\") as {p}_clone_number, count(*) filter (own and \"{s}\") / count(*) filter (own) as {p}_clone_ratio, "
    f"coalesce(sum(frequency_norm) filter (own and \"{s}\"), 0) as {p}_frequency_sum, count(*) filter (\"{s}\") as {p}_size, "
    f"case when count(*) filter (\"{s}\") = 0 then 0.0 else count(*) filter (own and \"{s}\") / count(*) filter (\"{s}\") end as {p}_set_coverage"
    for s, p in MODEL.items()
)
FRAGMENTS["loo"] = f"""
select *, {RATIO} from (select held as sample_id, max(held_cohort) as cohort, max(n_neg) as "n_A_reference", max(n_pos) as "n_B_reference", max(n_neg) + max(n_pos) as n_reference,
  greatest(3, ceil(cast(0.02 as double) * (max(n_neg) + max(n_pos)))) as global_threshold, greatest(3, ceil(cast(0.05 as double) * max(n_neg))) as "A_threshold",
  greatest(3, ceil(cast(0.05 as double) * max(n_pos))) as "B_threshold", {LOO_COLUMNS} from loo_flagged group by 1) x
"""
FRAGMENTS["folds"] = "select *, sample_id // 5 % 4 + 1 as fold from samples"
FRAGMENTS["cf_counts"] = """
select f.fold, c.cdr3_aa, c.neg_count - coalesce(o.a, 0) as neg_count, c.pos_count - coalesce(o.b, 0) as pos_count, n_neg, n_pos
from (select t.fold, count(*) filter (s.cohort = 'A') as n_neg, count(*) filter (s.cohort = 'B') as n_pos from (values (1), (2), (3), (4)) t(fold) join folds s on s.fold <> t.fold group by 1) f
cross join counts c left join (select fold, cdr3_aa, count(*) filter (l.cohort = 'A') as a, count(*) filter (l.cohort = 'B') as b from labelled l join folds s on l.sample_id = s.sample_id group by 1, 2) o
  on o.fold = f.fold and o.cdr3_aa = c.cdr3_aa
"""
FRAGMENTS["cf_flagged"] = f"select *, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from cf_counts"
FRAGMENTS["cf_sizes"] = "select fold, " + ", ".join(f"count(*) filter (\"{s}\") as size_{s}" for s in SETS) + " from cf_flagged group by 1"
_cf = ", ".join(
    f"count(*) filter (f.\"{s}\") as {p}_clone_number, count(*) filter (f.\"{s}\") / count(*) as {p}_clone_ratio, coalesce(sum(frequency_norm) filter (f.\"{s}\"), 0) as {p}_frequency_sum, "
    f"case when max(z.size_{s}) = 0 then 0.0 else count(*) filter (f.\"{s}\") / max(z.size_{s}) end as {p}_set_coverage" for s, p in MODEL.items()
)
FRAGMENTS["crossfit"] = f"""
select *, {RATIO} from (select s.fold, i.sample_id, {_cf} from inc i join folds s on i.sample_id = s.sample_id join cf_sizes z on z.fold = s.fold
  left join cf_flagged f on f.fold = s.fold and f.cdr3_aa = i.cdr3_aa group by 1, 2) x
"""
FRAGMENTS["inc_two_members"] = "select receptor, sample_id, count(*) as aa_clone_number from inc_two group by 1, 2"
FRAGMENTS["two_n"] = "select receptor, count(*) filter (cohort = 'A') as n_neg, count(*) filter (cohort = 'B') as n_pos from inc_two_members m join samples s on m.sample_id = s.sample_id group by 1"
FRAGMENTS["two_counts"] = "select receptor, cdr3_aa, count(*) filter (cohort = 'A') as neg_count, count(*) filter (cohort = 'B') as pos_count from inc_two i join samples s on i.sample_id = s.sample_id group by 1, 2"
FRAGMENTS["two_flagged"] = f"select c.*, n_neg, n_pos, {flags_sql('neg_count', 'pos_count', 'n_neg', 'n_pos')} from two_counts c join two_n n on c.receptor = n.receptor"
FRAGMENTS["two_sizes"] = "select receptor, " + ", ".join(f"count(*) filter (\"{s}\") as size_{s}" for s in SETS) + " from two_flagged group by 1"
