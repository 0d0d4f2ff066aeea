"""DuckDB twins of the Spark views, and SQL fragments shared by several twins."""

from __future__ import annotations

from clonespan.functions.sequences import CODE_BASES, CODE_RESIDUES, HYDROPHOBICITY, RESIDUE_GROUPS, RESIDUES

FRAGMENTS: dict[str, str] = {}

_CODON_VALUES = ", ".join(
    f"('{a}{b}{c}', '{CODE_RESIDUES[16 * i + 4 * j + k]}')"
    for i, a in enumerate(CODE_BASES) for j, b in enumerate(CODE_BASES) for k, c in enumerate(CODE_BASES)
)

FRAGMENTS["codons"] = f"select * from (values {_CODON_VALUES}) as t(codon, residue)"
FRAGMENTS["codon_map"] = "select map_from_entries(list(struct_pack(k := codon, v := residue))) as m from codons"
FRAGMENTS["nt_clones"] = """
select l_orderkey % 100 as sample_id, l_linestatus as receptor,
  translate(substr(md5(cast(l_partkey as varchar)), 1, case when l_linenumber = 7 then 10 else 9 end),
            '0123456789abcdef', 'ACGTACGTACGTACGT') as cdr3_nt,
  cast(l_quantity as bigint) as read_count, l_discount as input_frequency, l_tax as input_cell_frequency,
  l_orderkey as orderkey, l_linenumber as linenumber
from lineitem
"""
FRAGMENTS["nt_lines"] = """
select sample_id, case when k % 19 = 1 then nt || sep || reads || sep || freq
                       when k % 19 = 2 then '# ' || nt || sep || reads || sep || freq || sep || '0.25'
                       when k % 19 = 3 then '   ' else nt || sep || reads || sep || freq || sep || '0.25' end as value
from (select l_orderkey % 100 as sample_id, l_partkey as k,
        case when l_partkey % 11 = 3 then substr(h, 1, 8) || 'N' else substr(h, 1, case when l_linenumber = 7 then 10 else 9 end) end as nt,
        case when l_partkey % 13 = 5 then '-1' when l_partkey % 13 = 6 then 'abc'
             when l_partkey % 13 = 7 then cast(cast(l_quantity as bigint) as varchar) || '.0' else cast(cast(l_quantity as bigint) as varchar) end as reads,
        case when l_partkey % 17 = 2 then 'nan' else '0.5' end as freq,
        case l_linenumber % 3 when 0 then ' ' when 1 then ', ' else chr(9) end as sep
      from (select *, translate(md5(cast(l_partkey as varchar)), '0123456789abcdef', 'ACGTACGTACGUacgt') as h from lineitem) x) y
"""
FRAGMENTS["nt_tokens"] = r"""
select sample_id, list_filter(regexp_split_to_array(trim(value), '[\s,]+'), lambda x: x <> '') as tokens
from nt_lines where trim(value) <> '' and not starts_with(trim(value), '#')
"""
FRAGMENTS["nt_typed"] = r"""
select sample_id, len(tokens) as width, translate(upper(trim(tokens[1])), 'U', 'T') as cdr3_nt,
  case when regexp_full_match(tokens[2], '[0-9]+(\.0)?') then cast(cast(tokens[2] as double) as bigint) end as read_count,
  case when regexp_full_match(tokens[3], '[0-9.]+') then cast(tokens[3] as double) end as input_frequency,
  case when regexp_full_match(tokens[4], '[0-9.]+') then cast(tokens[4] as double) end as input_cell_frequency
from nt_tokens
"""
_AA = """array_to_string(list_transform(range(1, cast(len(cdr3_nt) / 3 as bigint) + 1), lambda i: m[substr(cdr3_nt, 3 * i - 2, 3)]), '')"""
_REASON = """case when {pre} when cdr3_nt is null or cdr3_nt = '' then 'empty_sequence'
 when len(cdr3_nt) % 3 <> 0 then 'length_not_multiple_of_3'
 when not regexp_full_match(cdr3_nt, '[ACGT]+') then 'non_acgt_base'
 when contains({aa}, '*') then 'stop_codon' end"""
FRAGMENTS["nt_parsed"] = f"""
select *, case when reason is null then aa end as cdr3_aa from (
  select *, case when len(cdr3_nt) % 3 <> 0 then 'length_not_multiple_of_3' when contains(aa, '*') then 'stop_codon' end as reason
  from (select c.*, case when len(cdr3_nt) % 3 = 0 then {_AA} end as aa from nt_clones c, codon_map) a) b
"""
FRAGMENTS["line_parsed"] = f"""
select *, case when reason is null then aa end as cdr3_aa from (
  select *, case when width < 4 then 'malformed_columns' when read_count is null then 'invalid_read_count'
     when input_frequency is null or input_cell_frequency is null then 'invalid_frequency'
     when cdr3_nt = '' then 'empty_sequence' when len(cdr3_nt) % 3 <> 0 then 'length_not_multiple_of_3'
     when not regexp_full_match(cdr3_nt, '[ACGT]+') then 'non_acgt_base' when contains(aa, '*') then 'stop_codon' end as reason
  from (select c.*, case when len(cdr3_nt) % 3 = 0 and regexp_full_match(cdr3_nt, '[ACGT]+') then {_AA} end as aa from nt_typed c, codon_map) a) b
"""


def _clone_fragments(suffix: str, keys: str, source: str) -> None:
    on = " and ".join(f"a.{k} = t.{k}" for k in keys.split(", "))
    FRAGMENTS[f"aa_sums{suffix}"] = f"""
select {keys}, cdr3_aa, len(cdr3_aa) as aa_length, count(*) as nt_clone_number, sum(reads) as read_count, sum(freq) as input_frequency_sum,
  sum(cell) as input_cell_frequency_sum, arg_min(cdr3_nt, struct_pack(a := -reads, b := cdr3_nt)) as top_nt_cdr3
from (select {keys}, cdr3_aa, cdr3_nt, sum(read_count) as reads, sum(input_frequency) as freq, sum(input_cell_frequency) as cell
      from {source} where reason is null group by all) n group by {keys}, cdr3_aa
"""
    FRAGMENTS[f"aa_totals{suffix}"] = f"""
select {keys}, total_reads_valid_nt,
  case when total_reads_valid_nt = 0 then 'none' when c > 0 then 'input_cell_frequency_sum' when f > 0 then 'input_frequency_sum' else 'read_fraction' end as frequency_source,
  case when total_reads_valid_nt = 0 then 0.0 when c > 0 then c when f > 0 then f else 1.0 end as frequency_sum
from (select {keys}, sum(input_cell_frequency_sum) as c, sum(input_frequency_sum) as f, sum(read_count) as total_reads_valid_nt from aa_sums{suffix} group by {keys}) s
"""
    FRAGMENTS[f"aa_table{suffix}"] = f"""
select *, case when frequency_sum = 0 then 0.0 else frequency / frequency_sum end as frequency_norm from (
  select a.*, t.frequency_sum, a.read_count / t.total_reads_valid_nt as read_fraction,
    case t.frequency_source when 'input_cell_frequency_sum' then a.input_cell_frequency_sum when 'input_frequency_sum' then a.input_frequency_sum
      when 'read_fraction' then a.read_count / t.total_reads_valid_nt else 0.0 end as frequency
  from aa_sums{suffix} a join aa_totals{suffix} t on {on} where t.total_reads_valid_nt > 0) x
"""
    FRAGMENTS[f"aa_summary{suffix}"] = f"""
select r.*, coalesce(p.unique_valid_nt_clones, 0) as unique_valid_nt_clones, coalesce(p.aa_clone_number, 0) as aa_clone_number,
  coalesce(t.frequency_source, 'none') as frequency_source, coalesce(t.frequency_sum, 0) as frequency_sum,
  r.valid_nt_rows / r.input_nt_rows as valid_nt_row_ratio,
  case when r.total_reads_all_nt = 0 then 0.0 else r.total_reads_valid_nt / r.total_reads_all_nt end as valid_read_ratio,
  case when coalesce(p.unique_valid_nt_clones, 0) = 0 then 0.0 else p.aa_clone_number / p.unique_valid_nt_clones end as aa_clone_reduction_ratio
from (select {keys}, count(*) as input_nt_rows, count(*) filter (reason is null) as valid_nt_rows, coalesce(sum(read_count), 0) as total_reads_all_nt,
        coalesce(sum(read_count) filter (reason is null), 0) as total_reads_valid_nt,
        count(*) filter (reason = 'stop_codon') as stop_codon_rows, count(*) filter (reason = 'length_not_multiple_of_3') as length_not_multiple_of_3_rows,
        count(*) filter (reason = 'non_acgt_base') as non_acgt_base_rows, count(*) filter (reason = 'malformed_columns') as malformed_columns_rows,
        count(*) filter (reason = 'invalid_read_count') as invalid_read_count_rows, count(*) filter (reason = 'invalid_frequency') as invalid_frequency_rows
      from {source} group by {keys}) r
left join (select {keys}, sum(nt_clone_number) as unique_valid_nt_clones, count(*) as aa_clone_number from aa_sums{suffix} group by {keys}) p
  on {on.replace('a.', 'r.').replace('t.', 'p.')}
left join aa_totals{suffix} t on {on.replace('a.', 'r.')}
"""
    FRAGMENTS[f"aa_verdict{suffix}"] = f"""
select *, aa_clone_number > 0 and total_reads_valid_nt > 0 and frequency_source <> 'none' as qc_pass_01, qc_warning_01 <> '' as has_warning_01 from (
 select *, concat_ws('; ', case when aa_clone_number = 0 then 'no valid AA clone' end, case when total_reads_valid_nt = 0 then 'no valid reads' end,
  case when frequency_source = 'none' then 'no usable frequency source' end, case when input_nt_rows < 10 then 'few NT rows' end,
  case when valid_read_ratio > 0 and valid_read_ratio < 0.7 then 'low valid read ratio' end,
  case when valid_nt_row_ratio > 0 and valid_nt_row_ratio < 0.7 then 'low valid row ratio' end) as qc_warning_01 from aa_summary{suffix}) v
"""


_clone_fragments("", "sample_id", "nt_parsed")
_clone_fragments("_lines", "sample_id", "line_parsed")
_clone_fragments("2", "receptor, sample_id", "nt_parsed")

FRAGMENTS["seqs"] = """
select sample_id, cdr3_aa, sum(n_chars) as read_count, count(*) as nt_clone_number
from (select sample_id, n_chars, substr(letters, i * k + 1, k) as cdr3_aa
      from (select source as sample_id, n_chars, 8 + doc_id % 20 as k, letters, unnest(range(0, (len(letters) - 1) // (8 + doc_id % 20) + 1)) as i
            from (select *, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') as letters from documents) d where letters <> '') x) y
group by 1, 2
"""
FRAGMENTS["clones"] = """
select s.sample_id, cdr3_aa, len(cdr3_aa) as aa_length, nt_clone_number, read_count, read_count / t.t as read_fraction, read_count / t.t as frequency_norm
from seqs s join (select sample_id, sum(read_count) as t from seqs group by 1) t on s.sample_id = t.sample_id
"""


def _n(letters: str) -> str:
    return "(" + " + ".join(f"(len(cdr3_aa) - len(replace(cdr3_aa, '{r}', '')))" for r in letters) + ")"


FRAGMENTS["seq_scores"] = (
    "select *, "
    + "(" + " + ".join(f"{v} * {_n(r)}" for r, v in HYDROPHOBICITY.items()) + ") / len(cdr3_aa) as hydrophobicity, "
    + f"({_n('KR')} + 0.1 * {_n('H')} - {_n('DE')}) / len(cdr3_aa) as charge, {_n('FWY')} / len(cdr3_aa) as aromaticity, "
    + ", ".join(f"{_n(letters)} / len(cdr3_aa) as {g}" for g, letters in RESIDUE_GROUPS.items())
    + " from clones"
)
FRAGMENTS["params"] = """
select *, (list_value(0.1, 0.5, 0.9))[(outer_repeat * 7 + outer_fold * 3 + m + task) % 3 + 1] as l1_ratio_alpha,
  (list_value(0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0))[(outer_repeat * outer_fold + m) % 8 + 1] as "lambda",
  ((outer_repeat * 13 + outer_fold * 29 + m + task) % 97) / 97.0 as threshold, 0.5 + ((outer_repeat + outer_fold) % 10) / 25.0 as inner_roc_auc,
  0.4 + ((outer_repeat * outer_fold) % 10) / 25.0 as inner_pr_auc
from (select o_orderkey as task, o_orderkey % 20 + 1 as outer_repeat, (o_orderkey // 20) % 5 + 1 as outer_fold, (o_orderkey // 100) % 4 as m,
        'M' || ((o_orderkey // 100) % 4) as model from orders) t
"""
FRAGMENTS["matrix"] = """
select c_custkey as sample_id, case when c_acctbal > 4500 then 1 else 0 end as y, cast(c_custkey % 60 + 20 as double) as age, cast(c_custkey % 2 as varchar) as sex,
  c_mktsegment as material, cast(coalesce(n, 0) as double) as x1, coalesce(m, 0.0) as x2, coalesce(x, 0.0) as x3, cast(c_nationkey as double) as x4, 1.0 as x5, c_custkey % 5 + 1 as fold
from customer left join (select o_custkey, count(*) as n, avg(o_totalprice) as m, max(o_totalprice) as x from orders group by 1) o on c_custkey = o_custkey
"""
FRAGMENTS["kmers"] = """
select x.sample_id, kmer, n as clones_with_kmer, n / c.n_clones as unweighted_value, w as weighted_value
from (select sample_id, kmer, count(*) as n, sum(frequency_norm) as w from (
        select distinct sample_id, cdr3_aa, frequency_norm, substr(cdr3_aa, i, 3) as kmer
        from (select *, unnest(range(1, len(cdr3_aa) - 1)) as i from clones) a) b group by 1, 2) x
join (select sample_id, count(*) as n_clones from clones group by 1) c on x.sample_id = c.sample_id
"""
FRAGMENTS["vocab_stats"] = """
select kmer, count(*) as training_sample_count, count(*) / max(n) as training_sample_prevalence,
  sum(unweighted_value) / max(n) as mean_unweighted_value, greatest(sum(unweighted_value * unweighted_value) / max(n) - power(sum(unweighted_value) / max(n), 2), 0) as variance_unweighted_value,
  sum(weighted_value) / max(n) as mean_weighted_value, greatest(sum(weighted_value * weighted_value) / max(n) - power(sum(weighted_value) / max(n), 2), 0) as variance_weighted_value
from kmers, (select count(distinct sample_id) as n from clones) t group by kmer
"""
FRAGMENTS["vocab"] = """
select *, reasons = '' as keep, case when reasons = '' then 'retained' else reasons end as filter_reason from (
 select *, concat_ws(';', case when training_sample_count < 5 then 'low_sample_count' end, case when training_sample_prevalence < 0.05 then 'low_prevalence' end,
   case when variance_unweighted_value < 1e-12 and variance_weighted_value < 1e-12 then 'low_variance_both' end) as reasons from vocab_stats) v
"""
FRAGMENTS["vocab_ranked"] = """
select *, row_number() over (order by keep desc, training_sample_prevalence desc, kmer) as vocabulary_rank from vocab
"""


def composition_sql(key: str = "sample_id", table: str = "clones") -> str:
    plain = ", ".join(f"avg({_n(r)} / len(cdr3_aa)) as \"{r}_frequency\"" for r in RESIDUES)
    weighted = ", ".join(f"sum(frequency_norm * {_n(r)} / len(cdr3_aa)) as \"weighted_{r}_frequency\"" for r in RESIDUES)
    return f"select {key}, {plain}, {weighted} from {table} group by {key}"


FRAGMENTS["composition"] = composition_sql()
FRAGMENTS["physico"] = (
    "select sample_id, avg(hydrophobicity) as mean_hydrophobicity, sum(frequency_norm * hydrophobicity) as weighted_hydrophobicity, avg(charge) as mean_charge, "
    "sum(frequency_norm * charge) as weighted_charge, avg(aromaticity) as aromaticity, sum(frequency_norm * aromaticity) as weighted_aromaticity, "
    + ", ".join(f"avg({g}) as {g}_aa_ratio, sum(frequency_norm * {g}) as weighted_{g}_aa_ratio" for g in RESIDUE_GROUPS)
    + " from seq_scores group by 1"
)


def diversity_sql(key: str, table: str) -> str:
    return f"""
select *, 1 / Simpson as "inverse_Simpson", case when aa_clone_number <= 1 then 1.0 else least(greatest(1 - Shannon / ln(aa_clone_number), 0), 1) end as clonality
from (select {key}, count(*) as aa_clone_number, sum(case when frequency_norm > 0 then -frequency_norm * ln(frequency_norm) else 0 end) as Shannon, sum(frequency_norm * frequency_norm) as Simpson
      from {table} group by {key}) d"""


def evenness_sql(key: str, table: str) -> str:
    tops = ", ".join(f"sum(case when down <= {k} then frequency_norm else 0 end) as {'top1_frequency' if k == 1 else f'top{k}_cumulative_frequency'}" for k in (1, 5, 10, 20, 50))
    return f"""
select {key}, least(greatest(2 * sum(up * frequency_norm) / (count(*) * sum(frequency_norm)) - (count(*) + 1) / count(*), 0), 1) as Gini, {tops}
from (select {key}, frequency_norm, row_number() over (partition by {key} order by frequency_norm, cdr3_aa) as up,
        row_number() over (partition by {key} order by frequency_norm desc, cdr3_aa) as down from {table}) r group by {key}"""


def length_sql(key: str, table: str) -> str:
    mass = ", ".join(f"sum(case when aa_length = {n} then frequency_norm else 0 end) as weighted_length_{n}_freq" for n in range(8, 26))
    return f"""
select {key}, avg(aa_length) as mean_aa_length, quantile_cont(cast(aa_length as double), 0.5) as median_aa_length, stddev_pop(aa_length) as sd_aa_length,
  sum(frequency_norm * aa_length) as weighted_mean_aa_length, case when min(aa_length) = max(aa_length) then 0 else sqrt(greatest(sum(frequency_norm * aa_length * aa_length) - power(sum(frequency_norm * aa_length), 2), 0)) end as weighted_sd_aa_length,
  {mass}, sum(case when aa_length not between 8 and 25 then frequency_norm else 0 end) as weighted_length_other_freq
from {table} group by {key}"""


FRAGMENTS["diversity"] = diversity_sql("sample_id", "clones")
FRAGMENTS["evenness"] = evenness_sql("sample_id", "clones")
FRAGMENTS["lengths"] = length_sql("sample_id", "clones")
FRAGMENTS["inc"] = """
select x.sample_id, cdr3_aa, w / t as frequency_norm from (select l_orderkey % 100 as sample_id, l_partkey as cdr3_aa, sum(l_extendedprice) as w from lineitem group by 1, 2) x
join (select l_orderkey % 100 as sample_id, sum(l_extendedprice) as t from lineitem group by 1) y on x.sample_id = y.sample_id
"""
FRAGMENTS["inc_two"] = """
select x.receptor, x.sample_id, cdr3_aa, w / t as frequency_norm from (select l_linestatus as receptor, l_orderkey % 100 as sample_id, l_partkey as cdr3_aa, sum(l_extendedprice) as w from lineitem group by 1, 2, 3) x
join (select l_linestatus as receptor, l_orderkey % 100 as sample_id, sum(l_extendedprice) as t from lineitem group by 1, 2) y on x.sample_id = y.sample_id and x.receptor = y.receptor
"""
FRAGMENTS["samples"] = """
select sample_id, case when sample_id % 5 < 3 then 'A' else 'B' end as cohort, cast(sample_id % 4 as varchar) as batch, cast(sample_id % 3 as varchar) as material,
  cast(sample_id % 2 as varchar) as sex, sample_id as patient, 30 + (sample_id * 7) % 50 as age from (select distinct o_orderkey % 100 as sample_id from orders) s
"""
FRAGMENTS["subjects"] = """
select c_custkey as sample_id, case when c_acctbal > 4500 then 'B' else 'A' end as cohort, cast(c_nationkey % 4 as varchar) as batch, c_mktsegment as material,
  cast(c_custkey % 2 as varchar) as sex, c_custkey as patient, 20 + c_custkey % 60 as age from customer
"""
FRAGMENTS["scored"] = "select c_custkey as sample_id, y, ((c_custkey * 31) % 101 + 20 * y) / 121.0 as p from (select *, case when c_acctbal > 4500 then 1 else 0 end as y from customer) c"
FRAGMENTS["preds"] = """
select c_custkey as sample_id, y, r as outer_repeat, (c_custkey + r) % 5 + 1 as outer_fold, 'M' || m as model, ((c_custkey * 31 + r * 17 + m * 7) % 101 + 10 * y * m) / 131.0 as p, 0.5 as threshold
from (select *, case when c_acctbal > 4500 then 1 else 0 end as y from customer) c, range(1, 21) t(r), range(0, 4) u(m)
"""
FRAGMENTS["coefs"] = """
select event_type as model, 'f' || user_id as feature_name, event_id % 100 as task, case when abs(sum(value) - 35) < 15 then 0.0 else sum(value) - 35 end as coefficient from events group by 1, 2, 3
"""
_RATES = """case when tp + fp + fn + tn = 0 then 0 else (tp + tn) / (tp + fp + fn + tn) end as accuracy, case when tp + fn = 0 then 0 else tp / (tp + fn) end as sensitivity_recall,
  case when tn + fp > 0 then tn / (tn + fp) end as specificity, case when tp + fp = 0 then 0 else tp / (tp + fp) end as "precision", case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1"""


def confusion_sql(table: str, keys: str, cut: str = "0.5") -> str:
    k = f"{keys}, " if keys else ""
    g = f"group by {keys}" if keys else ""
    return f"""select *, {_RATES} from (select {k}count(*) filter (y = 0 and p < {cut}) as tn, count(*) filter (y = 0 and p >= {cut}) as fp,
      count(*) filter (y = 1 and p < {cut}) as fn, count(*) filter (y = 1 and p >= {cut}) as tp from {table} {g}) c"""


def ranking_sql(table: str, keys: str) -> str:
    """ROC AUC by average ranks, average precision by cumulative counts over distinct scores."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    g = f"group by {keys}" if keys else ""
    return f"""
select {k}1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)) as roc_auc, sum(pos * tp / (tp + fp)) / sum(pos) as pr_auc
from (select *, sum(pos) over ({part} order by p desc) as tp, sum(neg) over ({part} order by p desc) as fp
      from (select {k}p, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from {table} group by {k}p) b) c {g}"""


def threshold_sql(table: str, keys: str, extra: bool = False) -> str:
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    more = f" union all select {k}c as p, 0 as pos, 0 as neg from (select distinct {keys or '1'} from {table}) d, (values (0.0), (0.5), (1.0)) v(c)" if extra else ""
    return f"""
select *, {_RATES}, fp / (fp + tn) as fpr from (
  select {k}threshold, tp, fp, allp - tp as fn, alln - fp as tn from (
   select {k}p as threshold, sum(pos) over ({part} order by p desc) as tp, sum(neg) over ({part} order by p desc) as fp, sum(pos) over ({part}) as allp, sum(neg) over ({part}) as alln
   from (select {k}cast(p as double) as p, sum(pos) as pos, sum(neg) as neg from (select {k}p, case when y = 1 then 1 else 0 end as pos, case when y = 0 then 1 else 0 end as neg from {table}{more}) a group by {k}cast(p as double)) b) c) d"""


def rule_sql(table: str, keys: str) -> str:
    """Youden, max-F1 and sensitivity-target thresholds."""
    k = f"{keys}, " if keys else ""
    part = f"partition by {keys}" if keys else ""
    own, cut = threshold_sql(table, keys), threshold_sql(table, keys, True)
    return f"""
select {k}threshold, 'youden' as rule from (select *, row_number() over ({part} order by sensitivity_recall - fpr desc, abs(threshold - 0.5), threshold desc) as rn from ({own}) a) x where rn = 1
union all select {k}threshold, 'max_f1' as rule from (select *, row_number() over ({part} order by f1 desc, specificity desc, abs(threshold - 0.5), threshold) as rn from ({cut}) a) x where rn = 1
union all select {k}threshold, 'sensitivity_target' as rule from (select *, row_number() over ({part} order by specificity desc, "precision" desc, abs(threshold - 0.5), threshold) as rn from ({cut}) a where sensitivity_recall + 1e-12 >= 0.8) x where rn = 1"""


FRAGMENTS["rep_metrics"] = f"""
select c.*, r.roc_auc, r.pr_auc from ({confusion_sql('preds', 'outer_repeat, model')}) c join ({ranking_sql('preds', 'outer_repeat, model')}) r on c.outer_repeat = r.outer_repeat and c.model = r.model
"""
FRAGMENTS["rep_long"] = "select * from (unpivot (select outer_repeat, model, roc_auc, pr_auc, cast(sensitivity_recall as double) as sensitivity_recall, cast(specificity as double) as specificity, cast(f1 as double) as f1 from rep_metrics) on roc_auc, pr_auc, sensitivity_recall, specificity, f1 into name metric value value)"
FRAGMENTS["paired"] = """
select a.metric, a.outer_repeat, a.model as model_a, b.model as model_b, a.value as value_a, b.value as value_b, b.value - a.value as difference
from rep_long a join rep_long b on a.metric = b.metric and a.outer_repeat = b.outer_repeat and a.model < b.model
"""
FRAGMENTS["signed"] = """
select *, rank() over (partition by metric, model_a, model_b order by a) + (count(*) over (partition by metric, model_a, model_b, a) - 1) / 2 as r
from (select metric, model_a, model_b, round(difference, 12) as d, abs(round(difference, 12)) as a from paired) x where d <> 0
"""
FRAGMENTS["wilcoxon"] = """
select p.metric, p.model_a, p.model_b, coalesce(w_plus, 0) as w_plus, coalesce(w_minus, 0) as w_minus, coalesce(n_nonzero, 0) as n_nonzero, least(coalesce(w_plus, 0), coalesce(w_minus, 0)) as statistic,
  case when coalesce(w_plus + w_minus, 0) = 0 then 0 else (w_plus - w_minus) / (w_plus + w_minus) end as rank_biserial
from (select distinct metric, model_a, model_b from paired) p left join (select metric, model_a, model_b, coalesce(sum(r) filter (d > 0), 0) as w_plus, coalesce(sum(r) filter (d < 0), 0) as w_minus, count(*) as n_nonzero
  from signed group by 1, 2, 3) s on p.metric = s.metric and p.model_a = s.model_a and p.model_b = s.model_b
"""
FRAGMENTS["inc_diversity"] = diversity_sql("sample_id", "inc")
FRAGMENTS["inc_evenness"] = evenness_sql("sample_id", "inc")
