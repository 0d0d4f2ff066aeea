"""Checked queries: scalar projections, clone table, quality control."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonespan.functions import scalars as S
from clonespan.functions import sequences as Q
from clonespan.operators import clones as C
from clonespan.operators.ranking import exact_quantiles
from clonespan.sources import readers as R

from .registry import query
from .sql_views import _AA
from .views import LOWER


def parsed(v):
    return C.classify(v.nt_clones)


def parsed_lines(v):
    return C.parse_tokens(R.clone_tokens(v.nt_lines))


@query("src1_clone_lines", "sample_id cdr3_nt read_count:i input_frequency:4 input_cell_frequency:4 reason n:i", """
    select sample_id, cdr3_nt, read_count, input_frequency, input_cell_frequency, reason, count(*) as n from line_parsed group by all""")
def _(v):
    keys = ["sample_id", "cdr3_nt", "read_count", "input_frequency", "input_cell_frequency", "reason"]
    return parsed_lines(v).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("src2_sample_ids", "sample_id files:i", r"""
    select regexp_extract(url, 'http://([^/]*)\.example\.com/.*$', 1) as sample_id, count(*) as files from pages
    where regexp_extract(url, 'http://([^/]*)\.example\.com/.*$', 1) <> '' group by 1""")
def _(v):
    host = F.regexp_extract("url", "^http://([^/]*)/.*$", 1)
    ids = R.sample_id_from_name(host, ".example.com")
    return v.table("pages").select(ids.alias("sample_id")).filter("sample_id <> ''").groupBy("sample_id").agg(F.count(F.lit(1)).alias("files"))


@query("src3_sample_metadata", "sample_id cohort batch material sex age:i", """
    select c_custkey as sample_id, case when c_acctbal > 4500 then 'B' else 'A' end as cohort, cast(c_nationkey % 4 as varchar) as batch,
      c_mktsegment as material, cast(c_custkey % 2 as varchar) as sex, 20 + c_custkey % 60 as age from customer""")
def _(v):
    return R.clean_metadata(v.subjects.withColumn("Unnamed: 0", F.lit(1)).withColumn("material", F.concat(F.lit(" "), F.col("material"))))


@query("src4_paired_metadata", "patient receptor library_id cohort", """
    select c_custkey as patient, r.receptor, case r.receptor when 'F' then 'F' || c_custkey else 'O' || (c_custkey + 7) end as library_id,
      case when c_acctbal > 4500 then 'B' else 'A' end as cohort from customer, (values ('F'), ('O')) r(receptor)""")
def _(v):
    paired = v.subjects.select(
        "patient", "cohort", F.concat(F.lit("F"), F.col("patient").cast("string")).alias("f_library"),
        F.concat(F.lit("O"), (F.col("patient") + 7).cast("string")).alias("o_library"),
    )
    return R.unpivot_receptors(paired, "patient", {"F": "f_library", "O": "o_library"}, ["cohort"])


@query("src4_batch_disagreement", "patient batch split_batch", """
    select c_custkey as patient, cast(c_nationkey % 4 as varchar) as batch, cast((c_nationkey + c_custkey // 500) % 4 as varchar) as split_batch
    from customer where c_nationkey % 4 <> (c_nationkey + c_custkey // 500) % 4""")
def _(v):
    c = v.table("customer").select(
        F.col("c_custkey").alias("patient"), (F.col("c_nationkey") % 4).cast("string").alias("batch"),
        ((F.col("c_nationkey") + F.floor(F.col("c_custkey") / 500)) % 4).cast("string").alias("split_batch"),
    )
    return R.paired_batch_disagreement(c)


@query("src5_coerced_table", "column_name missing:i mean_value:6", """
    select 'size_text' as column_name, count(*) filter (v is null) as missing, avg(v) as mean_value
    from (select try_cast(case when p_size % 7 = 0 then 'n/a' else ' ' || p_size || ' ' end as double) as v from part) x""")
def _(v):
    text = F.when(F.col("p_size") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")))
    t = R.coerce_numeric(v.table("part").select(text.alias("size_text")), ["size_text"])
    return t.agg(F.lit("size_text").alias("column_name"), S.count_if(F.col("size_text").isNull()).alias("missing"), F.avg("size_text").alias("mean_value"))


@query("src6_manifest_status", "dataset status n:i", """
    select dataset, status, count(*) as n from (
      select case when c_custkey % 3 = 0 then 'test' else 'train' end as dataset,
        case when c_custkey not in (select o_custkey from orders) then 'MISSING'
             when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'EXISTS' else 'PLANNED' end as status from customer) x group by all""")
def _(v):
    man = v.subjects.select("sample_id", F.when(F.col("sample_id") % 3 == 0, "test").otherwise("train").alias("dataset"))
    o = v.table("orders").withColumnRenamed("o_custkey", "sample_id")
    return R.status_counts(R.resolve_manifest(man, o, o.filter("o_orderstatus = 'P'"), "sample_id"), ["dataset"])


# -- scalar projections ----------------------------------------------------------------------------------------------

@query("scl1_normalize_nt", "cdr3_nt n:i", """
    select translate(upper(trim(raw)), 'U', 'T') as cdr3_nt, count(*) as n
    from (select ' ' || translate(substr(md5(cast(l_partkey as varchar)), 1, 9), '0123456789abcdef', 'acguACGUacgtACGT') || ' ' as raw from lineitem) x group by 1""")
def _(v):
    raw = F.concat(F.lit(" "), F.translate(F.substring(F.md5(F.col("l_partkey").cast("string")), 1, 9), "0123456789abcdef", "acguACGUacgtACGT"), F.lit(" "))
    return v.table("lineitem").groupBy(Q.normalize_nt(raw).alias("cdr3_nt")).agg(F.count(F.lit(1)).alias("n"))


@query("scl2_translate", "cdr3_nt aa n:i", f"""
    select cdr3_nt, {_AA} as aa, n from (select cdr3_nt, count(*) as n from nt_clones where len(cdr3_nt) % 3 = 0 group by 1) x, codon_map""")
def _(v):
    c = v.nt_clones.filter(F.length("cdr3_nt") % 3 == 0).groupBy("cdr3_nt").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("aa", Q.translate_nt("cdr3_nt"))


@query("scl3_invalid_reason", "reason n:i", "select coalesce(reason, 'valid') as reason, count(*) as n from line_parsed group by 1")
def _(v):
    return parsed_lines(v).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("scl4_numeric_tokens", "token as_int:i as_float:6 n:i", r"""
    select token, case when f = floor(f) then cast(f as bigint) end as as_int, f as as_float, n from (
      select token, case when regexp_full_match(token, '[+-]?[0-9]+\.?[0-9]*') and cast(token as double) >= 0 then cast(token as double) end as f, n from (
        select case when l_linenumber % 4 = 0 then '-' || cast(l_quantity as varchar) when l_linenumber % 4 = 1 then 'x' || l_linenumber
          when l_linenumber % 4 = 2 then cast(l_discount as varchar) else cast(l_quantity as varchar) end as token, count(*) as n from lineitem group by 1) x) y""")
def _(v):
    ln = F.col("l_linenumber")
    tok = F.when(ln % 4 == 0, F.concat(F.lit("-"), F.col("l_quantity").cast("string"))).when(ln % 4 == 1, F.concat(F.lit("x"), ln.cast("string"))).when(
        ln % 4 == 2, F.col("l_discount").cast("string")).otherwise(F.col("l_quantity").cast("string"))
    g = v.table("lineitem").groupBy(tok.alias("token")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("token", "n", S.parse_nonnegative_int("token").alias("as_int"), S.parse_nonnegative_float("token").alias("as_float"))


@query("scl5_valid_sequences", "sample_id valid:i invalid:i", """
    select source as sample_id, count(*) filter (ok) as valid, count(*) filter (not ok) as invalid
    from (select source, regexp_full_match(w, '[ACDEFGHIKLMNPQRSTVWY]+') and len(w) = least(len(w), 9) as ok
          from (select source, unnest(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ')) as w from documents) x) y group by 1""")
def _(v):
    w = v.table("documents").select("source", F.explode(F.split(F.translate("text", LOWER, LOWER.upper()), " ")).alias("w"))
    ok = Q.is_valid_aa("w", F.least(F.length("w"), F.lit(9)))
    return w.groupBy(F.col("source").alias("sample_id")).agg(S.count_if(ok).alias("valid"), S.count_if(~ok).alias("invalid"))


@query("scl6_distinct_kmers", "sample_id kmer n:i", """
    select sample_id, kmer, count(*) as n from (select distinct sample_id, cdr3_aa, substr(cdr3_aa, i, 3) as kmer
      from (select *, unnest(range(1, len(cdr3_aa) - 1)) as i from seqs) x) y group by 1, 2""")
def _(v):
    return v.seqs.select("sample_id", F.explode(Q.distinct_kmers("cdr3_aa")).alias("kmer")).groupBy("sample_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


@query("scl7_residue_ratios", "sample_id " + " ".join(f"ratio_{r}:8" for r in Q.RESIDUES),
       "select sample_id, " + ", ".join(f"sum((len(cdr3_aa) - len(replace(cdr3_aa, '{r}', ''))) / len(cdr3_aa)) as \"ratio_{r}\"" for r in Q.RESIDUES) + " from seqs group by 1")
def _(v):
    return v.seqs.groupBy("sample_id").agg(*[F.sum(Q.residue_ratio("cdr3_aa", r)).alias(f"ratio_{r}") for r in Q.RESIDUES])


@query("scl8_to_scl11_physico", "sample_id cdr3_aa hydrophobicity:8 charge:8 aromaticity:8 basic:8 acidic:8 polar:8 nonpolar:8",
       "select sample_id, cdr3_aa, hydrophobicity, charge, aromaticity, basic, acidic, polar, nonpolar from seq_scores")
def _(v):
    groups = [Q.residue_ratio("cdr3_aa", letters).alias(g) for g, letters in Q.RESIDUE_GROUPS.items()]
    return v.seqs.select(
        "sample_id", "cdr3_aa", Q.hydrophobicity("cdr3_aa").alias("hydrophobicity"), Q.charge("cdr3_aa").alias("charge"),
        Q.aromaticity("cdr3_aa").alias("aromaticity"), *groups,
    )


@query("scl12_scl13_ratios", "sample_id ratio:8 delta:8 log_ratio:8", """
    select o_custkey as sample_id, case when b = 0 then 0.0 else a / b end as ratio, a - b as delta, ln((a + 1e-8) / (b + 1e-8)) as log_ratio
    from (select o_custkey, sum(case when o_orderstatus = 'F' then o_totalprice else 0 end) / 1e6 as a,
                 sum(case when o_orderstatus = 'P' then o_totalprice else 0 end) / 1e6 as b from orders group by 1) x""")
def _(v):
    o = v.table("orders").groupBy(F.col("o_custkey").alias("sample_id")).agg(
        (S.sum_if(F.col("o_orderstatus") == "F", "o_totalprice") / 1e6).alias("a"), (S.sum_if(F.col("o_orderstatus") == "P", "o_totalprice") / 1e6).alias("b"))
    return o.select("sample_id", S.safe_ratio("a", "b").alias("ratio"), (F.col("a") - F.col("b")).alias("delta"), S.log_ratio("a", "b").alias("log_ratio"))


@query("scl14_label_encoding", "label:i n:i", """
    select case when upper(trim(c_mktsegment)) = 'BUILDING' then 1 else 0 end as label, count(*) as n from customer group by 1""")
def _(v):
    t = v.table("customer").select(F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("s"))
    return t.groupBy(S.encode_label("s", "building").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("scl15_joint_key", "joint_key n:i", """
    select c_mktsegment || ' || ' || case when c_nationkey % 5 = 0 then '__MISSING__' else cast(c_nationkey as varchar) end as joint_key, count(*) as n from customer group by 1""")
def _(v):
    t = v.table("customer").select("c_mktsegment", F.when(F.col("c_nationkey") % 10 == 5, F.lit(" ")).when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("nation"))
    return t.groupBy(S.joint_key(["c_mktsegment", "nation"]).alias("joint_key")).agg(F.count(F.lit(1)).alias("n"))


@query("scl16_scl17_thresholds", "sample_id n:i global_threshold:i group_threshold:i train_size:i", """
    select l_partkey as sample_id, count(*) as n, greatest(3, cast(ceil(0.02 * count(*)) as bigint)) as global_threshold,
      greatest(3, cast(ceil(0.05 * count(*)) as bigint)) as group_threshold,
      case when count(*) = 1 then 1 else least(greatest(cast(floor(count(*) * cast(0.7 as double) + 0.5) as bigint), 1), count(*) - 1) end as train_size
    from lineitem group by 1""")
def _(v):
    t = v.table("lineitem").groupBy(F.col("l_partkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("*", S.count_threshold("n", 0.02, 3).alias("global_threshold"), S.count_threshold("n", 0.05, 3).alias("group_threshold"), S.stratum_train_size("n", 0.7).alias("train_size"))


@query("scl18_parse_bool", "flag:b n:i", """
    select o_orderstatus in ('F', 'O') as flag, count(*) as n from orders group by 1""")
def _(v):
    t = F.when(F.col("o_orderstatus") == "F", " True").when(F.col("o_orderstatus") == "O", "YES ").otherwise("0")
    return v.table("orders").groupBy(S.parse_bool(t).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("scl23_threshold_bins", "bin n:i", """
    select case when threshold < 0.2 then '[0.0, 0.2)' when threshold < 0.3 then '[0.2, 0.3)' when threshold < 0.4 then '[0.3, 0.4)' when threshold < 0.5 then '[0.4, 0.5)'
      when threshold < 0.6 then '[0.5, 0.6)' when threshold < 0.7 then '[0.6, 0.7)' when threshold < 0.8 then '[0.7, 0.8)' else '[0.8, 1.000001)' end as bin, count(*) as n
    from params group by 1""")
def _(v):
    return v.params.groupBy(S.threshold_bin("threshold").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("scl24_grid_steps", "lambda:4 snapped:4 next_up:6 next_down:6 n:i", """
    select "lambda", "lambda" as snapped, case when m < 1.5 then 3 * s when m < 5 then 10 * s else 30 * s end as next_up,
      case when m >= 7 then 3 * s when m >= 2 then s else 3 * s / 10 end as next_down, n
    from (select *, "lambda" / s as m from (select "lambda", pow(10.0, floor(log10("lambda"))) as s, count(*) as n from params group by 1) x) y""")
def _(v):
    t = v.params.groupBy("lambda").agg(F.count(F.lit(1)).alias("n"))
    return t.select("*", S.snap_to_grid(F.col("lambda") + 1e-12, [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0]).alias("snapped"),
                    S.series_step("lambda", 1).alias("next_up"), S.series_step("lambda", -1).alias("next_down"))


@query("scl25_derived_seed", "sample_id seed:i", """
    select c_custkey as sample_id, cast('0x' || substr(md5('7|' || c_custkey || '|' || c_nationkey), 1, 8) as bigint) as seed from customer""")
def _(v):
    return v.table("customer").select(F.col("c_custkey").alias("sample_id"), S.derived_seed(7, "c_custkey", "c_nationkey").alias("seed"))


@query("scl26_receptor_prefix", "sample_id f_x1:7 f_x2:7 o_x1:7 o_x2:7", """
    select sample_id, x1 as f_x1, x2 as f_x2, x1 as o_x1, x2 as o_x2 from matrix""")
def _(v):
    f = S.prefix_columns(v.matrix.select("sample_id", "x1", "x2"), "f_", ["sample_id"])
    return (
        f.join(S.prefix_columns(S.strip_prefix(f, "f_"), "o_", ["sample_id"]), "sample_id"))


@query("scl27_fixed_precision", "value_text n:i", """
    select printf('%.12g', l_extendedprice / 7) as value_text, count(*) as n from lineitem group by 1""")
def _(v):
    return v.table("lineitem").groupBy(S.fixed_precision_text(F.col("l_extendedprice") / 7).alias("value_text")).agg(F.count(F.lit(1)).alias("n"))


# -- clone table -----------------------------------------------------------------------------------------------------

CLONE_SPEC = "sample_id cdr3_aa aa_length:i nt_clone_number:i read_count:i read_fraction:8 input_frequency_sum:6 input_cell_frequency_sum:6 frequency:6 frequency_norm:8 top_nt_cdr3"


@query("agg1_aa_clone_table", CLONE_SPEC, "select * from aa_table")
def _(v):
    return C.aa_clone_table(parsed(v))


@query("agg2_top_variant", "sample_id cdr3_aa top_nt_cdr3", "select sample_id, cdr3_aa, top_nt_cdr3 from aa_sums")
def _(v):
    return C.aa_clone_sums(parsed(v))


@query("agg3_frequency_source", "sample_id total_reads_valid_nt:i frequency_source frequency_sum:6", "select * from aa_totals_lines")
def _(v):
    return C.choose_frequency_source(C.aa_clone_sums(parsed_lines(v)))


@query("agg4_normalised_frequency", "sample_id cdr3_aa read_fraction:8 frequency_norm:8", "select * from aa_table_lines")
def _(v):
    return C.aa_clone_table(parsed_lines(v))


SUMMARY_SPEC = ("sample_id input_nt_rows:i valid_nt_rows:i total_reads_all_nt:i total_reads_valid_nt:i malformed_columns_rows:i invalid_read_count_rows:i "
                "invalid_frequency_rows:i length_not_multiple_of_3_rows:i non_acgt_base_rows:i stop_codon_rows:i unique_valid_nt_clones:i aa_clone_number:i "
                "frequency_source frequency_sum:6 valid_nt_row_ratio:8 valid_read_ratio:8 aa_clone_reduction_ratio:8")


@query("agg5_sample_summary", SUMMARY_SPEC, "select * from aa_summary_lines")
def _(v):
    return C.sample_summary(parsed_lines(v))


@query("agg6_invalid_summary", "translate_status invalid_nt_rows:i invalid_nt_row_ratio_among_invalid:8 invalid_read_count:i invalid_read_ratio_among_invalid:8 invalid_read_ratio_among_all_reads:8 rows_without_parseable_reads:i", """
    select d.reason as translate_status, coalesce(x.n, 0) as invalid_nt_rows, coalesce(x.n, 0) / t.n as invalid_nt_row_ratio_among_invalid,
      coalesce(x.r, 0) as invalid_read_count, coalesce(x.r, 0) / t.r as invalid_read_ratio_among_invalid, coalesce(x.r, 0) / t.a as invalid_read_ratio_among_all_reads,
      coalesce(x.z, 0) as rows_without_parseable_reads
    from (values ('malformed_columns'), ('invalid_read_count'), ('invalid_frequency'), ('empty_sequence'), ('length_not_multiple_of_3'), ('non_acgt_base'), ('stop_codon')) d(reason)
    left join (select reason, count(*) as n, coalesce(sum(read_count), 0) as r, count(*) filter (read_count is null) as z from line_parsed group by 1) x on d.reason = x.reason,
    (select count(*) filter (reason is not null) as n, sum(read_count) filter (reason is not null) as r, sum(read_count) as a from line_parsed) t""")
def _(v):
    return C.invalid_summary(parsed_lines(v))


@query("agg7_invalid_by_sample", "sample_id translate_status invalid_nt_rows:i invalid_read_count:i rows_without_parseable_reads:i", """
    select sample_id, reason as translate_status, count(*) as invalid_nt_rows, coalesce(sum(read_count), 0) as invalid_read_count,
      count(*) filter (read_count is null) as rows_without_parseable_reads from line_parsed where reason is not null group by 1, 2""")
def _(v):
    return C.invalid_by_sample(parsed_lines(v))


@query("agg8_normalisation_check", "sample_id frequency_norm_sum:6 read_fraction_sum:6 normalisation_pass:b", """
    select sample_id, sum(frequency_norm) as frequency_norm_sum, sum(read_fraction) as read_fraction_sum,
      abs(sum(frequency_norm) - 1) <= 1e-6 and abs(sum(read_fraction) - 1) <= 1e-6 as normalisation_pass from aa_table group by 1""")
def _(v):
    return C.normalisation_check(C.aa_clone_table(parsed(v)))


@query("agg9_cohort_ratios", "mean_ratio:8 median_ratio:8 min_ratio:8 max_ratio:8", """
    select avg(valid_read_ratio) as mean_ratio, quantile_cont(valid_read_ratio, 0.5) as median_ratio, min(valid_read_ratio) as min_ratio, max(valid_read_ratio) as max_ratio from aa_summary""")
def _(v):
    s = C.row_counters(parsed(v)).withColumn("ratio", S.safe_ratio("total_reads_valid_nt", "total_reads_all_nt"))
    med = exact_quantiles(s, [], "ratio", {"median_ratio": 0.5})
    return s.agg(F.avg("ratio").alias("mean_ratio"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio")).select("*", med.scalar().alias("median_ratio"))


@query("agg10_receptor_overview", "receptor samples:i qc_pass:i qc_fail:i with_warning:i total_aa_clones:i", """
    select receptor, count(*) as samples, count(*) filter (qc_pass_01) as qc_pass, count(*) filter (not qc_pass_01) as qc_fail,
      count(*) filter (has_warning_01) as with_warning, sum(aa_clone_number) as total_aa_clones from aa_verdict2 group by 1""")
def _(v):
    return C.receptor_overview(C.sample_summary(parsed(v), ["receptor", "sample_id"]))


# -- filters and order -----------------------------------------------------------------------------------------------

@query("flt1_invalid_policy_skip", "sample_id rows:i reads:i", "select sample_id, count(*) as rows, sum(read_count) as reads from line_parsed where reason is null group by 1")
def _(v):
    return C.apply_invalid_policy(parsed_lines(v)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("read_count").alias("reads"))


@query("flt2_quality_verdict", "sample_id qc_pass_01:b has_warning_01:b qc_warning_01", "select * from aa_verdict_lines")
def _(v):
    return C.sample_summary(parsed_lines(v))


@query("flt3_excluded_samples", "sample_id", "select sample_id from aa_verdict_lines where not qc_pass_01")
def _(v):
    return C.excluded_samples(C.sample_summary(parsed_lines(v)))


@query("win5_first_invalid_rows", "reason rank:i orderkey linenumber cdr3_nt", """
    select * from (select reason, orderkey, linenumber, cdr3_nt, row_number() over (partition by reason order by orderkey, linenumber, cdr3_nt) as rank
      from nt_parsed where reason is not null) x where rank <= 5""")
def _(v):
    bad = parsed(v).filter("reason is not null")
    return C.first_per_group(bad, ["reason"], [F.col("orderkey"), F.col("linenumber"), F.col("cdr3_nt")], 5)


@query("top1_lowest_quality", "sample_id valid_read_ratio:8", "select sample_id, valid_read_ratio from aa_summary order by valid_read_ratio, sample_id limit 10")
def _(v):
    s = C.row_counters(parsed(v)).withColumn("valid_read_ratio", S.safe_ratio("total_reads_valid_nt", "total_reads_all_nt"))
    return C.lowest_quality(s, "valid_read_ratio", 10)
