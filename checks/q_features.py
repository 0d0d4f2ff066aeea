"""Checked queries: sample-level features and k-mer vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from clonespan.functions.sequences import RESIDUES
from clonespan.operators import clones as C
from clonespan.operators import features as X
from clonespan.operators.ranking import ordered_ranks
from clonespan.session import materialize

from .q_clones import parsed
from .registry import query
from .sql_views import FRAGMENTS, composition_sql, diversity_sql, evenness_sql, length_sql

KEY = ["sample_id"]


def spec(names, digits=8):
    return " ".join(f"{n}:{digits}" for n in names)


def n_samples(v):
    return v.clones.select("sample_id").distinct().agg(F.count(F.lit(1)).alias("n_samples"))


def vocabulary(v, kmers=None, **kw):
    return X.kmer_vocabulary(X.kmer_features(v.clones, KEY) if kmers is None else kmers, n_samples(v), **kw)


def summary(v):
    """Step-01 style summary of the document clones."""
    return v.seqs.groupBy("sample_id").agg(
        F.sum("read_count").alias("total_reads_valid_nt"), F.sum("nt_clone_number").alias("unique_valid_nt_clones"), F.count(F.lit(1)).alias("aa_clone_number"),
        (F.sum("read_count") * 2).alias("total_reads_all_nt"), (F.sum("nt_clone_number") * 4).alias("input_nt_rows"), F.lit(0.25).alias("valid_nt_row_ratio"),
    )


@query("fea1_diversity", "sample_id Shannon:8 Simpson:10 inverse_Simpson:6", "select * from diversity")
def _(v):
    return X.diversity(v.clones, KEY)


@query("fea1_diversity_incidence", "sample_id Shannon:8 Simpson:10 inverse_Simpson:6 clonality:8", diversity_sql("sample_id", "inc"))
def _(v):
    return X.diversity(v.inc, KEY)


@query("fea2_clonality", "sample_id clonality:8", "select * from diversity")
def _(v):
    return X.diversity(v.clones, KEY)


@query("fea3_gini", "sample_id Gini:8", "select * from evenness")
def _(v):
    return X.gini(v.clones, KEY)


@query("fea4_top_k", "sample_id " + spec(X.TOP_NAMES.values(), 10), "select * from evenness")
def _(v):
    return X.top_k(v.clones, KEY)


@query("fea4_top_k_incidence", "sample_id Gini:8 " + spec(X.TOP_NAMES.values(), 10), evenness_sql("sample_id", "inc"))
def _(v):
    return X.evenness_and_expansion(v.inc, KEY)


@query("fea5_length_statistics", "sample_id " + spec(X.LENGTH_STATS, 6), "select * from lengths")
def _(v):
    return X.length_statistics(v.clones, KEY)


@query("fea6_length_histogram", "sample_id " + spec(X.LENGTH_NAMES), "select * from lengths")
def _(v):
    return X.length_histogram(v.clones, KEY)


@query("fea7_composition", "sample_id " + spec(X.COMPOSITION_NAMES), "select * from composition")
def _(v):
    return X.composition(v.clones, KEY)


@query("fea8_physico", "sample_id " + spec(X.PHYSICO_NAMES), "select * from physico")
def _(v):
    return X.physico(v.clones, KEY)


@query("fea9_kmers", "sample_id kmer clones_with_kmer:i unweighted_value:8 weighted_value:8", "select * from kmers")
def _(v):
    return X.kmer_features(v.clones, KEY)


VOCAB = "kmer training_sample_count:i training_sample_prevalence:8 mean_unweighted_value:8 mean_weighted_value:8 variance_unweighted_value:10 variance_weighted_value:10"


@query("fea10_vocabulary_statistics", VOCAB, "select * from vocab_stats")
def _(v):
    return vocabulary(v)


@query("flt4_vocabulary_filter", "kmer keep:b filter_reason", "select * from vocab")
def _(v):
    return vocabulary(v)


@query("win1_vocabulary_rank", "vocabulary_rank:i kmer keep:b", "select * from vocab_ranked")
def _(v):
    return vocabulary(v)


@query("win2_vocabulary_cap", "kmer keep:b filter_reason", """
    select kmer, keep and rn <= 100 as keep, case when keep and rn > 100 then 'excluded_by_max_kmers' else filter_reason end as filter_reason
    from (select *, row_number() over (partition by keep order by training_sample_prevalence desc, round(variance_unweighted_value + variance_weighted_value, 14) desc, kmer) as rn from vocab) x""")
def _(v):
    return vocabulary(v, max_kmers=100)


@query("join5_vocabulary_semi_join", "sample_id kmer unweighted_value:8 weighted_value:8", "select k.* from kmers k where kmer in (select kmer from vocab where keep)")
def _(v):
    kmers = materialize(X.kmer_features(v.clones, KEY))
    return X.in_vocabulary(kmers, vocabulary(v, kmers)).select("sample_id", "kmer", "unweighted_value", "weighted_value")


@query("fea11_kmer_matrix", "sample_id kmer value:8", """
    select s.sample_id, w.kmer, coalesce(k.unweighted_value, 0) as value from (select distinct sample_id from clones) s, (select kmer from vocab where keep) w
    left join kmers k on k.sample_id = s.sample_id and k.kmer = w.kmer""")
def _(v):
    kmers = materialize(X.kmer_features(v.clones, KEY))
    names = X.retained_kmers(vocabulary(v, kmers))
    cells = X.kmer_vectors(v.clones.select("sample_id").distinct(), kmers, names, ["unweighted_value"])
    labels = F.array(*[F.lit(n) for n in names])
    return cells.select("sample_id", F.inline(F.arrays_zip(labels, "unweighted_value"))).toDF("sample_id", "kmer", "value")


CORE = [*X.DEPTH_NAMES, *X.DIVERSITY_NAMES, *X.TOP_NAMES.values(), *X.LENGTH_STATS, *X.LENGTH_NAMES, *X.COMPOSITION_NAMES, *X.PHYSICO_NAMES]
FRAGMENTS["core"] = """
select d.*, e.* exclude (sample_id), l.* exclude (sample_id), c.* exclude (sample_id), p.* exclude (sample_id), s.* exclude (sample_id), ln(1 + d.aa_clone_number) as log1p_aa_clone_number
from diversity d join evenness e on d.sample_id = e.sample_id join lengths l on d.sample_id = l.sample_id join composition c on d.sample_id = c.sample_id
join physico p on d.sample_id = p.sample_id join (select sample_id, sum(read_count) * 2 as total_reads_all_nt, sum(read_count) as total_reads_valid_aa, 0.5 as valid_read_ratio,
  sum(nt_clone_number) * 4 as nt_clone_number_all, sum(nt_clone_number) as valid_nt_clone_number, 0.25 as valid_nt_row_ratio from seqs group by 1) s on d.sample_id = s.sample_id
"""


@query("fea12_core_table", "sample_id " + spec(CORE, 6), "select * from core")
def _(v):
    return X.core_table(v.clones, summary(v), KEY)


@query("fea13_merged_matrix", "sample_id columns:i Shannon:8 plain_sum:6 weighted_sum:6", """
    select c.sample_id, 97 + 2 * (select count(*) from vocab where keep) as columns, c.Shannon, k.plain_sum, k.weighted_sum from core c
    join (select sample_id, sum(unweighted_value) as plain_sum, sum(weighted_value) as weighted_sum from kmers where kmer in (select kmer from vocab where keep) group by 1) k on c.sample_id = k.sample_id""")
def _(v):
    kmers = materialize(X.kmer_features(v.clones, KEY))
    names = X.retained_kmers(vocabulary(v, kmers))
    m = X.merged_matrix(X.core_table(v.clones, summary(v), KEY), kmers, names)
    added = "aggregate(array({}), 0D, (a, b) -> a + b)"
    plain, weighted = [F.expr(added.format(", ".join(f"`{w}_3mer_{n}`" for n in names))) for w in ("unweighted", "weighted")]
    return m.select("sample_id", F.lit(len(m.columns)).alias("columns"), "Shannon", plain.alias("plain_sum"), weighted.alias("weighted_sum"))


@query("fea14_summary_cross_check", "sample_id summary_mismatch_count:i summary_mismatch_detail", """
    select sample_id, case when sum(read_count) % 3 = 0 then 1 else 0 end as summary_mismatch_count, case when sum(read_count) % 3 = 0 then 'total_reads_valid_aa' else '' end as summary_mismatch_detail
    from clones group by 1""")
def _(v):
    s = summary(v)
    r = F.col("total_reads_valid_nt")
    return X.summary_mismatches(v.clones, s.withColumn("total_reads_valid_nt", F.when(r % 3 == 0, r + 1).otherwise(r)), KEY)


@query("fea15_build_log", "sample_id aa_clone_number:i total_reads_valid_aa:i valid_nt_clone_number:i frequency_norm_sum_input:6 top1_frequency:8 nonzero_unweighted_3mers:i nonzero_weighted_3mers:i", """
    select c.*, k.n as nonzero_unweighted_3mers, k.m as nonzero_weighted_3mers from (
      select sample_id, count(*) as aa_clone_number, sum(read_count) as total_reads_valid_aa, sum(nt_clone_number) as valid_nt_clone_number,
        sum(frequency_norm) as frequency_norm_sum_input, max(frequency_norm) as top1_frequency from clones group by 1) c
    join (select sample_id, count(*) as n, count(*) filter (weighted_value > 0) as m from kmers group by 1) k on c.sample_id = k.sample_id""")
def _(v):
    return X.build_log(v.clones, X.kmer_features(v.clones, KEY), KEY)


@query("fea16_filter_reasons", "filter_reason kmers:i", "select filter_reason, count(*) as kmers from vocab group by 1")
def _(v):
    return X.filter_reason_counts(vocabulary(v))


PAIR = "receptor, sample_id"
FRAGMENTS["pair_features"] = f"""
select d.*, e.* exclude (receptor, sample_id), l.* exclude (receptor, sample_id), c.* exclude (receptor, sample_id)
from ({diversity_sql(PAIR, 'aa_table2')}) d join ({evenness_sql(PAIR, 'aa_table2')}) e on d.receptor = e.receptor and d.sample_id = e.sample_id
join ({length_sql(PAIR, 'aa_table2')}) l on d.receptor = l.receptor and d.sample_id = l.sample_id
join ({composition_sql(PAIR, 'aa_table2')}) c on d.receptor = c.receptor and d.sample_id = c.sample_id
"""
PAIR_COLS = [*X.DIVERSITY_NAMES, *X.TOP_NAMES.values(), *X.LENGTH_STATS, *[f"{r}_frequency" for r in RESIDUES]]


@query("fea17_paired_features", "receptor sample_id " + spec(PAIR_COLS, 7), "select * from pair_features")
def _(v):
    keys = ["receptor", "sample_id"]
    rows = parsed(v)
    return X.core_table(C.aa_clone_table(rows, keys), C.sample_summary(rows, keys), keys)


@query("win3_clone_order", "sample_id cdr3_aa clone_rank:i", """
    select sample_id, cdr3_aa, row_number() over (partition by sample_id order by read_count desc, cdr3_aa) as clone_rank from clones""")
def _(v):
    return ordered_ranks(v.clones, KEY, [F.col("read_count").desc(), F.col("cdr3_aa")], "clone_rank").select("sample_id", "cdr3_aa", "clone_rank")
