"""Sample-level features of a clone table: diversity, expansion, length, composition, physico-chemistry, 3-mers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import join_reasons, safe_ratio, total
from ..functions.sequences import HYDROPHOBICITY, RESIDUE_GROUPS, RESIDUES
from .ranking import attach_totals, running_totals, small_share_level, value_blocks

# Cut-offs and ranges of the published feature set.
TOP_K = [1, 5, 10, 20, 50]
LENGTH_RANGE = range(8, 26)

TOP_NAMES = {k: "top1_frequency" if k == 1 else f"top{k}_cumulative_frequency" for k in TOP_K}
LENGTH_NAMES = [f"weighted_length_{n}_freq" for n in LENGTH_RANGE] + ["weighted_length_other_freq"]
DEPTH_NAMES = [
    "total_reads_all_nt", "total_reads_valid_aa", "valid_read_ratio", "nt_clone_number_all", "valid_nt_clone_number",
    "valid_nt_row_ratio", "aa_clone_number", "log1p_aa_clone_number",
]
DIVERSITY_NAMES = ["Shannon", "Simpson", "inverse_Simpson", "Gini", "clonality"]
LENGTH_STATS = ["mean_aa_length", "median_aa_length", "sd_aa_length", "weighted_mean_aa_length", "weighted_sd_aa_length"]
COMPOSITION_NAMES = [f"{r}_frequency" for r in RESIDUES] + [f"weighted_{r}_frequency" for r in RESIDUES]
PHYSICO_NAMES = [
    "mean_hydrophobicity", "weighted_hydrophobicity", "mean_charge", "weighted_charge", "aromaticity", "weighted_aromaticity",
] + [f"{w}{g}_aa_ratio" for g in RESIDUE_GROUPS for w in ("", "weighted_")]


def diversity(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    """Shannon, Simpson (the concentration sum p^2), inverse Simpson and clonality."""
    x = F.col(p)
    sums = clones.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aa_clone_number"),
        F.sum(F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0))).alias("Shannon"),
        F.sum(x * x).alias("Simpson"),
    )
    return sums.select(*keys, "aa_clone_number", "Shannon", "Simpson", inverse_simpson(), clonality())


def inverse_simpson() -> Column:
    return F.when(F.col("Simpson") > 0, 1.0 / F.col("Simpson")).alias("inverse_Simpson")


def clonality() -> Column:
    n = F.col("aa_clone_number")
    value = F.lit(1.0) - F.col("Shannon") / F.log(n.cast("double"))
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))).alias("clonality")


def evenness_and_expansion(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    """Gini and top-k cumulative frequency.

    Clones of equal frequency fold to one block first (most clones are singletons), blocks are ranked with sliced running
    totals, so neither a hot sample nor a hot frequency value reaches a single task.
    """
    blocks = value_blocks(clones, keys, p)
    ranked = running_totals(blocks, keys, [F.col(p)], ["n"], small_share_level(p))
    sizes = blocks.groupBy(*keys).agg(F.sum("n").alias("size"), F.sum(F.col(p) * F.col("n")).alias("mass"))
    b = attach_totals(ranked, sizes, keys)
    n, before, x, size = F.col("n"), F.col("n_before"), F.col(p), F.col("size")
    rank_sum = F.sum(x * (n * before + n * (n + 1) / 2))
    above = size - before - n

    def top(k: int) -> Column:
        return F.sum(x * F.least(n, F.greatest(F.lit(k) - above, F.lit(0)))).alias(TOP_NAMES[k])

    out = b.groupBy(*keys).agg(rank_sum.alias("_r"), F.max("size").alias("_n"), F.max("mass").alias("_m"), *[top(k) for k in TOP_K])
    gini = 2.0 * F.col("_r") / (F.col("_n") * F.col("_m")) - (F.col("_n") + 1) / F.col("_n")
    gini = F.when(F.col("_m") > 0, F.least(F.greatest(gini, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return out.select(*keys, gini.alias("Gini"), *TOP_NAMES.values())


def gini(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    return evenness_and_expansion(clones, keys, p).select(*keys, "Gini")


def top_k(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    return evenness_and_expansion(clones, keys, p).select(*keys, *TOP_NAMES.values())


def _by_length(clones: DataFrame, keys: list[str], p: str, *aggs: Column) -> DataFrame:
    """One row per length of a group (lengths take few values): `_n` clones and `_w` frequency mass, and further sums.

    All that depends on lengths alone is computed from these rows; the rows of clones only meet a narrow aggregation.
    """
    return clones.groupBy(*keys, "aa_length").agg(F.count(F.lit(1)).alias("_n"), F.sum(p).alias("_w"), *aggs)


def _length_aggs() -> list[Column]:
    length, n = F.col("aa_length").cast("bigint"), F.col("_n")
    return [
        F.sum(F.when(length.isNotNull(), n)).alias("_l0"), F.sum(length * n).alias("_l1"), F.sum(length * length * n).alias("_l2"),
        F.percentile("aa_length", 0.5, n).alias("median_aa_length"),
        F.sum(F.col("_w") * length).alias("weighted_mean_aa_length"),
        F.sum(F.col("_w") * length * length).alias("_second_moment"),
    ]


def _length_finish() -> list[Column]:
    # Whole numbers until the last division, so that equal lengths have a deviation of exactly 0.
    n0, n1, n2 = [F.col(c).cast("decimal(38,0)") for c in ("_l0", "_l1", "_l2")]
    size = F.col("_l0").cast("double")
    sd = F.sqrt((n0 * n2 - n1 * n1).cast("double")) / size
    m = F.col("weighted_mean_aa_length")
    variance = F.col("_second_moment") - m * m
    # Below this share of the second moment the difference is rounding noise of the two sums.
    noise = variance <= F.lit(1e-12) * F.col("_second_moment")
    return [
        (F.col("_l1") / size).alias("mean_aa_length"), sd.alias("sd_aa_length"),
        F.when(noise, F.lit(0.0)).otherwise(F.sqrt(variance)).alias("weighted_sd_aa_length"),
    ]


def length_statistics(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    sums = _by_length(clones, keys, p).groupBy(*keys).agg(*_length_aggs())
    return sums.select("*", *_length_finish()).select(*keys, *LENGTH_STATS)


def _length_mass() -> list[Column]:
    length, w = F.col("aa_length"), F.col("_w")
    inside = [F.sum(F.when(length == n, w).otherwise(F.lit(0.0))).alias(c) for n, c in zip(LENGTH_RANGE, LENGTH_NAMES)]
    out = ~length.between(LENGTH_RANGE[0], LENGTH_RANGE[-1])
    return [*inside, F.sum(F.when(out, w).otherwise(F.lit(0.0))).alias(LENGTH_NAMES[-1])]


def length_histogram(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    return _by_length(clones, keys, p).groupBy(*keys).agg(*_length_mass())


def composition(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    """Mean and frequency-weighted share of the 20 residues; empty sequences have no shares.

    Every letter is a row of (group, length, letter), which a narrow aggregation counts; the wide table is made from its
    few rows.  The empty letter stands for the clone itself.
    """
    length = F.length("cdr3_aa")
    letters = clones.filter(length > 0).select(*keys, F.col(p).alias("_p"), "cdr3_aa", length.alias("_length"), F.explode(F.sequence(F.lit(0), length)).alias("_at"))
    letter = F.when(F.col("_at") == 0, F.lit("")).otherwise(F.substring("cdr3_aa", F.col("_at"), F.lit(1)))
    counted = letters.groupBy(*keys, "_length", letter.alias("_letter")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_p").alias("_w"))

    def of(r: str, value: Column) -> Column:
        return F.sum(F.when(F.col("_letter") == r, value))

    clone_n, no_mass = of("", F.col("_n")), of("", F.col("_w") * 0.0)
    plain = [(F.coalesce(of(r, F.col("_n") / F.col("_length")), F.lit(0.0)) / clone_n).alias(f"{r}_frequency") for r in RESIDUES]
    weighted = [F.coalesce(of(r, F.col("_w") / F.col("_length")), no_mass).alias(f"weighted_{r}_frequency") for r in RESIDUES]
    return counted.groupBy(*keys).agg(*plain, *weighted)


def physico_columns() -> list[Column]:
    """Physico-chemical summaries; all are linear in the residue shares, so they read the composition columns."""

    def mix(weights: dict[str, float], prefix: str) -> Column:
        return total([F.lit(float(w)) * F.col(f"{prefix}{r}_frequency") for r, w in weights.items()])

    charge = {"K": 1.0, "R": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}
    kinds = [("mean_hydrophobicity", "weighted_hydrophobicity", HYDROPHOBICITY), ("mean_charge", "weighted_charge", charge),
             ("aromaticity", "weighted_aromaticity", dict.fromkeys("FWY", 1.0))]
    kinds += [(f"{g}_aa_ratio", f"weighted_{g}_aa_ratio", dict.fromkeys(letters, 1.0)) for g, letters in RESIDUE_GROUPS.items()]
    return [c for plain, weighted, w in kinds for c in (mix(w, "").alias(plain), mix(w, "weighted_").alias(weighted))]


def physico(clones: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    return composition(clones, keys, p).select(*keys, *physico_columns())


def core_table(clones: DataFrame, summary: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    """All 96 core features per sample: sums per length, the letters and the ranked blocks, joined to the summary."""
    x = F.col(p)
    per_length = _by_length(
        clones, keys, p, F.sum("read_count").alias("_reads"), F.sum("nt_clone_number").alias("_nt"),
        F.sum(F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0))).alias("_entropy"), F.sum(x * x).alias("_squares"),
    )
    sums = per_length.groupBy(*keys).agg(
        F.sum("_n").alias("aa_clone_number"),
        F.sum("_reads").alias("total_reads_valid_aa"),
        F.sum("_nt").alias("valid_nt_clone_number"),
        F.sum("_entropy").alias("Shannon"),
        F.sum("_squares").alias("Simpson"),
        *_length_aggs(), *_length_mass(),
    ).join(composition(clones, keys, p), keys, "left")
    depth = summary.select(*keys, "total_reads_all_nt", F.col("input_nt_rows").alias("nt_clone_number_all"), "valid_nt_row_ratio")
    joined = sums.join(depth, keys, "left").join(evenness_and_expansion(clones, keys, p), keys)
    reads = safe_ratio("total_reads_valid_aa", "total_reads_all_nt").alias("valid_read_ratio")
    done = joined.select(
        "*", reads, F.log1p("aa_clone_number").alias("log1p_aa_clone_number"), inverse_simpson(), clonality(), *_length_finish(), *physico_columns(),
    )
    return done.select(
        *keys, *DEPTH_NAMES, *DIVERSITY_NAMES, *TOP_NAMES.values(), *LENGTH_STATS, *LENGTH_NAMES, *COMPOSITION_NAMES, *PHYSICO_NAMES
    )


# -- 3-mers ------------------------------------------------------------------------------------------------------------

def kmer_features(
    clones: DataFrame, keys: list[str], vocabulary: DataFrame | None = None, p: str = "frequency_norm", k: int = 3
) -> DataFrame:
    """Long (sample, kmer) table: share of clones that contain the k-mer and the frequency mass of those clones.

    With a vocabulary (test mode) other k-mers are dropped.
    """
    # A window counts where it stands first in its clone; no array is built per clone.
    length = F.length("cdr3_aa")
    places = F.explode(F.when(length >= k, F.sequence(F.lit(1), length - (k - 1))))
    windows = clones.select(*keys, p, "cdr3_aa", places.alias("_at")).select("*", F.substring("cdr3_aa", F.col("_at"), F.lit(k)).alias("kmer"))
    first = windows.filter(F.position(F.col("kmer"), F.col("cdr3_aa")) == F.col("_at"))
    counted = first.groupBy(*keys, "kmer").agg(F.count(F.lit(1)).alias("clones_with_kmer"), F.sum(p).alias("weighted_value"))
    if vocabulary is not None:
        counted = in_vocabulary(counted, vocabulary)
    sizes = clones.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(sizes, keys).select(
        *keys, "kmer", "clones_with_kmer", (F.col("clones_with_kmer") / F.col("_n")).alias("unweighted_value"), "weighted_value"
    )


def in_vocabulary(kmers: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The rows of retained k-mers."""
    return kmers.join(vocabulary.filter("keep").select("kmer"), "kmer", "left_semi").select(kmers.columns)


def kmer_vocabulary(
    kmers: DataFrame, n_samples: DataFrame, min_samples: int = 5, min_prevalence: float = 0.05, min_variance: float = 1e-12,
    max_kmers: int = 0, sample: str = "sample_id",
) -> DataFrame:
    """Vocabulary statistics, filter verdict, optional cap and rank.

    Samples without a k-mer count as zero through the divisor, so no zero rows are made.  A k-mer of 20 letters has at
    most 8,000 values, which bounds the two unpartitioned windows.
    """
    n = F.col("n_samples")
    u, w = F.col("unweighted_value"), F.col("weighted_value")
    sums = kmers.groupBy("kmer").agg(
        F.count(F.lit(1)).alias("training_sample_count"), F.sum(u).alias("_u1"), F.sum(u * u).alias("_u2"), F.sum(w).alias("_w1"), F.sum(w * w).alias("_w2"),
    )

    def variance(s1: str, s2: str) -> Column:
        return F.greatest(F.col(s2) / n - (F.col(s1) / n) * (F.col(s1) / n), F.lit(0.0))

    stats = attach_totals(sums, n_samples, []).select(
        "kmer", "training_sample_count", (F.col("training_sample_count") / n).alias("training_sample_prevalence"),
        (F.col("_u1") / n).alias("mean_unweighted_value"), variance("_u1", "_u2").alias("variance_unweighted_value"),
        (F.col("_w1") / n).alias("mean_weighted_value"), variance("_w1", "_w2").alias("variance_weighted_value"),
    )
    flat = (F.col("variance_unweighted_value") < min_variance) & (F.col("variance_weighted_value") < min_variance)
    reasons = join_reasons([
        F.when(F.col("training_sample_count") < min_samples, F.lit("low_sample_count")),
        F.when(F.col("training_sample_prevalence") < min_prevalence, F.lit("low_prevalence")),
        F.when(flat, F.lit("low_variance_both")),
    ])
    judged = stats.withColumn("filter_reason", F.when(reasons == "", F.lit("retained")).otherwise(reasons))
    if max_kmers > 0:
        spread = F.col("variance_unweighted_value") + F.col("variance_weighted_value")
        order = Window.partitionBy(F.col("filter_reason") == "retained").orderBy(
            F.col("training_sample_prevalence").desc(), spread.desc(), F.col("kmer"))
        over = (F.col("filter_reason") == "retained") & (F.row_number().over(order) > max_kmers)
        judged = judged.withColumn("filter_reason", F.when(over, F.lit("excluded_by_max_kmers")).otherwise(F.col("filter_reason")))
    kept = judged.withColumn("keep", F.col("filter_reason") == "retained")
    rank = Window.orderBy(F.col("keep").desc(), F.col("training_sample_prevalence").desc(), F.col("kmer"))
    return kept.withColumn("vocabulary_rank", F.row_number().over(rank))


def filter_reason_counts(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("filter_reason").agg(F.count(F.lit(1)).alias("kmers"))


def retained_kmers(vocabulary: DataFrame) -> list[str]:
    """Retained k-mers in vocabulary order: column names for the wide matrix (at most 8,000 for 3-mers)."""
    return [r.kmer for r in vocabulary.filter("keep").select("kmer", "vocabulary_rank").orderBy("vocabulary_rank").collect()]


def kmer_vectors(
    samples: DataFrame, kmers: DataFrame, names: list[str], values: list[str], key: str = "sample_id"
) -> DataFrame:
    """Samples with one dense array per value column, in the order of `names`, absent cells 0.

    A sample collects at most as many entries as the vocabulary holds (8,000 for 3-mers).
    """
    folded = kmers.groupBy(key).agg(*[F.map_from_entries(F.collect_list(F.struct("kmer", c))).alias(f"_m_{c}") for c in values])
    order = F.array(*[F.lit(n) for n in names])

    def dense(c: str) -> Column:
        return F.transform(order, lambda n: F.coalesce(F.col(f"_m_{c}")[n], F.lit(0.0))).alias(c)

    vectors = [dense(c) for c in values]
    return samples.join(folded, key, "left").select(*[F.col(c) for c in samples.columns], *vectors)


def kmer_matrix(
    samples: DataFrame, kmers: DataFrame, names: list[str], values: dict[str, str], key: str = "sample_id"
) -> DataFrame:
    """Wide view of `kmer_vectors`: one block of columns per value column (`values`: column -> name prefix)."""
    vectors = kmer_vectors(samples, kmers, names, list(values), key)
    cells = [f"`{c}`[{i}] as `{prefix}{n}`" for c, prefix in values.items() for i, n in enumerate(names)]
    return vectors.selectExpr(*[f"`{c}`" for c in samples.columns], *cells)


def merged_matrix(core: DataFrame, kmers: DataFrame, names: list[str], key: str = "sample_id") -> DataFrame:
    blocks = {"unweighted_value": "unweighted_3mer_", "weighted_value": "weighted_3mer_"}
    return kmer_matrix(core, kmers, names, blocks, key)


# -- cross-checks ------------------------------------------------------------------------------------------------------

def summary_mismatches(clones: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Totals recomputed from the clone table against the step-01 summary."""
    again = clones.groupBy(*keys).agg(
        F.sum("read_count").alias("reads"), F.sum("nt_clone_number").alias("variants"), F.count(F.lit(1)).alias("clones"),
    )
    j = again.join(summary.select(*keys, "total_reads_valid_nt", "unique_valid_nt_clones", F.col("aa_clone_number").alias("stated_clones")), keys)
    detail = join_reasons([
        F.when(F.col("reads") != F.col("total_reads_valid_nt"), F.lit("total_reads_valid_aa")),
        F.when(F.col("variants") != F.col("unique_valid_nt_clones"), F.lit("valid_nt_clone_number")),
        F.when(F.col("clones") != F.col("stated_clones"), F.lit("aa_clone_number")),
    ])
    count = F.when(detail == "", 0).otherwise(F.size(F.split(detail, ";")))
    return j.select(*keys, count.alias("summary_mismatch_count"), detail.alias("summary_mismatch_detail"))


def build_log(clones: DataFrame, kmers: DataFrame, keys: list[str], p: str = "frequency_norm") -> DataFrame:
    base = clones.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aa_clone_number"), F.sum("read_count").alias("total_reads_valid_aa"),
        F.sum("nt_clone_number").alias("valid_nt_clone_number"), F.sum(p).alias("frequency_norm_sum_input"),
        F.sum("read_fraction").alias("read_fraction_sum_input"), F.max(p).alias("top1_frequency"),
    )
    seen = kmers.groupBy(*keys).agg(
        F.count(F.when(F.col("unweighted_value") > 0, 1)).alias("nonzero_unweighted_3mers"),
        F.count(F.when(F.col("weighted_value") > 0, 1)).alias("nonzero_weighted_3mers"),
    )
    return base.join(seen, keys, "left").fillna(0)
