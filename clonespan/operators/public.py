"""Public (shared) clones: labelled reference sets, their application to samples, leave-one-out and cross-fitted scoring.

An incidence table has one row per (keys, sample_id, cdr3_aa) with `frequency_norm`; presence is the row itself.  Metadata
has one row per (keys, sample_id) with `cohort`.  `keys` may name a receptor, a repeat, a task or nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if, count_threshold, log_ratio, safe_ratio, sum_if
from .ranking import attach_totals


@dataclass(frozen=True)
class Scheme:
    name: str
    global_min_prevalence: float
    global_min_count: int
    group_min_prevalence: float
    group_min_count: int
    specific_prevalence_delta: float


# The three published threshold presets.
SCHEMES = [
    Scheme("loose", 0.01, 2, 0.03, 2, 0.03),
    Scheme("main", 0.02, 3, 0.05, 3, 0.05),
    Scheme("strict", 0.05, 5, 0.10, 4, 0.10),
]
MAIN = SCHEMES[1]

# The two cohort labels, negative first.
COHORTS = ("A", "B")


def set_names(cohorts: tuple[str, str] = COHORTS) -> dict[str, str]:
    """Internal set -> published set name."""
    a, b = cohorts
    return {
        "global": "global_public", "neg_group": f"{a}_group_public", "pos_group": f"{b}_group_public",
        "shared": "between_group_shared", "neg_specific": f"{a}_specific_ref", "pos_specific": f"{b}_specific_ref",
    }


def descriptive_prefixes(cohorts: tuple[str, str] = COHORTS) -> dict[str, str]:
    a, b = cohorts
    return {
        "global": "global_public_aa", "neg_group": f"{a}_group_public_aa", "pos_group": f"{b}_group_public_aa",
        "shared": "between_group_shared_aa", "neg_specific": f"{a}_specific_ref", "pos_specific": f"{b}_specific_ref",
    }


def model_prefixes(cohorts: tuple[str, str] = COHORTS) -> dict[str, str]:
    a, b = cohorts
    return {"global": "all_ref_public", "neg_specific": f"{a}_specific_ref", "pos_specific": f"{b}_specific_ref", "shared": "shared_ref"}


MODEL_SETS = list(model_prefixes())
ALL_SETS = list(set_names())
MEASURES = ["clone_number", "clone_ratio", "frequency_sum", "set_coverage"]


def reference_feature_names(cohorts: tuple[str, str] = COHORTS) -> list[str]:
    """The 18 model features in their published order."""
    a, b = cohorts
    plain = [f"{p}_{m}" for p in model_prefixes(cohorts).values() for m in MEASURES]
    return plain + [f"{b}_{a}_specific_ref_frequency_delta", f"{b}_{a}_specific_ref_frequency_log_ratio"]


# -- incidence and counts ----------------------------------------------------------------------------------------------

def incidence(clones: DataFrame, keys: list[str] = [], min_samples: int = 1) -> DataFrame:
    """Long incidence table: duplicates summed, clones in fewer than `min_samples` samples removed."""
    cells = clones.groupBy(*keys, "sample_id", "cdr3_aa").agg(F.sum("frequency_norm").alias("frequency_norm"))
    if min_samples <= 1:
        return cells
    return cells.join(candidates(cells, keys, min_samples).select(*keys, "cdr3_aa"), [*keys, "cdr3_aa"], "left_semi")


def candidates(cells: DataFrame, keys: list[str], min_samples: int) -> DataFrame:
    counts = cells.groupBy(*keys, "cdr3_aa").agg(F.count(F.lit(1)).alias("sample_count"))
    return counts.filter(F.col("sample_count") >= min_samples)


def clone_numbers(cells: DataFrame, keys: list[str] = []) -> DataFrame:
    return cells.groupBy(*keys, "sample_id").agg(F.count(F.lit(1)).alias("aa_clone_number"))


def with_cohort(cells: DataFrame, meta: DataFrame, keys: list[str] = []) -> DataFrame:
    on = [k for k in keys if k in cells.columns] + ["sample_id"]
    return cells.join(meta.select(*keys, "sample_id", "cohort"), on)


def presence_counts(labelled: DataFrame, keys: list[str] = [], cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Per clone: samples of each cohort that hold it and the frequency sums."""
    neg, pos = F.col("cohort") == cohorts[0], F.col("cohort") == cohorts[1]
    return labelled.groupBy(*keys, "cdr3_aa").agg(
        count_if(neg).alias("neg_count"), count_if(pos).alias("pos_count"),
        sum_if(neg, "frequency_norm").alias("neg_freq"), sum_if(pos, "frequency_norm").alias("pos_freq"),
    )


def cohort_sizes(meta: DataFrame, keys: list[str] = [], cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    return meta.groupBy(*keys).agg(
        count_if(F.col("cohort") == cohorts[0]).alias("n_neg"), count_if(F.col("cohort") == cohorts[1]).alias("n_pos")
    )


# -- thresholds and membership -----------------------------------------------------------------------------------------

def thresholds(scheme: Scheme, n_neg: Column, n_pos: Column) -> dict[str, Column]:
    return {
        "global": count_threshold(n_neg + n_pos, scheme.global_min_prevalence, scheme.global_min_count),
        "neg": count_threshold(n_neg, scheme.group_min_prevalence, scheme.group_min_count),
        "pos": count_threshold(n_pos, scheme.group_min_prevalence, scheme.group_min_count),
    }


def membership(neg: Column, pos: Column, n_neg: Column, n_pos: Column, scheme: Scheme) -> dict[str, Column]:
    """The six set flags of a clone as boolean columns."""
    t = thresholds(scheme, n_neg, n_pos)
    gap = neg / n_neg - pos / n_pos
    back = pos / n_pos - neg / n_neg
    delta = F.lit(scheme.specific_prevalence_delta)
    neg_group, pos_group = neg >= t["neg"], pos >= t["pos"]
    neg_specific, pos_specific = neg_group & (gap >= delta), pos_group & (back >= delta)
    return {
        "global": (neg + pos) >= t["global"], "neg_group": neg_group, "pos_group": pos_group,
        "shared": neg_group & pos_group & ~neg_specific & ~pos_specific,
        "neg_specific": neg_specific, "pos_specific": pos_specific,
    }


def category(flags: dict[str, Column], cohorts: tuple[str, str] = COHORTS) -> Column:
    return (
        F.when(flags["neg_specific"], F.lit(f"{cohorts[0]}_specific")).when(flags["pos_specific"], F.lit(f"{cohorts[1]}_specific"))
        .when(flags["shared"], F.lit("shared")).when(flags["global"], F.lit("other_global_public")).otherwise(F.lit("not_public"))
    )


def bit_mask(flags: dict[str, Column]) -> Column:
    """The flags packed into one integer, in the order global, groups, shared, specific."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(flags[s], 1 << i).otherwise(0) for i, s in enumerate(ALL_SETS)])


def scheme_thresholds(sizes: DataFrame, keys: list[str] = [], schemes: list[Scheme] = SCHEMES, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Count thresholds of every scheme for the given cohort sizes."""
    n_neg, n_pos = F.col("n_neg"), F.col("n_pos")

    def row(s: Scheme) -> Column:
        t = thresholds(s, n_neg, n_pos)
        return F.struct(
            F.lit(s.name).alias("scheme"), t["global"].alias("global_count_threshold"),
            t["neg"].alias(f"{cohorts[0]}_count_threshold"), t["pos"].alias(f"{cohorts[1]}_count_threshold"),
        )

    return sizes.select(*keys, "n_neg", "n_pos", F.inline(F.array(*[row(s) for s in schemes])))


def flagged(counts: DataFrame, sizes: DataFrame, keys: list[str] = [], scheme: Scheme = MAIN) -> DataFrame:
    """Counts with the six flags as columns named by the internal sets."""
    flags = membership(F.col("neg_count"), F.col("pos_count"), F.col("n_neg"), F.col("n_pos"), scheme)
    return attach_totals(counts, sizes, keys).select("*", *[c.alias(s) for s, c in flags.items()])


def reference_table(counts: DataFrame, sizes: DataFrame, keys: list[str] = [], scheme: Scheme = MAIN) -> DataFrame:
    """Clones that belong to at least one set, with their flags: what gets joined to samples."""
    hot = flagged(counts, sizes, keys, scheme)
    any_set = reduce(lambda a, b: a | b, [F.col(s) for s in ALL_SETS])
    return hot.filter(any_set).select(*keys, "cdr3_aa", *ALL_SETS)


def catalog(counts: DataFrame, sizes: DataFrame, keys: list[str] = [], scheme: Scheme = MAIN, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """The published 24-column catalog of clones."""
    a, b = cohorts
    f = flagged(counts, sizes, keys, scheme)
    neg, pos, n_neg, n_pos = F.col("neg_count"), F.col("pos_count"), F.col("n_neg"), F.col("n_pos")
    both, freq, n = neg + pos, F.col("neg_freq") + F.col("pos_freq"), n_neg + n_pos
    flags = {s: F.col(s) for s in ALL_SETS}
    labels = set_names(cohorts)

    def means(name: str, scope: str, mass: Column, count: Column, size: Column) -> list[Column]:
        return [
            mass.alias(f"{name}_frequency_sum"), (mass / size).alias(f"{name}_mean_frequency_all_{scope}samples"),
            safe_ratio(mass, count).alias(f"{name}_mean_frequency_present_{scope}samples"),
        ]

    return f.select(
        *keys, "cdr3_aa", both.alias("total_sample_count"), (both / n).alias("total_sample_prevalence"),
        neg.alias(f"{a}_sample_count"), (neg / n_neg).alias(f"{a}_sample_prevalence"),
        pos.alias(f"{b}_sample_count"), (pos / n_pos).alias(f"{b}_sample_prevalence"),
        (pos / n_pos - neg / n_neg).alias(f"prevalence_delta_{b}_minus_{a}"),
        *means("total", "", freq, both, n), *means(a, f"{a}_", F.col("neg_freq"), neg, n_neg), *means(b, f"{b}_", F.col("pos_freq"), pos, n_pos),
        *[F.col(s).cast("int").alias(f"is_{labels[s]}") for s in ALL_SETS],
        category(flags, cohorts).alias("reference_category"),
    )


def set_sizes(reference: DataFrame, keys: list[str] = [], sets: list[str] = ALL_SETS) -> DataFrame:
    return reference.groupBy(*keys).agg(*[count_if(F.col(s)).alias(f"size_{s}") for s in sets])


def set_summary(reference: DataFrame, sizes: DataFrame, keys: list[str] = [], scheme: Scheme = MAIN, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """One row per set: size, cohort sizes and thresholds."""
    labels = set_names(cohorts)
    wide = attach_totals(set_sizes(reference, keys), sizes, keys)
    t = thresholds(scheme, F.col("n_neg"), F.col("n_pos"))
    rows = F.inline(F.array(*[F.struct(F.lit(labels[s]).alias("set_name"), F.col(f"size_{s}").alias("set_size")) for s in ALL_SETS]))
    return wide.select(
        *keys, F.lit(scheme.name).alias("scheme"), rows, (F.col("n_neg") + F.col("n_pos")).alias("n_training_samples"),
        F.col("n_neg").alias(f"n_{cohorts[0]}_training_samples"), F.col("n_pos").alias(f"n_{cohorts[1]}_training_samples"),
        t["global"].alias("global_count_threshold"), t["neg"].alias(f"{cohorts[0]}_count_threshold"), t["pos"].alias(f"{cohorts[1]}_count_threshold"),
    )


# -- application to samples --------------------------------------------------------------------------------------------

def _overlap_columns(prefixes: dict[str, str], clones: Column) -> list[Column]:
    out = []
    for s, p in prefixes.items():
        n = F.coalesce(F.col(f"hit_{s}"), F.lit(0))
        out += [
            n.alias(f"{p}_clone_number"), safe_ratio(n, clones).alias(f"{p}_clone_ratio"),
            F.coalesce(F.col(f"mass_{s}"), F.lit(0.0)).alias(f"{p}_frequency_sum"), safe_ratio(n, F.col(f"size_{s}")).alias(f"{p}_set_coverage"),
        ]
    return out


def overlap_features(
    cells: DataFrame, reference: DataFrame, sample_keys: list[str] = [], reference_keys: list[str] = [],
    prefixes: dict[str, str] | None = None, extra: list[str] = [], clones: DataFrame | None = None,
) -> DataFrame:
    """Overlap of every sample with every set: clone number, share of clones, frequency sum, share of the set.

    `clones` has the clone numbers per sample when `cells` are not all of a sample's.

    Only clones of some set are joined, so the singletons that fill a repertoire never meet the join; samples without any
    hit come back through the clone counts.
    """
    names = prefixes or descriptive_prefixes()
    hits = cells.join(reference.select(*reference_keys, "cdr3_aa", *names), [*reference_keys, "cdr3_aa"])
    per_sample = hits.groupBy(*sample_keys, "sample_id").agg(
        *[count_if(F.col(s)).alias(f"hit_{s}") for s in names], *[sum_if(F.col(s), "frequency_norm").alias(f"mass_{s}") for s in names]
    )
    if clones is None:
        clones = cells.groupBy(*sample_keys, "sample_id", *extra).agg(F.count(F.lit(1)).alias("aa_clone_number"))
    joined = clones.join(per_sample, [*sample_keys, "sample_id"], "left")
    sizes = set_sizes(reference, reference_keys, list(names))
    joined = joined.join(sizes, reference_keys, "left") if reference_keys else attach_totals(joined, sizes, [])
    return joined.select(*sample_keys, "sample_id", *extra, "aa_clone_number", *_overlap_columns(names, F.col("aa_clone_number")))


def with_log_ratio(df: DataFrame, keep: list[str], cohorts: tuple[str, str] = COHORTS, eps: float = 1e-8) -> DataFrame:
    a, b = cohorts
    pos, neg = F.col(f"{b}_specific_ref_frequency_sum"), F.col(f"{a}_specific_ref_frequency_sum")
    names = reference_feature_names(cohorts)
    return df.select(
        *keep, *names[:-2], (pos - neg).alias(names[-2]), log_ratio(pos, neg, eps).alias(names[-1])
    )


def reference_view(descriptive: DataFrame, keep: list[str] = ["sample_id"], cohorts: tuple[str, str] = COHORTS, eps: float = 1e-8) -> DataFrame:
    """Descriptive features renamed to the 18 model features."""
    old, new = descriptive_prefixes(cohorts), model_prefixes(cohorts)
    renamed = descriptive.select(*keep, *[F.col(f"{old[s]}_{m}").alias(f"{new[s]}_{m}") for s in MODEL_SETS for m in MEASURES])
    return with_log_ratio(renamed, keep, cohorts, eps)


def external_features(cells: DataFrame, reference: DataFrame, keys: list[str] = [], cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """The 18 model features of samples that took no part in the reference; labels are not read."""
    f = overlap_features(cells, reference, keys, keys, model_prefixes(cohorts))
    return with_log_ratio(f, [*keys, "sample_id"], cohorts)


def application_log(features: DataFrame, keys: list[str] = []) -> DataFrame:
    hit = F.col("global_public_aa_clone_number")
    return features.select(
        *keys, "sample_id", "aa_clone_number", hit.alias("matched_all_ref_clone_number"),
        F.col("global_public_aa_frequency_sum").alias("matched_all_ref_frequency_sum"), (F.col("aa_clone_number") - hit).alias("ignored_nonreference_clone_number"),
    )


# -- leave-one-out and cross-fitting -----------------------------------------------------------------------------------

def pruned(cells: DataFrame, keys: list[str], scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(cells of clones that enough samples hold to enter a set of any part of them, clone numbers per sample of all cells).

    Counts in a part never exceed those in the whole, so this may come before the cells are repeated for tasks and folds.
    """
    own = [k for k in keys if k in cells.columns]
    smallest = min(scheme.global_min_count, scheme.group_min_count)
    numbers = clone_numbers(cells, own)
    if smallest <= 1:
        return cells, numbers
    return cells.join(candidates(cells, own, smallest).select(*own, "cdr3_aa"), [*own, "cdr3_aa"], "left_semi"), numbers


def leave_one_out(
    cells: DataFrame, meta: DataFrame, keys: list[str] = [], scheme: Scheme = MAIN, cohorts: tuple[str, str] = COHORTS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Each sample scored against the reference of the other samples of its partition, exactly and in linear work.

    Removing one sample changes a clone's counts only where the sample holds the clone, and the thresholds only through the
    cohort of the removed sample.  So the set sizes for a removed sample of either cohort are computed once per partition
    on the full counts, and corrected over the sample's own clones.
    """
    sizes = cohort_sizes(meta, keys, cohorts)
    shared, numbers = pruned(cells, keys, scheme)
    labelled = with_cohort(shared, meta, keys)
    all_counts = presence_counts(labelled, keys, cohorts) if counts is None else counts
    smallest = min(scheme.global_min_count, scheme.group_min_count)
    kept = all_counts.filter(F.col("neg_count") + F.col("pos_count") >= smallest).select(*keys, "cdr3_aa", "neg_count", "pos_count")
    neg, pos, n_neg, n_pos = F.col("neg_count"), F.col("pos_count"), F.col("n_neg"), F.col("n_pos")
    is_neg = F.col("cohort") == cohorts[0]

    held_neg = membership(neg, pos, n_neg - 1, n_pos, scheme)
    held_pos = membership(neg, pos, n_neg, n_pos - 1, scheme)
    base = attach_totals(kept, sizes, keys).groupBy(*keys).agg(
        *[count_if(held_neg[s]).alias(f"base_neg_{s}") for s in MODEL_SETS], *[count_if(held_pos[s]).alias(f"base_pos_{s}") for s in MODEL_SETS]
    )

    own = labelled.join(kept, [*keys, "cdr3_aa"])
    own = attach_totals(own, sizes, keys)
    d_neg, d_pos = is_neg.cast("bigint"), (~is_neg).cast("bigint")
    staged = own.select(
        *keys, "sample_id", "frequency_norm", "neg_count", "pos_count", (neg - d_neg).alias("less_neg"), (pos - d_pos).alias("less_pos"),
        (n_neg - d_neg).alias("m_neg"), (n_pos - d_pos).alias("m_pos"),
    )
    with_own = membership(F.col("less_neg"), F.col("less_pos"), F.col("m_neg"), F.col("m_pos"), scheme)
    without = membership(neg, pos, F.col("m_neg"), F.col("m_pos"), scheme)
    per_sample = staged.groupBy(*keys, "sample_id").agg(
        *[count_if(with_own[s]).alias(f"hit_{s}") for s in MODEL_SETS],
        *[sum_if(with_own[s], "frequency_norm").alias(f"mass_{s}") for s in MODEL_SETS],
        *[(count_if(with_own[s]) - count_if(without[s])).alias(f"shift_{s}") for s in MODEL_SETS],
    )
    clones = with_cohort(numbers, meta, keys).select(*keys, "sample_id", "cohort", "aa_clone_number")
    joined = attach_totals(attach_totals(clones.join(per_sample, [*keys, "sample_id"], "left"), base, keys), sizes, keys)
    size = {s: F.when(is_neg, F.col(f"base_neg_{s}")).otherwise(F.col(f"base_pos_{s}")) + F.coalesce(F.col(f"shift_{s}"), F.lit(0)) for s in MODEL_SETS}
    sized = joined.select("*", *[c.alias(f"size_{s}") for s, c in size.items()])
    m_neg, m_pos = n_neg - d_neg, n_pos - d_pos
    t = thresholds(scheme, m_neg, m_pos)
    log = [
        m_neg.alias(f"n_{cohorts[0]}_reference"), m_pos.alias(f"n_{cohorts[1]}_reference"), (m_neg + m_pos).alias("n_reference"),
        t["global"].alias("global_threshold"), t["neg"].alias(f"{cohorts[0]}_threshold"), t["pos"].alias(f"{cohorts[1]}_threshold"),
        *[F.col(f"size_{s}").alias(f"{p}_size") for s, p in model_prefixes(cohorts).items()],
    ]
    log_names = [f"n_{cohorts[0]}_reference", f"n_{cohorts[1]}_reference", "n_reference", "global_threshold", f"{cohorts[0]}_threshold",
                 f"{cohorts[1]}_threshold", *[f"{p}_size" for p in model_prefixes(cohorts).values()]]
    wide = sized.select(*keys, "sample_id", "cohort", "aa_clone_number", *_overlap_columns(model_prefixes(cohorts), F.col("aa_clone_number")), *log)
    return with_log_ratio(wide, [*keys, "sample_id", "cohort", "aa_clone_number", *log_names], cohorts)


def reference_log(loo: DataFrame, context: str, keys: list[str] = [], cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Per held-out sample: reference size, thresholds and set sizes (a by-product of the leave-one-out features)."""
    a, b = cohorts
    return loo.select(
        *keys, F.lit(context).alias("context"), "sample_id", F.col("cohort").alias("held_out_label"), "n_reference", f"n_{a}_reference", f"n_{b}_reference",
        "global_threshold", f"{a}_threshold", f"{b}_threshold", *[f"{p}_size" for p in model_prefixes(cohorts).values()],
    )


def training_counts(labelled: DataFrame, keys: list[str], fold: str, k: int, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Counts of the training part of every fold: total minus own fold, from one aggregation by clone.

    The k folds of a clone are summed side by side (k is a small parameter), so no fold is ever rebuilt from incidences.
    """
    folds = range(1, k + 1)

    def side(cohort: str, f: int) -> Column:
        return count_if((F.col("cohort") == cohort) & (F.col(fold) == f))

    sums = labelled.groupBy(*keys, "cdr3_aa").agg(
        *[side(cohorts[0], f).alias(f"_neg_{f}") for f in folds], *[side(cohorts[1], f).alias(f"_pos_{f}") for f in folds]
    )
    neg_all = reduce(lambda a, b: a + b, [F.col(f"_neg_{f}") for f in folds])
    pos_all = reduce(lambda a, b: a + b, [F.col(f"_pos_{f}") for f in folds])
    rows = [F.struct(F.lit(f).alias(fold), (neg_all - F.col(f"_neg_{f}")).alias("neg_count"), (pos_all - F.col(f"_pos_{f}")).alias("pos_count")) for f in folds]
    return sums.select(*keys, "cdr3_aa", F.inline(F.array(*rows)))


def training_sizes(folds: DataFrame, keys: list[str], fold: str, k: int, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Cohort sizes of the training part of every fold."""
    values = range(1, k + 1)

    def side(cohort: str, f: int) -> Column:
        return count_if((F.col("cohort") == cohort) & (F.col(fold) != f))

    rows = [F.struct(F.lit(f).alias(fold), side(cohorts[0], f).alias("n_neg"), side(cohorts[1], f).alias("n_pos")) for f in values]
    return folds.groupBy(*keys).agg(F.array(*rows).alias("_rows")).select(*keys, F.inline("_rows"))


def crossfit(
    cells: DataFrame, folds: DataFrame, keys: list[str] = [], fold: str = "fold", k: int = 5, scheme: Scheme = MAIN,
    cohorts: tuple[str, str] = COHORTS,
) -> DataFrame:
    """Every sample scored on the reference of the other folds; `folds` has (keys, sample_id, cohort, fold)."""
    on = [c for c in keys if c in cells.columns] + ["sample_id"]
    placed = folds.select(*keys, "sample_id", "cohort", F.col(fold).cast("int").alias(fold))
    shared, numbers = pruned(cells, keys, scheme)
    labelled = shared.join(placed, on)
    clones = numbers.join(placed, on).select(*keys, fold, "sample_id", "aa_clone_number")
    counts = training_counts(labelled, keys, fold, k, cohorts)
    reference = reference_table(counts, training_sizes(folds, keys, fold, k, cohorts), [*keys, fold], scheme)
    f = overlap_features(labelled, reference, [*keys, fold], [*keys, fold], model_prefixes(cohorts), clones=clones)
    return with_log_ratio(f.na.fill(0.0), [*keys, fold, "sample_id"], cohorts)


# -- reports -----------------------------------------------------------------------------------------------------------

def reference_definition(reference: DataFrame, sizes: DataFrame, scheme: Scheme = MAIN, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """One row with nested thresholds and set sizes, for a JSON sink."""
    t = thresholds(scheme, F.col("n_neg"), F.col("n_pos"))
    wide = attach_totals(set_sizes(reference), sizes, [])
    labels = set_names(cohorts)
    return wide.select(
        F.lit(scheme.name).alias("scheme"), F.col("n_neg").alias(f"n_{cohorts[0]}"), F.col("n_pos").alias(f"n_{cohorts[1]}"),
        F.struct(t["global"].alias("global"), t["neg"].alias(cohorts[0]), t["pos"].alias(cohorts[1])).alias("count_thresholds"),
        F.struct(*[F.col(f"size_{s}").alias(labels[s]) for s in ALL_SETS]).alias("set_sizes"),
        F.struct(*[F.lit(getattr(scheme, f)).alias(f) for f in ("global_min_prevalence", "global_min_count", "group_min_prevalence", "group_min_count", "specific_prevalence_delta")]).alias("parameters"),
    )


def reproduction_check(reference: DataFrame, published: DataFrame, keys: list[str] = [], cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Rebuilt set sizes against published (keys, set_name, set_size)."""
    labels = set_names(cohorts)
    rows = F.inline(F.array(*[F.struct(F.lit(labels[s]).alias("set_name"), F.col(f"size_{s}").alias("rebuilt_size")) for s in ALL_SETS]))
    rebuilt = set_sizes(reference, keys).select(*keys, rows)
    j = rebuilt.join(published.select(*keys, "set_name", "set_size"), [*keys, "set_name"], "full_outer")
    return j.select(*keys, "set_name", "rebuilt_size", "set_size", F.col("rebuilt_size").eqNullSafe(F.col("set_size")).alias("matches"))


def range_check(features: DataFrame) -> DataFrame:
    """Per overlap column: bounds, whether they stay in [0, 1] within tolerance, and whether the column is all zero."""
    names = [c for c in features.columns if c.endswith(("_clone_ratio", "_frequency_sum", "_set_coverage"))]
    aggs = [f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("min_value"), F.col(f"hi_{c}").alias("max_value")) for c in names]
    out = features.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.select(
        "*", ((F.col("min_value") >= -1e-10) & (F.col("max_value") <= 1 + 1e-8)).alias("in_range"),
        ((F.abs("min_value") <= 1e-8) & (F.abs("max_value") <= 1e-8)).alias("all_zero"),
    )


def receptor_reference_overview(
    cells: DataFrame, meta: DataFrame, receptor: str = "receptor", scheme: Scheme = MAIN, cohorts: tuple[str, str] = COHORTS
) -> DataFrame:
    """Per receptor: samples, candidate clones, incidences and the four set sizes."""
    labelled = cells.join(meta.select("sample_id", "cohort"), "sample_id")
    counts = presence_counts(labelled, [receptor], cohorts).filter(F.col("neg_count") + F.col("pos_count") >= 2)
    members = labelled.groupBy(receptor, "sample_id", "cohort").agg(F.count(F.lit(1)).alias("_n"))
    sizes = cohort_sizes(members, [receptor], cohorts)
    flags = flagged(counts, sizes, [receptor], scheme)
    labels = model_prefixes(cohorts)
    per = flags.groupBy(receptor).agg(
        F.count(F.lit(1)).alias("candidate_clones"), F.sum(F.col("neg_count") + F.col("pos_count")).alias("incidences"),
        *[count_if(F.col(s)).alias(f"{labels[s]}_size") for s in MODEL_SETS],
    )
    return per.join(sizes.select(receptor, (F.col("n_neg") + F.col("n_pos")).alias("samples")), receptor)


def membership_table(reference: DataFrame, keys: list[str] = []) -> DataFrame:
    """Saved membership of the final reference: one row per clone and receptor with its flags."""
    return reference.select(*keys, "cdr3_aa", *[F.col(s).alias(f"is_{n}") for s, n in set_names().items()])
