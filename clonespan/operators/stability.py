"""Stability of reference sets under repeated stratified subsampling of the reference samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import count_if, join_reasons, log_ratio, order_hash, safe_ratio, sum_if
from .public import COHORTS, MODEL_SETS, SCHEMES, Scheme, category, cohort_sizes, membership, model_prefixes, presence_counts, thresholds
from .ranking import attach_totals, exact_quantiles, positions


def categories(cohorts: tuple[str, str] = COHORTS) -> dict[str, str]:
    return {"global": "global_public", "neg_specific": f"{cohorts[0]}_specific", "pos_specific": f"{cohorts[1]}_specific", "shared": "shared"}


def reference_subsamples(meta: DataFrame, iterations: int, fraction: float = 0.8, seed: int = 1, strata: list[str] = ["cohort", "batch"]) -> DataFrame:
    """(iteration, sample) with the role: half-even share of each shuffled stratum is reference, 1..n-1 rows; singletons stay in."""
    sizes = meta.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    rows = meta.join(sizes, strata).select("*", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    placed = positions(rows.withColumn("_h", order_hash(F.lit(seed), "iteration", "sample_id")), ["iteration", *strata], "_h", "sample_id")
    share = F.bround(F.col("_n") * F.lit(fraction), 0).cast("bigint")
    n_ref = F.when(F.col("_n") == 1, F.lit(1)).otherwise(F.least(F.greatest(share, F.lit(1)), F.col("_n") - 1))
    role = F.when(F.col("position") < n_ref, "reference").otherwise("held_out")
    return placed.withColumn("role", role).drop("_n", "_h", "position")


def iteration_counts(labelled: DataFrame, splits: DataFrame, iterations: int, cohorts: tuple[str, str] = COHORTS, min_count: int = 1) -> DataFrame:
    """(iteration, clone) reference counts next to the full counts, of clones in `min_count` samples or more.

    With the smallest minimum of the schemes nothing that can enter a set is lost, for a subsample never exceeds the full
    counts; the filter stands before the clones are spread over iterations.

    Reference count = full count - held-out count: only the held-out fifth of the incidences is spread over iterations.
    A clone gathers at most one entry per iteration.
    """
    full = presence_counts(labelled, [], cohorts).select("cdr3_aa", F.col("neg_count").alias("full_neg"), F.col("pos_count").alias("full_pos"))
    if min_count > 1:
        # one clone stays in any case, so that iterations in which every set is empty keep their rows
        least = full.agg(F.min("cdr3_aa").alias("c")).scalar()
        full = full.filter((F.col("full_neg") + F.col("full_pos") >= min_count) | (F.col("cdr3_aa") == least))
        labelled = labelled.join(full.select("cdr3_aa"), "cdr3_aa", "left_semi")
    held = splits.filter("role = 'held_out'").select("iteration", "sample_id")
    out = labelled.join(held, "sample_id").groupBy("cdr3_aa", "iteration").agg(
        count_if(F.col("cohort") == cohorts[0]).alias("h_neg"), count_if(F.col("cohort") == cohorts[1]).alias("h_pos"))
    gathered = out.groupBy("cdr3_aa").agg(F.map_from_entries(F.collect_list(F.struct("iteration", F.struct("h_neg", "h_pos")))).alias("_held"))
    grid = full.join(gathered, "cdr3_aa", "left").select("*", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    hit = F.col("_held")[F.col("iteration")]
    return grid.select(
        "iteration", "cdr3_aa", "full_neg", "full_pos", (F.col("full_neg") - F.coalesce(hit["h_neg"], F.lit(0))).alias("neg_count"),
        (F.col("full_pos") - F.coalesce(hit["h_pos"], F.lit(0))).alias("pos_count"),
    )


def iteration_flags(
    counts: DataFrame, splits: DataFrame, meta: DataFrame, schemes: list[Scheme] = SCHEMES, cohorts: tuple[str, str] = COHORTS
) -> DataFrame:
    """Counts with the four model flags per scheme, on the iteration (`r_`) and on all samples (`f_`)."""
    n_ref = cohort_sizes(splits.filter("role = 'reference'"), ["iteration"], cohorts)
    n_full = cohort_sizes(meta, [], cohorts).withColumnsRenamed({"n_neg": "full_n_neg", "n_pos": "full_n_pos"})
    j = attach_totals(counts.join(n_ref, "iteration"), n_full, [])
    cols = []
    for s in schemes:
        now = membership(F.col("neg_count"), F.col("pos_count"), F.col("n_neg"), F.col("n_pos"), s)
        ever = membership(F.col("full_neg"), F.col("full_pos"), F.col("full_n_neg"), F.col("full_n_pos"), s)
        cols += [now[m].alias(f"r_{s.name}_{m}") for m in MODEL_SETS] + [ever[m].alias(f"f_{s.name}_{m}") for m in MODEL_SETS]
    return j.select("*", *cols)


def iteration_table(flags: DataFrame, splits: DataFrame, schemes: list[Scheme] = SCHEMES, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Per (iteration, scheme): thresholds, set sizes, full sizes and Jaccard to the full set."""
    aggs = []
    for s in schemes:
        for m in MODEL_SETS:
            r, f = F.col(f"r_{s.name}_{m}"), F.col(f"f_{s.name}_{m}")
            aggs += [count_if(r).alias(f"n_{s.name}_{m}"), count_if(f).alias(f"m_{s.name}_{m}"), count_if(r & f).alias(f"i_{s.name}_{m}"), count_if(r | f).alias(f"u_{s.name}_{m}")]
    sizes = splits.groupBy("iteration").agg(
        count_if(F.col("role") == "reference").alias("n_reference"), count_if(F.col("role") == "held_out").alias("n_held_out"),
        count_if((F.col("role") == "reference") & (F.col("cohort") == cohorts[0])).alias("_a"), count_if((F.col("role") == "reference") & (F.col("cohort") == cohorts[1])).alias("_b"),
    )
    wide = flags.groupBy("iteration").agg(*aggs).join(sizes, "iteration")
    names = categories(cohorts)

    def row(s: Scheme) -> Column:
        t = thresholds(s, F.col("_a"), F.col("_b"))
        cells = [F.lit(s.name).alias("scheme"), t["global"].alias("global_count_threshold"), t["neg"].alias(f"{cohorts[0]}_count_threshold"), t["pos"].alias(f"{cohorts[1]}_count_threshold")]
        for m in MODEL_SETS:
            union = F.col(f"u_{s.name}_{m}")
            cells += [
                F.col(f"n_{s.name}_{m}").alias(f"{names[m]}_set_size"), F.col(f"m_{s.name}_{m}").alias(f"{names[m]}_full_set_size"),
                F.when(union == 0, F.lit(1.0)).otherwise(F.col(f"i_{s.name}_{m}") / union).alias(f"{names[m]}_jaccard_to_full"),
            ]
        return F.struct(*cells)

    return wide.select("iteration", "n_reference", "n_held_out", F.col("_a").alias(f"n_{cohorts[0]}_reference"), F.col("_b").alias(f"n_{cohorts[1]}_reference"), F.inline(F.array(*[row(s) for s in schemes])))


def held_out_features(
    labelled: DataFrame, flags: DataFrame, splits: DataFrame, schemes: list[Scheme] = SCHEMES, cohorts: tuple[str, str] = COHORTS
) -> DataFrame:
    """The 14 features of every held-out sample per iteration and scheme."""
    marks = [f"r_{s.name}_{m}" for s in schemes for m in MODEL_SETS]
    hot = flags.filter(reduce(lambda a, b: a | b, [F.col(c) for c in marks])).select("iteration", "cdr3_aa", *marks)
    held = splits.filter("role = 'held_out'").select("iteration", "sample_id")
    cells = labelled.join(held, "sample_id").select("iteration", "sample_id", "cdr3_aa", "frequency_norm")
    sums = cells.join(hot, ["iteration", "cdr3_aa"]).groupBy("iteration", "sample_id").agg(
        *[count_if(F.col(c)).alias(f"h_{c}") for c in marks], *[sum_if(F.col(c), "frequency_norm").alias(f"w_{c}") for c in marks])
    clones = labelled.groupBy("sample_id", "cohort", "batch").agg(F.count(F.lit(1)).alias("aa_clone_number"))
    base = held.join(clones, "sample_id").join(sums, ["iteration", "sample_id"], "left").fillna(0)
    names = model_prefixes(cohorts)
    a, b = cohorts

    def row(s: Scheme) -> Column:
        cells = [F.lit(s.name).alias("scheme")]
        for m in MODEL_SETS:
            n, w = F.col(f"h_r_{s.name}_{m}"), F.coalesce(F.col(f"w_r_{s.name}_{m}"), F.lit(0.0))
            cells += [n.cast("double").alias(f"{names[m]}_clone_number"), safe_ratio(n, "aa_clone_number").alias(f"{names[m]}_clone_ratio"), w.alias(f"{names[m]}_frequency_sum")]
        pos, neg = F.coalesce(F.col(f"w_r_{s.name}_pos_specific"), F.lit(0.0)), F.coalesce(F.col(f"w_r_{s.name}_neg_specific"), F.lit(0.0))
        return F.struct(*cells, (pos - neg).alias(f"{b}_{a}_specific_ref_frequency_delta"), log_ratio(pos, neg).alias(f"{b}_{a}_specific_ref_frequency_log_ratio"))

    return base.select("iteration", "sample_id", "cohort", "batch", "aa_clone_number", F.inline(F.array(*[row(s) for s in schemes])))


def feature_names(cohorts: tuple[str, str] = COHORTS) -> list[str]:
    a, b = cohorts
    plain = [f"{p}_{m}" for p in model_prefixes(cohorts).values() for m in ("clone_number", "clone_ratio", "frequency_sum")]
    return plain + [f"{b}_{a}_specific_ref_frequency_delta", f"{b}_{a}_specific_ref_frequency_log_ratio"]


def stability_overview(table: DataFrame, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Per (scheme, category): distribution of set sizes and Jaccard over the iterations (one row per iteration)."""
    rows = [F.struct(F.lit(c).alias("category"), F.col(f"{c}_set_size").alias("size"), F.col(f"{c}_full_set_size").alias("full"), F.col(f"{c}_jaccard_to_full").alias("jaccard")) for c in categories(cohorts).values()]
    long = table.select("scheme", F.inline(F.array(*rows)))
    q = F.percentile("size", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("scheme", "category").agg(
        F.max("full").alias("full_train_set_size"), F.avg("size").alias("mean_set_size"), q[1].alias("median_set_size"), F.stddev_pop("size").alias("sd_set_size"),
        q[0].alias("q1_set_size"), q[2].alias("q3_set_size"), F.min("size").alias("min_set_size"), F.max("size").alias("max_set_size"),
        F.avg((F.col("size") == 0).cast("double")).alias("empty_rate"), F.avg("jaccard").alias("mean_jaccard_to_full"), F.percentile("jaccard", 0.5).alias("median_jaccard_to_full"),
        F.min("jaccard").alias("min_jaccard_to_full"), F.max("jaccard").alias("max_jaccard_to_full"),
    )
    return out.withColumn("cv_set_size", F.when(F.col("mean_set_size") > 0, F.col("sd_set_size") / F.col("mean_set_size")))


def sample_stability(held: DataFrame, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Per (scheme, sample, feature): spread of the held-out value over the iterations that held the sample out."""
    ids = ["scheme", "sample_id", "cohort", "batch"]
    long = held.unpivot(ids, feature_names(cohorts), "feature", "value")
    out = long.groupBy(*ids, "feature").agg(
        F.count("value").alias("repeat_count"), F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.stddev_pop("value").alias("sd"),
        F.avg((F.abs("value") <= 1e-8).cast("double")).alias("zero_rate"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return out.withColumn("cv", F.when(F.abs("mean") > 1e-12, F.col("sd") / F.abs("mean")))


def _squash(c: str) -> Column:
    """Monotone slice for feature values of any size and sign."""
    x = F.col(c)
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * 1e6) * 32)


def feature_overview(held: DataFrame, stability: DataFrame, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Per (scheme, feature): distribution over all held-out values (iterations x samples, hence exact sliced quantiles)
    and medians of the within-sample spread."""
    keys = ["scheme", "feature"]
    long = held.unpivot(["scheme"], feature_names(cohorts), "feature", "value")
    base = long.groupBy(*keys).agg(
        F.count("value").alias("oof_observation_count"), F.avg((F.abs("value") > 1e-8).cast("double")).alias("nonzero_rate"), F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = exact_quantiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, _squash("value"))
    cv = exact_quantiles(stability.select(*keys, "cv"), keys, "cv", {"median_within_sample_cv": 0.5}, _squash("cv"))
    zero = exact_quantiles(stability.select(*keys, "zero_rate"), keys, "zero_rate", {"median_within_sample_zero_rate": 0.5}, _squash("zero_rate"))
    return base.join(q, keys).join(cv, keys, "left").join(zero, keys, "left")


def selection_frequency(
    flags: DataFrame, iterations: int, meta: DataFrame, schemes: list[Scheme] = SCHEMES, cohorts: tuple[str, str] = COHORTS
) -> DataFrame:
    """Per (scheme, clone) selected at least once: how often each set took it, the maximum over sets, its full category."""
    marks = [f"r_{s.name}_{m}" for s in schemes for m in MODEL_SETS]
    counts = flags.groupBy("cdr3_aa").agg(
        F.max("full_neg").alias("full_neg"), F.max("full_pos").alias("full_pos"), *[count_if(F.col(c)).alias(c) for c in marks])
    j = attach_totals(counts, cohort_sizes(meta, [], cohorts), [])
    names = categories(cohorts)

    def row(s: Scheme) -> Column:
        full = membership(F.col("full_neg"), F.col("full_pos"), F.col("n_neg"), F.col("n_pos"), s)
        cells = [F.lit(s.name).alias("scheme"), category(full, cohorts).alias("full_reference_category")]
        for m in MODEL_SETS:
            c = F.col(f"r_{s.name}_{m}")
            cells += [c.alias(f"{names[m]}_selection_count"), (c / iterations).alias(f"{names[m]}_selection_frequency")]
        return F.struct(*cells, (F.greatest(*[F.col(f"r_{s.name}_{m}") for m in MODEL_SETS]) / iterations).alias("max_selection_frequency"))

    return j.select("cdr3_aa", "full_neg", "full_pos", F.inline(F.array(*[row(s) for s in schemes]))).filter("max_selection_frequency > 0")


def most_selected(selection: DataFrame, limit: int, schemes: list[Scheme] = SCHEMES) -> DataFrame:
    """Per scheme the clones selected most often (the published cap); each scheme is a distributed top-k."""
    tops = [selection.filter(F.col("scheme") == s.name).orderBy(F.col("max_selection_frequency").desc(), "cdr3_aa").limit(limit) for s in schemes]
    return reduce(lambda a, b: a.unionByName(b), tops)


def screening(overview: DataFrame, features: DataFrame, cohorts: tuple[str, str] = COHORTS) -> DataFrame:
    """Empirical screen of every scheme: PASS_EMPIRICAL_SCREEN, or REVIEW with the failing rules and what was observed."""
    a, b = cohorts
    # Lowest acceptable median Jaccard per category, highest empty rate, lowest share of non-zero features.
    targets = {"global_public": 0.50, "shared": 0.50, f"{a}_specific": 0.30, f"{b}_specific": 0.30}
    rules = overview.groupBy("scheme").agg(
        *[F.max(F.when(F.col("category") == c, F.col("empty_rate"))).alias(f"e_{c}") for c in (f"{a}_specific", f"{b}_specific")],
        *[F.max(F.when(F.col("category") == c, F.col("median_jaccard_to_full"))).alias(f"j_{c}") for c in targets],
    )
    wanted = [f"{a}_specific_ref_frequency_sum", f"{b}_specific_ref_frequency_sum"]
    nonzero = features.groupBy("scheme").agg(*[F.max(F.when(F.col("feature") == f, F.col("nonzero_rate"))).alias(f"z_{f}") for f in wanted])

    def told(name: str, value: str, limit: str) -> Column:
        return F.concat(F.lit(f"{name}="), F.format_string("%.3f", F.round(value, 3)), F.lit(limit))

    reasons = [F.when(F.col(f"e_{c}") > 0.05, told(f"{c} empty_rate", f"e_{c}", ">0.05")) for c in (f"{a}_specific", f"{b}_specific")]
    reasons += [F.when(F.col(f"j_{c}") < t, told(f"{c} median_jaccard", f"j_{c}", f"<{t:.2f}")) for c, t in targets.items()]
    reasons += [F.when(F.col(f"z_{f}").isNull(), F.lit(f"missing feature {f}")).when(F.col(f"z_{f}") < 0.20, told(f"{f} nonzero_rate", f"z_{f}", "<0.20")) for f in wanted]
    text = join_reasons(reasons, "; ")
    out = rules.join(nonzero, "scheme", "left").withColumn("reasons", text)
    return out.select("scheme", F.when(F.col("reasons") == "", "PASS_EMPIRICAL_SCREEN").otherwise("REVIEW").alias("status"), "reasons")
