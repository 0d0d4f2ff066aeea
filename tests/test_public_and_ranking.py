"""Brute-force equivalence of the public-clone operators, and skew-safe ranking."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespan.operators import public as P
from clonespan.operators import splits as L
from clonespan.operators.ranking import exact_quantiles, positions, running_totals, score_blocks, small_share_level, unit_level


@pytest.fixture(scope="module")
def study(spark):
    rng = random.Random(5)
    samples = [(i, "A" if i % 5 < 3 else "B", i % 4 + 1) for i in range(20)]
    cells = [(i, c, rng.random()) for i, _, _ in samples for c in range(80) if rng.random() < (0.45 if c < 20 else 0.12) + (0.3 if (c % 2 == 0) == (i % 5 < 3) and c < 40 else 0)]
    cells.append((0, 999, 0.5))  # only in the held-out sample
    mass = {i: sum(f for j, _, f in cells if j == i) for i, _, _ in samples}
    cells = [(i, c, f / mass[i]) for i, c, f in cells]
    return (spark.createDataFrame(cells, "sample_id int, cdr3_aa int, frequency_norm double"), spark.createDataFrame(samples, "sample_id int, cohort string, fold int"), samples, cells)


def flags(a, b, na, nb, s=P.MAIN):
    t = lambda n, p, m: max(m, math.ceil(p * n))
    ga, gb = a >= t(na, s.group_min_prevalence, s.group_min_count), b >= t(nb, s.group_min_prevalence, s.group_min_count)
    sa, sb = ga and a / na - b / nb >= s.specific_prevalence_delta, gb and b / nb - a / na >= s.specific_prevalence_delta
    return {"global": a + b >= t(na + nb, s.global_min_prevalence, s.global_min_count), "neg_specific": sa, "pos_specific": sb, "shared": ga and gb and not sa and not sb}


def rebuild(reference, target, samples, cells):
    """Features of one target sample against the reference built from the given samples."""
    cohort = {i: c for i, c, _ in samples}
    na, nb = sum(cohort[i] == "A" for i in reference), sum(cohort[i] == "B" for i in reference)
    count = {}
    for i, c, _ in cells:
        if i in reference:
            count.setdefault(c, [0, 0])[cohort[i] == "B"] += 1
    sets = {c: flags(a, b, na, nb) for c, (a, b) in count.items()}
    own = [(c, f) for i, c, f in cells if i == target]
    out = {}
    for s, p in P.model_prefixes().items():
        n = sum(sets.get(c, {}).get(s, False) for c, _ in own)
        size = sum(f[s] for f in sets.values())
        out |= {f"{p}_clone_number": n, f"{p}_clone_ratio": n / len(own), f"{p}_frequency_sum": sum(f for c, f in own if sets.get(c, {}).get(s, False)), f"{p}_set_coverage": n / size if size else 0.0, f"{p}_size": size}
    return out


def test_leave_one_out_equals_rebuild(study):
    cells_df, meta, samples, cells = study
    ids = {i for i, _, _ in samples}
    for r in P.leave_one_out(cells_df, meta).collect():
        want = rebuild(ids - {r.sample_id}, r.sample_id, samples, cells)
        for k, v in want.items():
            assert math.isclose(r[k], v, abs_tol=1e-12), (r.sample_id, k)


def test_leave_one_out_with_complement_counts(study):
    cells_df, meta, samples, cells = study
    outer = meta.withColumn("outer_repeat", F.lit(1)).withColumnRenamed("fold", "outer_fold")
    labelled = cells_df.join(meta.withColumnRenamed("fold", "task_fold"), "sample_id")
    counts = P.training_counts(labelled, [], "task_fold", 4)
    members = L.outer_tasks(outer, 4).filter("role = 'training'").select("task_fold", "sample_id", "cohort")
    got = P.leave_one_out(cells_df, members, ["task_fold"], counts=counts).collect()
    assert len(got) == 60
    for r in got:
        want = rebuild({i for i, _, f in samples if f != r.task_fold} - {r.sample_id}, r.sample_id, samples, cells)
        for k, v in want.items():
            assert math.isclose(r[k], v, abs_tol=1e-12), (r.task_fold, r.sample_id, k)


def test_crossfit_equals_rebuild(study):
    cells_df, meta, samples, cells = study
    for r in P.crossfit(cells_df, meta, [], "fold", 4).collect():
        want = rebuild({i for i, _, f in samples if f != r.fold}, r.sample_id, samples, cells)
        for k, v in want.items():
            if not k.endswith("_size"):
                assert math.isclose(r[k], v, abs_tol=1e-12), (r.sample_id, k)


def test_labels_of_scored_samples_do_not_leak(study):
    cells_df, meta, _, _ = study
    train = meta.filter("fold <> 1")
    ref = P.reference_table(P.presence_counts(P.with_cohort(cells_df, train)), P.cohort_sizes(train))
    held = cells_df.join(meta.filter("fold = 1").select("sample_id"), "sample_id", "left_semi")
    flipped = meta.withColumn("cohort", F.when(F.col("fold") == 1, F.when(F.col("cohort") == "A", "B").otherwise("A")).otherwise(F.col("cohort")))
    again = flipped.filter("fold <> 1")
    ref2 = P.reference_table(P.presence_counts(P.with_cohort(cells_df, again)), P.cohort_sizes(again))
    key = lambda df: sorted(tuple(round(x, 9) for x in r) for r in P.external_features(held, df).collect())
    assert key(ref) == key(ref2)


def test_sets_are_disjoint_and_bounded(study):
    cells_df, meta, _, _ = study
    f = P.flagged(P.presence_counts(P.with_cohort(cells_df, meta)), P.cohort_sizes(meta))
    both = f.filter("(neg_specific and pos_specific) or (shared and (neg_specific or pos_specific))").count()
    assert both == 0
    assert all(r.in_range for r in P.range_check(P.overlap_features(cells_df, P.reference_table(P.presence_counts(P.with_cohort(cells_df, meta)), P.cohort_sizes(meta)))).collect())


def test_empty_set_has_zero_coverage(spark, study):
    cells_df, meta, _, _ = study
    strict = P.Scheme("none", 1.0, 99, 1.0, 99, 1.0)
    ref = P.reference_table(P.presence_counts(P.with_cohort(cells_df, meta)), P.cohort_sizes(meta), [], strict)
    row = P.external_features(cells_df, ref).first()
    assert row.all_ref_public_set_coverage == 0.0 and row.B_A_specific_ref_frequency_log_ratio == 0.0


def test_running_totals_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(30)}", rng.random() ** 6) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double").withColumn("one", F.lit(1))
    for level in (unit_level("x"), small_share_level("x")):
        got = running_totals(df, ["g"], [F.col("x")], ["one"], level).collect()
        seen = {}
        for r in sorted(got, key=lambda r: (r.g, r.x)):
            assert r.one_before == seen.get(r.g, 0)
            seen[r.g] = seen.get(r.g, 0) + 1


def test_quantiles_match_numpy(spark):
    rng = random.Random(2)
    rows = [("a", round(rng.random(), 2)) for _ in range(501)] + [("b", rng.random()) for _ in range(40)] + [("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    for g in "ab":
        v = [x for k, x in rows if k == g and x is not None]
        for name, q in (("q1", 0.25), ("m", 0.5), ("q9", 0.9)):
            assert math.isclose(got[g][name], np.quantile(v, q), abs_tol=1e-12)


def test_positions_are_dense(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = positions(df, ["g"], "h", "id").collect()
    for g in (0, 1):
        assert sorted(r.position for r in got if r.g == g) == list(range(250))


def test_score_blocks_with_extra_thresholds(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.2), (0, 0.1)], "y int, p double")
    got = {r.threshold: (r.tp, r.fp) for r in score_blocks(df, [], "p", "y", [0.0, 0.5, 1.0]).collect()}
    assert got == {1.0: (0, 0), 0.9: (1, 1), 0.5: (1, 1), 0.2: (2, 1), 0.1: (2, 2), 0.0: (2, 2)}
