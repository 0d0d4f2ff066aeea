"""Split search with few partitions, series steps, feature families, crowded scores and unusable frequencies."""

import math

import pytest
from pyspark.sql import functions as F

from clonespan.functions import scalars as S
from clonespan.operators import clones as C
from clonespan.operators import joins as J
from clonespan.operators import modeling as O
from clonespan.operators import ranking as R
from clonespan.operators import splits as L


def test_outer_schedule_with_few_partitions(spark):
    rows = spark.createDataFrame([(f"s{i}", "AB"[i % 2], "m", "b", "F") for i in range(8)], "sample_id string, cohort string, material string, batch string, sex string")
    rows = rows.withColumn("age", F.lit("x"))
    out = L.outer_schedule(rows, 2, 20, 12).collect()
    assert {r.outer_repeat for r in out} == set(range(1, 21)) and len(out) == 160
    partitions = {}
    for r in out:
        partitions.setdefault(r.outer_repeat, set()).add((r.sample_id, r.outer_fold))
    different = len({frozenset(p) for p in partitions.values()})
    assert different >= 10  # repeats take partitions of their own while their candidates have any


@pytest.mark.parametrize("step", [1, -1])
def test_series_step(spark, step):
    values = [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 1.4, 1.6, 4.9, 5.1, 1.9, 2.1, 6.9, 7.1]
    got = {r.x: r.y for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", S.series_step("x", step).alias("y")).collect()}
    for x, y in got.items():
        lead = y / 10 ** math.floor(math.log10(y) + 1e-9)
        assert min(abs(lead - 1), abs(lead - 3)) < 1e-9 and (y > x if step > 0 else y < x)
    assert got[0.3] == pytest.approx(1.0 if step > 0 else 0.1)
    assert spark.range(1).select(S.series_step(F.lit(0.01), -1, 0.005)).first()[0] == pytest.approx(0.005)


def test_families_with_receptor_prefix(spark):
    names = ["R1_Shannon", "R2_Y_frequency", "R1_weighted_A_frequency", "cohort", "R1_unweighted_3mer_AAA", "R2_all_ref_public_clone_ratio", "R1_something_else", "sex"]
    t = spark.createDataFrame([(n, "categorical" if n in ("cohort", "sex") else "numeric") for n in names], "feature_name string, data_type string")
    got = {r.feature_name: (r.feature_group, r.feature_role, r.transformation) for r in O.classify_features(t, receptor_prefixes=["R1_", "R2_"]).collect()}
    assert got["R1_Shannon"][:2] == ("tcr_diversity", "candidate_predictor") and got["R2_Y_frequency"][1] == "composition_reference_drop"
    assert got["R1_weighted_A_frequency"][0] == "tcr_aa_composition_weighted" and got["R1_unweighted_3mer_AAA"][0] == "tcr_3mer_unweighted"
    assert got["R2_all_ref_public_clone_ratio"][0] == "public_reference_dynamic" and got["R1_something_else"][0] == "tcr_other_static"
    assert got["sex"][2] == O.ONE_HOT and got["cohort"][1] == "outcome_label"


def test_unit_level_is_monotone_and_spreads_rare_event_scores(spark):
    t = spark.range(2000).select((F.pow(F.lit(1.02), -F.col("id"))).alias("x")).unionByName(spark.createDataFrame([(v,) for v in (0.0, 0.25, 0.4999, 0.5, 0.75, 0.999, 1.0)], "x double"))
    rows = sorted((r.x, r.y) for r in t.select("x", R.unit_level("x").alias("y")).collect())
    assert [y for _, y in rows] == sorted(y for _, y in rows)
    small = [y for x, y in rows if 1e-9 < x < 1e-3]
    assert len(set(small)) > len(small) / 3


def test_running_totals_over_crowded_scores(spark):
    scores = [1e-12 * (1 + i % 50) for i in range(400)] + [0.3, 0.9, 1.0]
    t = spark.createDataFrame([(i, s, 1) for i, s in enumerate(scores)], "id int, s double, n bigint")
    out = R.running_totals(t, [], [F.col("s"), F.col("id")], ["n"], R.unit_level("s")).collect()
    order = sorted(range(len(scores)), key=lambda i: (scores[i], i))
    assert {r.id: r.n_before for r in out} == {i: k for k, i in enumerate(order)}


def test_checked_join_still_stops(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, x string, y double")
    assert sorted(map(tuple, J.checked_left_join(left, right, ["k"]).collect())) == [(1, "a", 1.0), (2, "b", None)]
    for bad in (right.limit(1), right.unionByName(right)):
        with pytest.raises(Exception, match="partner|repeated"):
            J.checked_left_join(left, bad, ["k"]).collect()


def test_infinite_frequency_fails_quality(spark):
    ok = {"input_nt_rows": 20, "valid_nt_rows": 20}
    t = spark.createDataFrame([("a", 1.0, 10), ("b", float("inf"), 10)], "sample_id string, frequency_sum double, total_reads_valid_nt bigint")
    t = t.withColumns({"frequency_norm_sum": F.col("frequency_sum") / F.col("frequency_sum"), "read_fraction_sum": F.lit(1.0), "aa_clone_number": F.lit(3), "frequency_source": F.lit("cell"), "valid_read_ratio": F.lit(1.0), "valid_nt_row_ratio": F.lit(1.0), **{k: F.lit(v) for k, v in ok.items()}})
    got = {r.sample_id: r.qc_pass_01 for r in C.quality_verdict(t, 10, 0.7, 0.7, 1e-6).collect()}
    assert got == {"a": True, "b": False}
