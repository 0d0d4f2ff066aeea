"""Hand-computed cases for parsing, translation, classification and the clone table."""

import math

import pytest
from pyspark.sql import functions as F

from clonespan.functions import scalars as S
from clonespan.functions import sequences as Q
from clonespan.operators import clones as C
from clonespan.operators import features as X
from clonespan.sources import readers, writers

LINES = [
    "tgugcc 5 0.5 0.1", "TGTGCC,3,0.2,0.1", "TGCGCA\t8 0.1 0.3", "", "   ", "# TGT 1 1 1", "TGT 4 0.1", "TGT x 0.1 0.1", "TGT -1 0.1 0.1", "TGT 2.5 0.1 0.1",
    "TGT 3.0 0.1 0.1", "TGT inf 0.1 0.1", "TGT 2 nan 0.1", "TG 2 0.1 0.1", "TGTA 2 0.1 0.1", "TGN 2 0.1 0.1", "TAATGT 7 0.1 0.1", "TGTTAATGT 7 0.1 0.1", "TGTTGA 7 0.1 0.1", "TGT 1d 0.1 0.1",
]


@pytest.fixture(scope="module")
def parsed(spark):
    lines = spark.createDataFrame([("s1", x) for x in LINES] + [("s2", "TGTGCC 0 0 0")], "sample_id string, value string")
    return C.parse_tokens(readers.clone_tokens(lines))


def test_translation_matches_the_code_table(spark):
    codons = [a + b + c for a in Q.CODE_BASES for b in Q.CODE_BASES for c in Q.CODE_BASES]
    df = spark.createDataFrame([("".join(codons),), ("ATG",), ("",)], "nt string")
    got = [r[0] for r in df.select(Q.translate_nt("nt")).collect()]
    assert got == [Q.CODE_RESIDUES, "M", ""]


def test_reasons(parsed):
    got = {r["reason"]: r["n"] for r in parsed.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {None: 5, "malformed_columns": 1, "invalid_read_count": 5, "invalid_frequency": 1, "length_not_multiple_of_3": 2, "non_acgt_base": 1, "stop_codon": 3}


def test_clone_table(parsed):
    rows = {(r.sample_id, r.cdr3_aa): r for r in C.aa_clone_table(parsed).collect()}
    ca = rows["s1", "CA"]
    assert (ca.read_count, ca.nt_clone_number, ca.top_nt_cdr3) == (16, 2, "TGCGCA")  # equal reads: smallest variant
    assert math.isclose(ca.read_fraction, 16 / 19) and math.isclose(ca.frequency_norm, 0.5 / 0.6)
    assert ("s2", "CA") not in rows  # no reads


def test_summary_and_policy(parsed):
    s = {r.sample_id: r for r in C.sample_summary(parsed).collect()}
    assert s["s1"].input_nt_rows == 17 and s["s1"].valid_nt_rows == 4 and s["s1"].qc_pass_01
    assert s["s1"].total_reads_all_nt == 4 + 16 + 3 + 2 + 2 + 2 + 2 + 21
    assert not s["s2"].qc_pass_01 and "no usable frequency source" in s["s2"].qc_warning_01
    assert [r.sample_id for r in C.excluded_samples(C.sample_summary(parsed)).collect()] == ["s2"]
    with pytest.raises(Exception, match="invalid clone row"):
        C.apply_invalid_policy(parsed, "error").collect()


def test_invalid_summary_keeps_all_reasons(parsed):
    got = {r.translate_status: r for r in C.invalid_summary(parsed).collect()}
    assert list(sorted(got)) == sorted(Q.INVALID_REASONS)
    assert got["empty_sequence"].invalid_nt_rows == 0 and got["invalid_read_count"].rows_without_parseable_reads == 5


def test_kmers_and_edge_lengths(spark):
    df = spark.createDataFrame([("AC",), ("ACAC",), ("AAAA",), ("",)], "aa string")
    assert [r[0] for r in df.select(Q.distinct_kmers("aa")).collect()] == [[], ["ACA", "CAC"], ["AAA"], []]


def test_single_clone_and_zero_frequency(spark):
    one = spark.createDataFrame([("s", "CA", 2, 1, 1, 1.0)], "sample_id string, cdr3_aa string, aa_length int, nt_clone_number int, read_count int, frequency_norm double")
    assert X.diversity(one, ["sample_id"]).first().clonality == 1.0
    g = X.evenness_and_expansion(one, ["sample_id"]).first()
    assert g.Gini == 0.0 and g.top1_frequency == 1.0 and g.top50_cumulative_frequency == 1.0


def test_scalars(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (45,)], "n int")
    assert [r[0] for r in df.select(S.stratum_train_size("n", 0.7)).collect()] == [1, 1, 2, 31]
    assert [r[0] for r in df.select(S.count_threshold("n", 0.05, 2)).collect()] == [2, 2, 2, 3]
    x = spark.createDataFrame([(0.0,), (1e-7,), (1234567890123456.0,), (0.1,)], "x double")
    assert [r[0] for r in x.select(S.fixed_precision_text("x")).collect()] == ["0", "1e-07", "1.23456789012e+15", "0.1"]


def test_files_round_trip(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a_clones.txt").write_bytes("﻿TGTGCC 5 0.5 0.1\n# note\n\nTGC,1,0.1,0.2\n".encode())
    (d / "b_clones.txt").write_text("TGT 2 0.1 0.1\n")
    lines = readers.read_clone_lines(spark, str(d), "_clones.txt")
    parsed = C.parse_tokens(readers.clone_tokens(lines))
    assert sorted((r.sample_id, r.cdr3_aa) for r in parsed.collect()) == [("a", "C"), ("a", "CA"), ("b", "C")]
    assert sorted(r.sample_id for r in readers.discover_samples(spark, str(d), "_clones.txt").collect()) == ["a", "b"]
    out = str(tmp_path / "out")
    writers.write_clone_table(C.aa_clone_table(parsed), out)
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_clone_table(C.aa_clone_table(parsed), out)
    writers.write_clone_table(C.aa_clone_table(parsed), out, overwrite=True)
    assert spark.read.parquet(out).count() == 3


def test_header_lines_are_dropped_per_file(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text("cdr3 reads f1 f2\nTGT 2 0.1 0.1\n")
    lines = readers.read_clone_lines(spark, str(tmp_path), ".txt", has_header=True)
    assert sorted(r.value for r in lines.collect()) == ["TGT 2 0.1 0.1"] * 2


def test_task_results_resume(spark, tmp_path):
    path = str(tmp_path / "tasks")
    one = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.6)], "outer_repeat int, outer_fold int, p double")
    writers.write_task_results(one, path)
    writers.write_task_results(spark.createDataFrame([(1, 2, 0.9)], one.schema), path)
    got = readers.read_task_results(spark, path, "p double, outer_repeat int, outer_fold int")
    assert sorted((r.outer_fold, r.p) for r in got.collect()) == [(1, 0.5), (2, 0.9)]
