"""Findings of the third review: sizes that Spark misjudges, planted differences, work in one task."""

import duckdb
from pyspark.sql import functions as F

from checks.compare import compare
from checks.views import Views
from clonespan.functions import sequences as Q
from clonespan.operators import features as X
from clonespan.operators import joins as J
from clonespan.operators import modeling as O
from clonespan.operators import ranking as R
from clonespan.session import spread


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dynamic_features_are_not_broadcast(spark):
    static = spark.range(10).select(F.col("id").alias("s"), (F.col("id") * 2).alias("x"))
    dynamic = spark.range(10).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("rep"))
    out = J.with_dynamic_features(static, dynamic, ["s"])
    assert "Broadcast" not in plan_of(out)
    assert sorted((r.s, r.rep, r.x) for r in out.collect()) == [(s, r, 2 * s) for s in range(10) for r in range(1, 21)]


def test_compare_tolerance_with_customers_without_orders(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    lonely = customers.filter("c_mktsegment = 'BUILDING'").agg(F.min("c_custkey")).first()[0]
    spark.read.parquet(f"{sf}/orders.parquet").filter(F.col("o_custkey") != lonely).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    customers.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert compare(spark, con, "join8_compare_tolerance", str(tmp_path)).startswith("ok")


def test_predictions_are_dealt_over_tasks(spark):
    preds = Views(spark, "/root/testdata/sf0.1").preds
    sizes = [r["count"] for r in preds.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 1_200_000 and max(sizes) < 500_000  # 15,000 customers x 80
    once = preds.groupBy("model", "outer_repeat", "sample_id").count()
    assert "hashpartitioning(model" not in plan_of(once)  # keys with the dealt column need no further shuffle


def test_spread_of_an_empty_table(spark):
    assert spread(spark.range(0), "id", 80).isEmpty()


def test_match_counts_in_one_aggregation(spark):
    schema = "a int, b string"
    assigned = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (3, None), (4, "y"), (4, "y")], schema)
    predicted = spark.createDataFrame([(1, "x"), (1, "x"), (3, None), (5, "z"), (None, "x")], schema)
    out = J.match_counts(predicted, assigned, ["a", "b"])
    assert "Join" not in plan_of(out)
    assert tuple(out.first()) == (1, 3, 3)  # a key with a null matches nothing, on both sides
    assert tuple(J.match_counts(predicted.limit(0), assigned.limit(0), ["a", "b"]).first()) == (0, 0, 0)


def test_running_totals_do_not_broadcast_rows(spark):
    rows = spark.range(20).select("id", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("seed"), F.md5(F.col("id").cast("string")).alias("h"))
    out = R.positions(rows, ["seed"], "h", "id")
    assert "Broadcast" not in plan_of(out)
    assert sorted((r.seed, r.position) for r in out.collect()) == [(s, p) for s in range(1, 6) for p in range(20)]


def test_letters_are_counted_one_by_one(spark):
    out = spark.createDataFrame([("ACCA",), ("",), (None,)], "s string").select(Q.letter_count("s", "CAC").alias("n"), Q.letter_count("s", "K").alias("k"))
    assert [(r.n, r.k) for r in out.collect()] == [(4, 0), (0, 0), (None, None)]
    assert "translate" not in plan_of(out)


def test_clones_are_cut_from_the_texts_once(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    for out in (X.core_table(v.clones, v.seqs.groupBy("sample_id").agg(*[F.sum("read_count").alias(c) for c in ("total_reads_all_nt", "input_nt_rows", "valid_nt_row_ratio")]), ["sample_id"]),
                X.kmer_features(v.clones, ["sample_id"])):
        assert "documents.parquet" not in plan_of(out)  # the written clones are read
    assert "hashpartitioning(sample_id" not in plan_of(v.clones)  # and not dealt by source, of which there are few
    assert v.clones.count() == v.seqs.count()


def test_letters_and_windows_are_counted_in_narrow_rows(spark):
    clones = spark.createDataFrame([("s", "ACAC", 4, 0.5), ("s", "CCCC", 4, 0.25), ("s", "AC", 2, 0.25), ("t", "AXA", 3, 1.0), ("t", "", 0, None)], "sample_id string, cdr3_aa string, aa_length int, frequency_norm double")
    c = {r.sample_id: r for r in X.composition(clones, ["sample_id"]).collect()}
    assert (c["s"].A_frequency, c["s"].C_frequency, c["s"].weighted_A_frequency, c["s"].weighted_W_frequency) == (1 / 3, 2 / 3, 0.375, 0.0)
    assert abs(c["t"].A_frequency - 2 / 3) < 1e-12 and c["t"].C_frequency == 0
    n = {r.sample_id: r for r in X.length_statistics(clones.filter("cdr3_aa <> 'AC'"), ["sample_id"]).collect()}
    assert (n["s"].mean_aa_length, n["s"].median_aa_length, n["s"].sd_aa_length) == (4, 4, 0) and n["t"].sd_aa_length == 1.5
    k = {(r.sample_id, r.kmer): (r.clones_with_kmer, r.weighted_value) for r in X.kmer_features(clones, ["sample_id"]).collect()}
    assert k == {("s", "ACA"): (1, 0.5), ("s", "CAC"): (1, 0.5), ("s", "CCC"): (1, 0.25), ("t", "AXA"): (1, 1.0)}
    plan = plan_of(X.core_table(clones.withColumn("read_count", F.lit(1)).withColumn("nt_clone_number", F.lit(1)), clones.select("sample_id", *[F.lit(1).alias(x) for x in ("total_reads_all_nt", "input_nt_rows", "valid_nt_row_ratio")]), ["sample_id"]))
    assert "replace(cdr3_aa" not in plan and "array_distinct" not in plan_of(X.kmer_features(clones, ["sample_id"]))


def test_ranks_of_one_sort(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 7 < 5, "hot").when(F.col("id") % 7 == 5, "b").alias("g"), ((F.col("id") * 7919) % 3001).alias("x"))
    out = R.ordered_ranks(rows, ["g"], [F.col("x").desc()], "r")
    assert "Window" not in plan_of(out)  # no window over the rows: a hot group, or value, is in no single task
    found = {}
    for r in out.collect():
        found.setdefault(r.g, []).append((r.r, r.x))
    for g in found.values():
        assert [x for _, x in sorted(g)] == sorted((x for _, x in g), reverse=True) and sorted(i for i, _ in g) == list(range(1, len(g) + 1))
    assert sum(map(len, found.values())) == 3000
    assert R.ordered_ranks(rows.limit(0), ["g"], [F.col("x")], "r").isEmpty()


def test_scores_are_folded_once(spark):
    rows = spark.range(1000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("g"), (F.col("id") % 50 / 50).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = R.score_blocks(rows, ["g"], "p", "y")
    assert "Generate" not in plan_of(out)  # reads the written blocks, not the rows
    top = out.filter("g = 'a'").orderBy("threshold").first()
    assert (top.tp, top.fp, out.count()) == (334, 666, 100)
    assert R.score_blocks(rows.limit(0), ["g"], "p", "y").isEmpty()


def test_selected_predictions_are_not_broadcast(spark):
    people = spark.range(100).select(F.col("id").alias("sample_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("rep"), (F.col("id") / 100).alias("p"))
    preds = people.select("*", F.lit(0.5).alias("l1_ratio_alpha"), F.lit(1.0).alias("lambda"))
    best = spark.range(1, 3).select(F.col("id").cast("int").alias("rep"), F.lit(0.5).alias("l1_ratio_alpha"), F.lit(1.0).alias("lambda"))
    cuts = best.groupBy("rep").agg(F.max("l1_ratio_alpha").alias("threshold"))
    out = O.selected_predictions(preds, best, cuts, ["rep"])
    assert "BuildLeft" not in plan_of(out) and plan_of(out).count("BuildRight") == 2
    assert out.filter("predicted_label = 1").count() == 100 and out.count() == 200
