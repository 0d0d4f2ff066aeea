"""Spark views over the given tables: the inputs of the checked queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonespan.functions.sequences import RESIDUES
from clonespan.session import spread, stored

LOWER = "abcdefghijklmnopqrstuvwxyz"


class Views:
    """Lazily built inputs.  Every view is derived from whole tables; none is cached, one is written for its many readers."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- clone rows --------------------------------------------------------------------------------------------

    @cached_property
    def nt_clones(self) -> DataFrame:
        """Clone rows: nucleotides spelled from the part key, reads from the quantity; two receptors by line status."""
        hexes = F.md5(F.col("l_partkey").cast("string"))
        length = F.when(F.col("l_linenumber") == 7, 10).otherwise(9)
        return self.table("lineitem").select(
            (F.col("l_orderkey") % 100).alias("sample_id"),
            F.col("l_linestatus").alias("receptor"),
            F.translate(F.substring(hexes, 1, length), "0123456789abcdef", "ACGTACGTACGTACGT").alias("cdr3_nt"),
            F.col("l_quantity").cast("bigint").alias("read_count"),
            F.col("l_discount").alias("input_frequency"),
            F.col("l_tax").alias("input_cell_frequency"),
            F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"),
        )

    @cached_property
    def nt_lines(self) -> DataFrame:
        """The same rows as text lines, with defects in the tokens of some of them."""
        k, n = F.col("l_partkey"), F.col("l_linenumber")
        hexes = F.translate(F.md5(k.cast("string")), "0123456789abcdef", "ACGTACGTACGUacgt")
        quantity = F.col("l_quantity").cast("bigint").cast("string")
        parts = self.table("lineitem").withColumn("hexes", hexes).select(
            (F.col("l_orderkey") % 100).alias("sample_id"), (k % 19).alias("kind"),
            F.when(k % 11 == 3, F.concat(F.substring("hexes", 1, 8), F.lit("N"))).otherwise(
                F.substring("hexes", F.lit(1), F.when(n == 7, 10).otherwise(9))).alias("nt"),
            F.when(k % 13 == 5, F.lit("-1")).when(k % 13 == 6, F.lit("abc")).when(k % 13 == 7, F.concat(quantity, F.lit(".0"))).otherwise(quantity).alias("reads"),
            F.when(k % 17 == 2, F.lit("nan")).otherwise(F.lit("0.5")).alias("freq"),
            F.when(n % 3 == 0, F.lit(" ")).when(n % 3 == 1, F.lit(", ")).otherwise(F.lit("\t")).alias("sep"),
        )
        tail = F.when(F.col("kind") == 1, F.lit("")).otherwise(F.concat(F.col("sep"), F.lit("0.25")))
        head = F.when(F.col("kind") == 2, F.lit("# ")).otherwise(F.lit(""))
        line = F.when(F.col("kind") == 3, F.lit("   ")).otherwise(F.concat(head, "nt", "sep", "reads", "sep", "freq", tail))
        return parts.select("sample_id", line.alias("value"))

    # -- sample metadata ---------------------------------------------------------------------------------------

    @cached_property
    def samples(self) -> DataFrame:
        """The samples of the incidence tables with cohort, batch, material and sex."""
        s = F.col("sample_id")
        ids = self.table("orders").select((F.col("o_orderkey") % 100).alias("sample_id")).distinct()
        return ids.select(
            s, F.when(s % 5 < 3, F.lit("A")).otherwise(F.lit("B")).alias("cohort"), (s % 4).cast("string").alias("batch"),
            (s % 3).cast("string").alias("material"), (s % 2).cast("string").alias("sex"), s.alias("patient"),
            (30 + (s * 7) % 50).alias("age"),
        )

    @cached_property
    def subjects(self) -> DataFrame:
        """Customers as study subjects: the population of the splits and folds."""
        return self.table("customer").select(
            F.col("c_custkey").alias("sample_id"),
            F.when(F.col("c_acctbal") > 4500, F.lit("B")).otherwise(F.lit("A")).alias("cohort"),
            (F.col("c_nationkey") % 4).cast("string").alias("batch"),
            F.col("c_mktsegment").alias("material"),
            (F.col("c_custkey") % 2).cast("string").alias("sex"),
            F.col("c_custkey").alias("patient"),
            (20 + F.col("c_custkey") % 60).alias("age"),
        )

    # -- incidence ---------------------------------------------------------------------------------------------

    @cached_property
    def inc(self) -> DataFrame:
        """(sample, clone) incidence with the clone's share of the sample."""
        return self._incidence([])

    @cached_property
    def inc2(self) -> DataFrame:
        return self._incidence(["receptor"])

    def _incidence(self, keys: list[str]) -> DataFrame:
        raw = self.table("lineitem").select(
            F.col("l_linestatus").alias("receptor"), (F.col("l_orderkey") % 100).alias("sample_id"),
            F.col("l_partkey").alias("cdr3_aa"), F.col("l_extendedprice").alias("w"),
        )
        cells = raw.groupBy(*keys, "sample_id", "cdr3_aa").agg(F.sum("w").alias("w"))
        totals = raw.groupBy(*keys, "sample_id").agg(F.sum("w").alias("t"))
        return cells.join(totals, [*keys, "sample_id"]).select(*keys, "sample_id", "cdr3_aa", (F.col("w") / F.col("t")).alias("frequency_norm"))

    # -- residue sequences -------------------------------------------------------------------------------------

    @cached_property
    def seqs(self) -> DataFrame:
        """Amino-acid clones per source: every document's letters cut into consecutive pieces, whole texts used.

        Cutting and folding them is most of the work of the queries that read them in several branches, so they are written once.
        """
        docs = self.table("documents").select(
            F.col("source").alias("sample_id"), "n_chars", (8 + F.col("doc_id") % 20).cast("int").alias("k"),
            F.upper(F.regexp_replace("text", f"[^{RESIDUES}{RESIDUES.lower()}]+", "")).alias("letters"),
        )
        # Runs of up to k letters, in one pass over the text.
        runs = F.regexp_extract_all("letters", F.concat(F.lit(".{1,"), F.col("k").cast("string"), F.lit("}")), F.lit(0))
        pieces = docs.select("sample_id", "n_chars", F.explode(runs).alias("cdr3_aa"))
        return stored(pieces.groupBy("sample_id", "cdr3_aa").agg(F.sum("n_chars").alias("read_count"), F.count(F.lit(1)).alias("nt_clone_number")))

    @cached_property
    def clones(self) -> DataFrame:
        """`seqs` with length and share: a clone table."""
        # written: Spark knows that a row per source is small, and does not deal the clones by source for it
        totals = stored(self.seqs.groupBy("sample_id").agg(F.sum("read_count").alias("t")))
        return self.seqs.join(totals, "sample_id").select(
            "sample_id", "cdr3_aa", F.length("cdr3_aa").alias("aa_length"), "nt_clone_number", "read_count",
            (F.col("read_count") / F.col("t")).alias("read_fraction"), (F.col("read_count") / F.col("t")).alias("frequency_norm"),
        )

    # -- scores and cross-validation results -------------------------------------------------------------------

    @cached_property
    def scored(self) -> DataFrame:
        y = F.when(F.col("c_acctbal") > 4500, 1).otherwise(0)
        return self.table("customer").select(
            F.col("c_custkey").alias("sample_id"), y.alias("y"), (((F.col("c_custkey") * 31) % 101 + 20 * y) / F.lit(121.0)).alias("p"),
        )

    @cached_property
    def preds(self) -> DataFrame:
        """Out-of-fold predictions: every customer in 20 repeats of 5 folds under 4 models."""
        k = F.col("c_custkey")
        people = spread(self.table("customer").select(k, F.when(F.col("c_acctbal") > 4500, 1).otherwise(0).alias("y")), "c_custkey", 80)
        grid = people.select("*", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("outer_repeat")).select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("model"))
        p = ((k * 31 + F.col("outer_repeat") * 17 + F.col("model") * 7) % 101 + 10 * F.col("y") * F.col("model")) / F.lit(131.0)
        return grid.select(
            k.alias("sample_id"), "y", "outer_repeat", ((k + F.col("outer_repeat")) % 5 + 1).alias("outer_fold"),
            F.concat(F.lit("M"), F.col("model").cast("string")).alias("model"), p.alias("p"), F.lit(0.5).alias("threshold"),
        )

    @cached_property
    def coefs(self) -> DataFrame:
        """Coefficients per (model, feature, task) from the events; small ones are set to zero."""
        c = F.sum("value") - 35
        return self.table("events").groupBy(
            F.col("event_type").alias("model"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("feature_name"), (F.col("event_id") % 100).alias("task"),
        ).agg(F.when(F.abs(c) < 15, F.lit(0.0)).otherwise(c).alias("coefficient"))

    @cached_property
    def params(self) -> DataFrame:
        """Selected parameters: one row per order, read as (repeat, fold, model) tasks of a large study."""
        k = F.col("o_orderkey")
        rep, fold, model = (k % 20 + 1), (F.floor(k / 20) % 5 + 1), (F.floor(k / 100) % 4)
        t = self.table("orders").select(k.alias("task"), rep.alias("outer_repeat"), fold.alias("outer_fold"), model.alias("m"))
        r, f, m = F.col("outer_repeat"), F.col("outer_fold"), F.col("m")
        alpha = F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)]), ((r * 7 + f * 3 + m + F.col("task")) % 3 + 1).cast("int"))
        lam = F.element_at(F.array(*[F.lit(x) for x in (0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0)]), ((r * f + m) % 8 + 1).cast("int"))
        return t.select(
            "task", "outer_repeat", "outer_fold", F.concat(F.lit("M"), m.cast("string")).alias("model"), alpha.alias("l1_ratio_alpha"), lam.alias("lambda"),
            (((r * 13 + f * 29 + m + F.col("task")) % 97) / F.lit(97.0)).alias("threshold"),
            (0.5 + ((r + f) % 10) / F.lit(25.0)).alias("inner_roc_auc"), (0.4 + ((r * f) % 10) / F.lit(25.0)).alias("inner_pr_auc"),
        )

    @cached_property
    def matrix(self) -> DataFrame:
        """Modelling matrix: customers with demographics, order statistics and a constant column."""
        orders = self.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"), F.max("o_totalprice").alias("x"),
        )
        j = self.table("customer").join(orders, "c_custkey", "left")
        return j.select(
            F.col("c_custkey").alias("sample_id"), F.when(F.col("c_acctbal") > 4500, 1).otherwise(0).alias("y"),
            (F.col("c_custkey") % 60 + 20).cast("double").alias("age"), (F.col("c_custkey") % 2).cast("string").alias("sex"),
            F.col("c_mktsegment").alias("material"), F.coalesce("n", F.lit(0)).cast("double").alias("x1"),
            F.coalesce("m", F.lit(0.0)).alias("x2"), F.coalesce("x", F.lit(0.0)).alias("x3"),
            F.col("c_nationkey").cast("double").alias("x4"), F.lit(1.0).alias("x5"), (F.col("c_custkey") % 5 + 1).alias("fold"),
        )
