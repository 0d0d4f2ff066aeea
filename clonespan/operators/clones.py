"""Nucleotide rows -> amino-acid clone table with full quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import count_if, integral, join_reasons, parse_nonnegative_float, safe_ratio
from ..functions.sequences import INVALID_REASONS, normalize_nt, sequence_reason, translate_nt

FREQUENCY_SOURCES = ["input_cell_frequency_sum", "input_frequency_sum", "read_fraction"]


def parse_tokens(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Type the tokens of every line and attach the first failing rule (`reason`, null when valid)."""
    rest = [c for c in rows.columns if c != tokens]
    raw = ["cdr3_nt_raw", "read_count_raw", "input_frequency_raw", "input_cell_frequency_raw"]
    split = rows.select(*rest, *[F.get(tokens, F.lit(i)).alias(n) for i, n in enumerate(raw)])
    typed = split.select(
        *rest, *raw, normalize_nt(raw[0]).alias("cdr3_nt"), parse_nonnegative_float(raw[1]).alias("_reads"),
        parse_nonnegative_float(raw[2]).alias("input_frequency"), parse_nonnegative_float(raw[3]).alias("input_cell_frequency"),
    ).withColumn("read_count", integral("_reads")).drop("_reads")
    return classify(typed, complete=F.col(raw[3]).isNotNull())


def classify(typed: DataFrame, complete: Column | None = None) -> DataFrame:
    """Add `cdr3_aa` and `reason` to typed rows; `complete` tells whether a row had all four tokens."""
    nt = F.col("cdr3_nt")
    clean = (F.length(nt) % 3 == 0) & nt.rlike("^[ACGT]+$")
    with_aa = typed.withColumn("_aa", F.when(clean, translate_nt("cdr3_nt")))
    reason = (
        F.when(~(F.lit(True) if complete is None else complete), F.lit("malformed_columns"))
        .when(F.col("read_count").isNull(), F.lit("invalid_read_count"))
        .when(F.col("input_frequency").isNull() | F.col("input_cell_frequency").isNull(), F.lit("invalid_frequency"))
        .otherwise(sequence_reason("cdr3_nt", "_aa"))
    )
    judged = with_aa.withColumn("reason", reason)
    verdict = F.struct("reason", F.when(F.col("reason").isNull(), F.col("_aa")).alias("cdr3_aa"))
    # The generator keeps later filters on the verdict above this point.  Pushed below it, a filter would repeat the whole
    # parse once for itself and once for its output.
    return judged.select(*typed.columns, F.inline(F.array(verdict)))


def apply_invalid_policy(parsed: DataFrame, policy: str = "skip") -> DataFrame:
    """`skip` keeps valid rows; `error` stops the job at the first invalid row it meets."""
    if policy == "skip":
        return parsed.filter("reason is null")
    fail = F.raise_error(F.concat(F.lit("invalid clone row: "), F.col("reason")))
    return parsed.withColumn("reason", F.when(F.col("reason").isNotNull(), fail).otherwise(F.col("reason")))


def aa_clone_sums(parsed: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:
    """Two-level aggregation: per nucleotide variant, then per residue sequence, with the leading variant."""
    by_nt = (
        parsed.filter("reason is null").groupBy(*keys, "cdr3_aa", "cdr3_nt")
        .agg(
            F.sum("read_count").alias("reads"),
            F.sum("input_frequency").alias("freq"),
            F.sum("input_cell_frequency").alias("cell_freq"),
        )
    )
    return by_nt.groupBy(*keys, "cdr3_aa").agg(
        F.length(F.first("cdr3_aa")).alias("aa_length"),
        F.count(F.lit(1)).alias("nt_clone_number"),
        F.sum("reads").alias("read_count"),
        F.sum("freq").alias("input_frequency_sum"),
        F.sum("cell_freq").alias("input_cell_frequency_sum"),
        F.min_by("cdr3_nt", F.struct(-F.col("reads"), F.col("cdr3_nt"))).alias("top_nt_cdr3"),
    )


def with_source(sums: DataFrame, source: str = "auto") -> DataFrame:
    """Add the frequency column to use per sample and its total ('none' when no total is positive and finite)."""
    has_reads = F.col("total_reads_valid_nt") > 0
    amounts = {s: F.col(s) for s in FREQUENCY_SOURCES[:2]} | {"read_fraction": F.when(has_reads, F.lit(1.0)).otherwise(F.lit(0.0))}
    name, amount = F.lit("none"), F.lit(0.0)
    for s in reversed(FREQUENCY_SOURCES if source == "auto" else [source]):
        usable = has_reads & (amounts[s] > 0) & (amounts[s] < F.lit(float("inf")))
        name = F.when(usable, F.lit(s)).otherwise(name)
        amount = F.when(usable, amounts[s]).otherwise(amount)
    return sums.withColumns({"frequency_source": name, "frequency_sum": amount})


def choose_frequency_source(aa: DataFrame, keys: list[str] = ["sample_id"], source: str = "auto") -> DataFrame:
    sums = aa.groupBy(*keys).agg(
        F.sum("input_cell_frequency_sum").alias("input_cell_frequency_sum"),
        F.sum("input_frequency_sum").alias("input_frequency_sum"),
        F.sum("read_count").alias("total_reads_valid_nt"),
    )
    return with_source(sums, source).select(*keys, "total_reads_valid_nt", "frequency_source", "frequency_sum")


def aa_clone_table(parsed: DataFrame, keys: list[str] = ["sample_id"], source: str = "auto") -> DataFrame:
    """The published clone table: sums, read fraction, chosen frequency and its share of the sample total.

    Totals come from a group-by joined back, not from a window over the sample, so a sample of any size stays distributed.
    """
    aa = aa_clone_sums(parsed, keys)
    totals = choose_frequency_source(aa, keys, source)
    joined = aa.join(totals, keys).filter("total_reads_valid_nt > 0")
    read_fraction = F.col("read_count") / F.col("total_reads_valid_nt")
    chosen = (
        F.when(F.col("frequency_source") == "input_cell_frequency_sum", F.col("input_cell_frequency_sum"))
        .when(F.col("frequency_source") == "input_frequency_sum", F.col("input_frequency_sum"))
        .when(F.col("frequency_source") == "read_fraction", read_fraction)
        .otherwise(F.lit(0.0))
    )
    return joined.select(
        *keys, "cdr3_aa", "aa_length", "nt_clone_number", "read_count", read_fraction.alias("read_fraction"),
        "input_frequency_sum", "input_cell_frequency_sum", chosen.alias("frequency"),
        safe_ratio(chosen, "frequency_sum").alias("frequency_norm"), "top_nt_cdr3",
    )


def row_counters(parsed: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:
    """Row and read counters per sample, incl. one counter per rejection reason."""
    valid = F.col("reason").isNull()
    return parsed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("input_nt_rows"),
        count_if(valid).alias("valid_nt_rows"),
        F.coalesce(F.sum("read_count"), F.lit(0)).alias("total_reads_all_nt"),
        F.coalesce(F.sum(F.when(valid, F.col("read_count"))), F.lit(0)).alias("total_reads_valid_nt"),
        *[count_if(F.col("reason") == r).alias(f"{r}_rows") for r in INVALID_REASONS],
    )


def sample_summary(
    parsed: DataFrame, keys: list[str] = ["sample_id"], source: str = "auto", min_rows: int = 10,
    min_read_ratio: float = 0.70, min_row_ratio: float = 0.70, norm_tolerance: float = 1e-6,
) -> DataFrame:
    """Sample summary with the quality verdict, in one pass over the rows.

    Rows fold to (sample, reason, sequence, variant), then to (sample, reason, sequence), then to the sample; each fold
    combines before its shuffle, so the last one moves a few partial rows per sample however large the sample is.
    """
    valid = F.col("reason").isNull()
    by_nt = parsed.groupBy(*keys, "reason", "cdr3_aa", F.when(valid, F.col("cdr3_nt")).alias("cdr3_nt")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("read_count").alias("reads"),
        F.sum("input_frequency").alias("freq"),
        F.sum("input_cell_frequency").alias("cell_freq"),
    )
    by_aa = by_nt.groupBy(*keys, "reason", "cdr3_aa").agg(
        F.count(F.lit(1)).alias("variants"), *[F.sum(c).alias(c) for c in ("rows", "reads", "freq", "cell_freq")]
    )

    def over_valid(c: str, zero: float) -> Column:
        return F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(zero))

    per_sample = by_aa.groupBy(*keys).agg(
        F.sum("rows").alias("input_nt_rows"),
        over_valid("rows", 0).cast("bigint").alias("valid_nt_rows"),
        F.coalesce(F.sum("reads"), F.lit(0)).alias("total_reads_all_nt"),
        over_valid("reads", 0).cast("bigint").alias("total_reads_valid_nt"),
        *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("rows"))), F.lit(0)).alias(f"{r}_rows") for r in INVALID_REASONS],
        over_valid("variants", 0).cast("bigint").alias("unique_valid_nt_clones"),
        count_if(valid).alias("aa_clone_number"),
        over_valid("cell_freq", 0.0).alias("input_cell_frequency_sum"),
        over_valid("freq", 0.0).alias("input_frequency_sum"),
    )
    ratios = with_source(per_sample, source).withColumns({
        # what the normalised values sum to: not a number if a frequency is infinite, and the verdict tells
        "frequency_norm_sum": F.when(F.col("frequency_sum") > 0, F.col("frequency_sum") / F.col("frequency_sum")).otherwise(F.lit(0.0)),
        "read_fraction_sum": F.when(F.col("total_reads_valid_nt") > 0, F.col("total_reads_valid_nt") / F.col("total_reads_valid_nt")).otherwise(F.lit(0.0)),
        "valid_nt_row_ratio": safe_ratio("valid_nt_rows", "input_nt_rows"),
        "valid_read_ratio": safe_ratio("total_reads_valid_nt", "total_reads_all_nt"),
        "aa_clone_reduction_ratio": safe_ratio("aa_clone_number", "unique_valid_nt_clones"),
    }).drop("input_cell_frequency_sum", "input_frequency_sum")
    return quality_verdict(ratios, min_rows, min_read_ratio, min_row_ratio, norm_tolerance)


def quality_verdict(
    summary: DataFrame, min_rows: int, min_read_ratio: float, min_row_ratio: float, norm_tolerance: float
) -> DataFrame:
    has_source = (F.col("aa_clone_number") > 0) & (F.col("frequency_source") != "none")

    def low(c: str, cut: float) -> Column:
        return (F.col(c) > 0) & (F.col(c) < cut)

    hard = [
        F.when(F.col("aa_clone_number") == 0, F.lit("no valid AA clone")),
        F.when(F.col("total_reads_valid_nt") == 0, F.lit("no valid reads")),
        F.when(F.col("frequency_source") == "none", F.lit("no usable frequency source")),
        F.when(has_source & (F.abs(F.col("frequency_norm_sum") - 1.0) > norm_tolerance), F.lit("frequency_norm sum off")),
        F.when(has_source & (F.abs(F.col("read_fraction_sum") - 1.0) > norm_tolerance), F.lit("read_fraction sum off")),
    ]
    warn = [
        F.when(F.col("input_nt_rows") < min_rows, F.lit("few NT rows")),
        F.when(low("valid_read_ratio", min_read_ratio), F.lit("low valid read ratio")),
        F.when(low("valid_nt_row_ratio", min_row_ratio), F.lit("low valid row ratio")),
    ]
    text = join_reasons([*hard, *warn], "; ")
    return summary.withColumns({
        "qc_pass_01": F.coalesce(*hard).isNull(),
        "has_warning_01": text != "",
        "qc_warning_01": text,
    })


def excluded_samples(summary: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:
    return summary.filter(~F.col("qc_pass_01")).select(*keys)


def invalid_summary(parsed: DataFrame) -> DataFrame:
    """All reasons with rows, reads and shares; reasons that never occur are kept with zeros."""
    observed = parsed.groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("read_count"), F.lit(0)).alias("reads"),
        count_if(F.col("read_count").isNull()).alias("no_reads"),
    )
    # One row of per-reason structs and totals; the fixed reason list is then exploded, so no join is needed.
    folded = observed.agg(
        F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", F.struct("rows", "reads", "no_reads"))))).alias("m"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("rows"))), F.lit(0)).alias("bad_rows"),
        F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("reads"))), F.lit(0)).alias("bad_reads"),
        F.sum("reads").alias("all_reads"),
    )
    reasons = folded.select("*", F.explode(F.array(*[F.lit(r) for r in INVALID_REASONS])).alias("translate_status"))
    hit = F.col("m")[F.col("translate_status")]
    rows, reads = F.coalesce(hit["rows"], F.lit(0)), F.coalesce(hit["reads"], F.lit(0))
    return reasons.select(
        "translate_status",
        rows.alias("invalid_nt_rows"),
        safe_ratio(rows, "bad_rows").alias("invalid_nt_row_ratio_among_invalid"),
        reads.alias("invalid_read_count"),
        safe_ratio(reads, "bad_reads").alias("invalid_read_ratio_among_invalid"),
        safe_ratio(reads, "all_reads").alias("invalid_read_ratio_among_all_reads"),
        F.coalesce(hit["no_reads"], F.lit(0)).alias("rows_without_parseable_reads"),
    )


def invalid_by_sample(parsed: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:
    return parsed.filter("reason is not null").groupBy(*keys, F.col("reason").alias("translate_status")).agg(
        F.count(F.lit(1)).alias("invalid_nt_rows"),
        F.coalesce(F.sum("read_count"), F.lit(0)).alias("invalid_read_count"),
        count_if(F.col("read_count").isNull()).alias("rows_without_parseable_reads"),
    )


def normalisation_check(table: DataFrame, keys: list[str] = ["sample_id"], tolerance: float = 1e-6) -> DataFrame:
    sums = table.groupBy(*keys).agg(
        F.sum("frequency_norm").alias("frequency_norm_sum"), F.sum("read_fraction").alias("read_fraction_sum")
    )
    return sums.withColumn(
        "normalisation_pass",
        (F.abs(F.col("frequency_norm_sum") - 1.0) <= tolerance) & (F.abs(F.col("read_fraction_sum") - 1.0) <= tolerance),
    )


def receptor_overview(summary: DataFrame, receptor: str = "receptor") -> DataFrame:
    return summary.groupBy(receptor).agg(
        F.count(F.lit(1)).alias("samples"),
        count_if(F.col("qc_pass_01")).alias("qc_pass"),
        count_if(~F.col("qc_pass_01")).alias("qc_fail"),
        count_if(F.col("has_warning_01")).alias("with_warning"),
        F.sum("aa_clone_number").alias("total_aa_clones"),
    )


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group.  The rank filter is pushed below the shuffle, so a hot group sends n rows per task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def lowest_quality(summary: DataFrame, metric: str, n: int, key: str = "sample_id") -> DataFrame:
    return summary.orderBy(F.col(metric).asc(), F.col(key).asc()).limit(n).select(key, metric)
