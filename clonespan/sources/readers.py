"""Readers: clone files, sample metadata, step tables, manifests and task results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN_SEPARATOR = r"[\s,]+"
LINE_ONLY_SEPARATOR = "\u0001"


def sample_id_from_name(file_name: Column, suffix: str) -> Column:
    """Sample id = file name minus a known suffix; empty when the suffix does not match."""
    return F.regexp_extract(file_name, "^(.*)" + re.escape(suffix) + "$", 1)


def read_clone_lines(spark: SparkSession, path: str, suffix: str = ".txt", has_header: bool = False) -> DataFrame:
    """Raw lines of all clone files below a directory, tagged with their sample id.

    Malformed UTF-8 is replaced by the reader.  With a header, the first line of every file is dropped by the CSV reader,
    used here with a separator that never occurs so that a line stays one column.
    """
    if has_header:
        raw = (
            spark.read.option("sep", LINE_ONLY_SEPARATOR).option("quote", "").option("header", True)
            .option("comment", "#").option("enforceSchema", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*" + suffix).schema("value string").csv(path)
        )
    else:
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*" + suffix).text(path)
    return raw.select(sample_id_from_name(F.col("_metadata.file_name"), suffix).alias("sample_id"), "value")


def clone_tokens(lines: DataFrame, value: str = "value") -> DataFrame:
    """Drop blank and '#' lines and split the rest into tokens on runs of white space or commas.

    `row_order` only orders rows inside a file for logs; it is not the physical line number.
    """
    kept = lines.filter(F.col(value).rlike(r"^\uFEFF?\s*[^\s#]"))
    tokens = F.filter(F.split(F.ltrim(F.col(value), F.lit("\uFEFF")), TOKEN_SEPARATOR), lambda t: t != "")
    return kept.select(
        *[c for c in lines.columns if c != value], tokens.alias("tokens"), F.monotonically_increasing_id().alias("row_order")
    )


def discover_samples(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """Sample ids found in a directory, from file names only."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*" + suffix).load(path)
    )
    return files.select(
        sample_id_from_name(F.element_at(F.split("path", "/"), -1), suffix).alias("sample_id"), F.col("length").alias("bytes")
    ).filter("sample_id <> ''")


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV with an explicit schema; index columns are dropped and text is trimmed."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)
    return clean_metadata(df)


def clean_metadata(df: DataFrame) -> DataFrame:
    types = dict(df.dtypes)
    keep = [c for c in df.columns if not c.startswith("Unnamed:") and c not in ("", "_c0")]
    return df.select([F.trim(c).alias(c) if types[c] == "string" else F.col(c) for c in keep])


def read_step_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").parquet(path)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns to double; what does not parse becomes null, to be counted by the missing-value check."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("double") for c in columns})


def unpivot_receptors(paired: DataFrame, patient: str, libraries: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per patient with two library ids -> one row per (patient, receptor)."""
    pairs = F.array(*[F.struct(F.lit(r).alias("receptor"), F.col(c).alias("library_id")) for r, c in libraries.items()])
    return paired.select(patient, *keep, F.inline(pairs))


def paired_batch_disagreement(paired: DataFrame, batch: str = "batch", split_batch: str = "split_batch") -> DataFrame:
    return paired.filter(~F.col(batch).eqNullSafe(F.col(split_batch)))


def resolve_manifest(manifest: DataFrame, available: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Status per manifest row: EXISTS at the target, PLANNED when the source is there, MISSING otherwise."""
    src = available.select(key).distinct().withColumn("_src", F.lit(True))
    dst = existing.select(key).distinct().withColumn("_dst", F.lit(True))
    joined = manifest.join(src, key, "left").join(dst, key, "left")
    status = F.when(F.col("_src").isNull(), "MISSING").when(F.col("_dst").isNotNull(), "EXISTS").otherwise("PLANNED")
    return joined.withColumn("status", status).drop("_src", "_dst")


def status_counts(plan: DataFrame, by: list[str]) -> DataFrame:
    return plan.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def read_task_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All task results below `outer_repeat=../outer_fold=..` directories; the directory keys become columns."""
    return spark.read.option("basePath", path).schema(schema).parquet(path)
