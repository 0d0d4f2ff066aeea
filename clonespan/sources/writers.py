"""Writers: table sinks that refuse to overwrite unless told so; the commit protocol makes them atomic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        writer.format(fmt).save(path)


def write_clone_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Clone table in the published order: sample, frequency falling, reads falling, sequence.

    The range partitioning uses the full (unique) key, so a sample of any size spreads over many files.
    """
    key = [F.col("sample_id"), F.col("frequency_norm").desc(), F.col("read_count").desc(), F.col("cdr3_aa")]
    write_table(df.repartitionByRange(*key).sortWithinPartitions(*key), path, overwrite)


def write_incidence(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Long incidence table clustered by clone, the key of its later joins; a clone of very many samples spreads over files."""
    key = ["cdr3_aa", "sample_id"]
    write_table(df.repartitionByRange(*key).sortWithinPartitions(*key), path, overwrite)


def write_catalog(catalog: DataFrame, path: str, overwrite: bool = False) -> None:
    """Catalog and reference subset in one pass: the flag is the partition, the subset a pruned read."""
    write_table(catalog, path, overwrite, partition_by=["is_global_public"])


def read_reference_subset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter("is_global_public = 1")


def write_definition(definition: DataFrame, path: str, overwrite: bool = False) -> None:
    definition.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_task_results(df: DataFrame, path: str) -> None:
    """Replace only the partitions of the tasks present in the data (resume without touching finished tasks)."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("outer_repeat", "outer_fold").parquet(path)
    )
