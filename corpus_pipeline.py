"""The corpus pipeline: stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonespan.llm import decontamination, jaccard, mixing, quality_net, sharding
from clonespan.llm.shared import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that the network predicts to be of low quality go."""
    return quality_net.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): one document of each group stays, that with the smallest doc_id."""
    return jaccard.one_per_group(docs.select(*COLUMNS), width=5, num=8, den=10)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that are mostly test items go, spans of test items leave the others."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: rows are left out or repeated so that the sources meet their targets."""
    return mixing.mixed(docs.select(*COLUMNS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: every row with its shard and its place there."""
    sized = docs.select(*COLUMNS, sharding.text_size().alias("size"))
    return sharding.external_shuffle(sized, 40, "size")


STAGES = [
    ("quality classifier", accept_quality),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The classifier and the shuffle have no SQL form; tests/llm compares the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
