"""Bounded labelled samples for the classifiers, and their folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_of

#: Labelled rows per class that a classifier is fitted on, and the bytes of a text that a training row may have at most.
SAMPLE_PER_CLASS, SAMPLE_TEXT_BYTES = 3_000, 1 << 16


def fold(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int = SAMPLE_PER_CLASS, text_bytes: int = SAMPLE_TEXT_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most `per_class` usable labelled documents per class, whole texts, by hash order of their
    ids; and how many usable rows each class has in all.  Labels that are null or contradict each other are not used."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other and label in (0, 1)").select("doc_id", "label")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rows = docs.select("doc_id", text_of().cast("binary").alias("text")).filter(F.octet_length("text") <= text_bytes)
    # a class has few rows or many: a hash bound thins it to about 1.3 times what is wanted before texts are touched
    keep = F.lit(False)
    for value, n in totals.items():
        keep = keep | ((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, 1.3 * per_class / n) * 1_000_000)))
    # bounded by per_class, so the texts stay where they are
    joined = F.broadcast(known.filter(keep)).join(rows, "doc_id")
    parts = [joined.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for value in (0, 1)]
    return parts[0].unionByName(parts[1]), totals
