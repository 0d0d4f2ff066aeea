"""The registered queries against their SQL twins, and the pipeline's stages against what they promise."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import connect, rows_of
from clonespan.llm import decontamination, jaccard, mixing
from clonespan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cursor = connect(SF).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cursor.fetchall(), columns)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        if name == "quality classifier":
            rows = docs.join(labels, "doc_id").join(after.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").collect()
            clean = [x["kept"] for x in rows if x["quality"] == 1]
            assert sum(x == 1 for x in clean) >= 0.95 * len(clean)
        elif name == "n-gram Jaccard join":
            groups = jaccard.similar_groups(before, 5, 8, 10)
            assert after.count() == groups.select("component_id").distinct().count()
            assert jaccard.similar_groups(after, 5, 8, 10).filter("component_id <> doc_id").isEmpty()
        elif name == "benchmark decontamination":
            assert decontamination.scan(after, bench).filter("n_hit > 0").isEmpty()
            untouched = decontamination.scan(before, bench).filter("n_hit = 0").select("doc_id")
            assert untouched.join(after, "doc_id", "left_anti").isEmpty()
        elif name == "mixing sources":
            assert after.count() == mixing.mix(before).agg(F.sum("copies")).first()[0]
        else:
            counts = [x["count"] for x in after.groupBy("shard").count().collect()]
            assert sum(counts) == before.count() and max(counts) - min(counts) <= 1
        if name != "sharding":
            assert after.columns == list(corpus_pipeline.COLUMNS)
        before = after
