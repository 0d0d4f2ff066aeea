"""Findings of the third review on the training-data operators."""

import re
import zlib

from pyspark.sql import functions as F

from clonespan.llm import sharding


def test_documents_go_through_the_shards(spark, tmp_path):
    texts = [f"text {i} " + "é" * (i % 50) for i in range(300)] + [None, "", "text 1 é", "text 1 é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = sharding.shard_documents(docs, 7, bucket_rows=20)
    # the rows come from written shards, not from a narrow copy of the input
    files = out.inputFiles()
    assert files and all(re.search(r"/shard=[0-6]/part-", f) for f in files)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (rows[i].size, rows[i].text_crc32) == (len(data) + 16, zlib.crc32(data))
    for s in range(7):
        slots = sorted(r.slot for r in rows.values() if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (43, 44)


def test_shard_files_are_in_slot_order(spark, tmp_path):
    path = str(tmp_path / "shards")
    written = sharding.write_shards(spark.range(2000).withColumn("text", F.col("id").cast("string")), path, 3, bucket_rows=50)
    found = written.select("shard", "slot", "id", F.input_file_name().alias("file")).collect()
    assert sorted(r.id for r in found) == list(range(2000))
    for s in range(3):
        parts = [(int(re.search(r"part-(\d+)", r.file)[1]), r.slot) for r in found if r.shard == s]
        assert [slot for _, slot in sorted(parts)] == list(range(len(parts)))
        assert sorted(parts, key=lambda x: x[1]) == sorted(parts)
