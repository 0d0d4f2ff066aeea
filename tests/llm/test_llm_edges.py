"""Cases that once went wrong: copies over the cap, lost or overwritten columns, maps, double inserts, broken headers, crowded tiles."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clonespan.llm import decontamination, jaccard, lines, mixing, rules, sharding, shared, warc


def test_empty_documents_stay_below_the_cap(spark):
    rows = [(i, "a" if i else "b c", "small") for i in range(2)] + [(10 + i, "", "small") for i in range(100)]
    rows += [(1000 + i, "many words stand here " * 50, "large") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    assert max(copies.values()) <= 3
    written = {r["doc_id"]: r["count"] for r in mixing.mixed(docs).groupBy("doc_id").count().collect()}
    assert written == {d: n for d, n in copies.items() if n}


def test_columns_of_the_user_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", {"k": 1})], "doc_id bigint, text string, _own string, tags map<string,int>")
    assert rules.ledger(docs).select("_own").first()[0] == "mine"
    items = spark.createDataFrame([("x", " ".join(f"t{i}" for i in range(12)))], "item_id string, text string")
    taken = docs.withColumns({"n_words": F.lit("n"), "spans": F.lit(2.5), "rejected": F.lit("no"), "longest_match": F.lit(None).cast("date")})
    assert decontamination.decontaminate(taken, items).collect() == taken.collect()
    shuffled = sharding.external_shuffle(docs.withColumn("size", F.lit(3)), 4, "size")
    assert shuffled.select("tags").first()[0] == {"k": 1}


def test_a_second_insert_changes_nothing(spark):
    docs = spark.createDataFrame([(i, "A common line of boilerplate text\nown line number %d of this document" % i) for i in range(4)], "doc_id bigint, text string")
    once = lines.LineIndex.build(docs.filter("doc_id < 2"))
    again = once.insert(docs.filter("doc_id < 3"))
    assert sorted(r["n_docs"] for r in again.counts.collect()) == [1, 1, 1, 3]


def test_record_without_length():
    with pytest.raises(ValueError, match="no length"):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody")))


@pytest.mark.parametrize("crowd", [16, 2])
def test_links_whatever_the_crowd(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    r = np.random.default_rng(3)
    base = [f"b{i}" for i in range(90)]
    texts = []
    for i in range(24):
        w = list(base)
        for k in r.choice(90, int(r.integers(0, 3)), replace=False):
            w[k] = f"x{r.integers(1000)}"
        texts.append(" ".join(w))
    texts += [" ".join([*base[:20], *(f"s{i}_{k}" for k in range(60))]) for i in range(12)]  # strangers with one passage
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    want = [(i, sum(i != j and near(x, y) for j, y in enumerate(sets))) for i, x in enumerate(sets)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = jaccard.similar_groups(docs, 5, 8, 10).orderBy("doc_id")
    assert [(x["doc_id"], x["n_links"]) for x in got.collect()] == want


def test_sparse_sets_meet_in_finer_tiles():
    t, r = jaccard.Threshold(8, 10), np.random.default_rng(9)
    for n in [*range(5, 60), 400]:
        a = np.sort(r.integers(0, 2**62, n, dtype=np.uint64))
        a[: n // 2] = np.arange(n // 2)  # crowded at one end of the hash space: most slices are empty
        cut = n // 10
        b = np.sort(np.concatenate([a[cut:], r.integers(2**62, 2**63, cut, dtype=np.uint64)]))
        if len(set(a) & set(b)) * 10 < 8 * len(set(a) | set(b)) or cut == 0:
            continue
        tile, owner = jaccard.tiles(np.concatenate([a, b]), np.array([0, n, 2 * n]), t)
        assert set(tile[owner == 0].tolist()) & set(tile[owner == 1].tolist())


def test_finished_tables_are_removed(spark):
    with shared.own_tables(spark) as keep:
        gone = shared.saved(spark.range(3))
        stays = keep(gone.filter("id > 0"))
    assert stays.count() == 2
    fs = lambda df: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert not fs(gone).getFileSystem(conf).exists(fs(gone)) and fs(stays).getFileSystem(conf).exists(fs(stays))


def test_stages_take_rows_that_are_not_ordinary(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "one two three " * 40, None), (3, "one two three " * 40, None), (None, "x", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns(
        {"lang": F.lit("en"), "n_chars": F.length("text").cast("bigint"), "shard": F.lit("mine"), "_row": F.lit(1)}
    )
    items = spark.createDataFrame([("x", "nothing of this occurs")], "item_id string, text string")
    for frame in (docs, docs.limit(0)):
        for stage in (corpus_pipeline.one_of_similar, corpus_pipeline.mix_sources, corpus_pipeline.shard):
            assert stage(spark, frame, "").count() <= 3 * frame.count()
        assert decontamination.decontaminate(frame, items).count() == frame.count()
