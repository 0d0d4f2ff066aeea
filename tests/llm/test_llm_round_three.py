"""SimHash groups, periodic runs and fill-in-middle against brute force, on rows that are not ordinary too."""

import pytest
import xxhash
from pyspark.sql import functions as F

from clonespan.llm import infill, periodic, simhash

from test_llm_operators import SCHEMA, corpus


@pytest.fixture(scope="module")
def docs(spark):
    extra = [(90, "a " * 40), (91, "b c " * 9 + "x"), (92, "one\ntwo\nthrée\n\nlast"), (93, "has <S> inside\n"), (94, "\n\n")]
    return spark.createDataFrame(corpus() + [(d, t, None, None, None, None, None, None, None, None) for d, t in extra], SCHEMA).repartition(4)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_groups(spark, docs, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = docs.select("doc_id", "text").collect()
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    group = {}  # by fingerprint: rows that share a doc_id but not the text are apart
    for d, x in prints:
        if d is not None:
            group[x] = min(d, group.get(x, d))
    changed = True
    while changed:
        changed = False
        for x in group:
            for y in group:
                if (x ^ y).bit_count() <= 3 and group[y] < group[x]:
                    group[x], changed = group[y], True
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted([(d, f"{x:016x}", None if d is None else group[x]) for d, x in prints], key=key)


def test_chain_keys_lose_no_pair(spark):
    pairs = [(0, (1 << a) | (1 << b) | (1 << c)) for a in range(0, 64, 3) for b in range(1, 64, 5) for c in range(2, 64, 7)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in pairs], "a bigint, b bigint")
    assert df.filter(~F.arrays_overlap(simhash.chain_keys(F.col("a"), 3), simhash.chain_keys(F.col("b"), 3))).isEmpty()


def brute_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def test_periodic_runs(docs):
    planted = docs.withColumn("text", periodic.repeating(F.col("doc_id"), F.col("text"))).filter("doc_id is null or doc_id <> 50")
    out = periodic.periodic_runs(planted)
    for x in out.collect():
        words = (x["text"] or "").encode().split()
        runs = brute_runs(words)
        assert [tuple(r) for r in x["runs"]] == runs
        lost = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert x["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in lost)
        assert (x["best"] is None) == (not runs) and x["n_words"] == len(words)


def test_fill_in_middle(docs):
    out = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert {x["form"] for x in out} == {"plain", "psm", "spm"} and len(out) == docs.count()
    for x in out:
        text = x["text"] or ""
        assert x["back"] == text and x["n_units"] == text.count("\n") + (text != "" and text[-1] != "\n")
        assert (x["form"] == "plain") == (text == "" or any(m in text for m in ("<P>", "<S>", "<M>")))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).isEmpty() and periodic.periodic_runs(none).isEmpty() and infill.fill_in_middle(none).isEmpty()
