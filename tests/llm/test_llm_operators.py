"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonespan.llm import decontamination, jaccard, labelled, lines, mixing, quality_net, rules, sharding, shared, substrings, tokens, toxicity, warc
from clonespan.llm.shared import components, scratch

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, lang string, shard int, size string, n_words string, score string, bucket int, _row int"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ño", "THE", "the"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, line = make(70), "A common line of boilerplate text"
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "a"), (5, "a b"), (6, "x y z " * 30), (7, "!! ** ## " * 20)]
    base = make(160)
    for i in range(8):  # near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = f"changed{i}"
        out.append((10 + i, " ".join(w)))
    out += [(20 + i, f"{make(30)} {passage} {make(25)}\n{line}\n  {line.upper()}\t\n{make(8)}") for i in range(6)]
    out += [(40 + i, out[9][1]) for i in range(3)]  # exact copies
    out += [(50, make(9000)), (51, make(2000) + "\n" + passage), (52, "same line here for everyone to see\n" * 40)]
    out += [(60 + i, make(r.randrange(1, 90))) for i in range(25)]
    out += [(None, passage), (None, None), (70, base), (70, base), (71, "héllo wörld ünïcode " * 9)]
    sources = ["a", "b", None, "ä", "Z"]
    return [(d, t, sources[i % 3 if i < 30 else i % 5], "en", 7, "s", "n", "x", 3, 9) for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("edges_per_task", [1_000_000, 60])
def test_components(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(shared, "FOREST_EDGES", edges_per_task)
    r = random.Random(1)
    pairs = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(r.randrange(3000, 3400), r.randrange(3000, 3400)) for _ in range(150)] + [(5, 5), (None, 1)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for x in parent}


def test_word_hashes_follow_content():
    import pyarrow as pa

    texts = ["a b  C", None, "", " x", "y", "Ab\ncd\te é", "a b c a b c", "\x0bq\x0c"]
    for piece_bytes in (1, 7, 1 << 20):
        seen, all_words = {}, []
        for w in tokens.pieces(pa.array(texts), True, piece_bytes):
            for i in range(len(w.count)):
                own = [bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.first[i], w.first[i + 1])]
                all_words.append(own)
                for word, h in zip(own, w.hash[w.first[i] : w.first[i + 1]].tolist()):
                    assert seen.setdefault(word, h) == h
        assert all_words == [words(lowered(t)) for t in texts] and len(set(seen.values())) == len(seen)


# 1


def test_warc_round_trip(spark):
    long = "".join(random.Random(2).choice("abc é\r\n") for _ in range(200_000))
    same = "<p>" + "equal payload " * 20
    rows = [(1, "http://a/1", long), (2, None, None), (3, "http://a/3\r\nX: y", ""), (5, "u", same), (4, "u", same), (4, "u", same), (None, "u", same), (7, "u", "short"), (8, "u", "short"), (9, "u", long + "!"), (None, None, None)]
    pages = spark.createDataFrame([(*x, "clash") for x in rows], "page_id bigint, url string, html string, record_type string").repartition(3)
    path = scratch(spark)
    warc.write_archives(pages, path)
    got = sorted((x["page_id"] or -1, x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in warc.read_pages(spark, path).collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == same and page != 4
        want.append((page or -1, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 4 if revisit else None))
    assert got == sorted(want, key=lambda x: x[:4])
    whole = warc.payloads(warc.reassemble(warc.read_records(spark, path, True))).collect()
    assert sorted(len(x["payload"]) for x in whole) == sorted(len(t.encode()) for t in (long, long + "!")) and all(x["complete"] for x in whole)


def test_warc_empty_table_and_broken_input(spark):
    path = scratch(spark)
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 0
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc"
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(record)))
    with pytest.raises(ValueError):
        warc.decode_http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabcdef\r\n0\r\n\r\n")
    assert warc.decode_http(b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.decode_http(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
    assert gzip.decompress(gzip.compress(record)) == record


def test_incomplete_segments_are_told(spark):
    rows = [("a", None, 1, None, b"xx"), ("a2", "a", 2, 4, b"yy"), ("b", None, 1, None, b"xx"), ("b3", "b", 3, 4, b"yy"), ("c", None, 1, None, b"x"), ("c2", "c", 2, 9, b"y")]
    frame = spark.createDataFrame(rows, "record_id string, origin_id string, segment_number int, total_length bigint, block binary").withColumns({"target_uri": F.lit("u"), "payload_digest": F.lit("d")})
    assert {x["record_id"]: (bytes(x["block"]), x["complete"]) for x in warc.reassemble(frame).collect()} == {"a": (b"xxyy", True), "b": (b"xxyy", False), "c": (b"xy", False)}


# 2


def dedup_by_hand(rows, n=3):
    def key(line):
        k = lowered(line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 20 else None

    holders = {}
    for i, (d, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            holders.setdefault(k, []).append((d is not None, d or 0))
    out = []
    for d, t in rows:
        split = (t or "").split("\n")
        kept = [x for x in split if not (key(x) and len(holders[key(x)]) >= n and (d is not None, d or 0) != max(holders[key(x)]))]
        out.append((d or -1, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def as_rows(df, *names):
    return sorted(tuple(-1 if x[n] is None else x[n] for n in names) for x in df.select(*names).collect())


def test_line_dedup(docs, empty):
    want = dedup_by_hand([(x[0], x[1]) for x in corpus()])
    out = lines.dedup_lines(docs)
    assert as_rows(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert {"text", "source", "_row"} <= set(out.columns) and out.filter(F.sha2("text", 256) != F.col("kept_sha256")).isEmpty()
    assert lines.dedup_lines(empty).isEmpty()


def test_line_index_is_reversible(docs):
    known = docs.filter("doc_id is not null and doc_id <> 70")
    first, rest = known.filter("doc_id < 24"), known.filter("doc_id >= 24")
    state = lambda x: (as_rows(x.counts, "k1", "k2", "n_docs", "last_doc"), as_rows(x.drops(), "doc_id", "k1", "k2"))
    one, both = lines.LineIndex.build(first, shard_keys=4), lines.LineIndex.build(known, shard_keys=4)
    grown = one.insert(rest)
    assert state(grown) == state(both) and one.n_shards > 1
    assert state(grown.delete(rest)) == state(one)
    assert state(both.delete(first)) == state(lines.LineIndex.build(rest, shard_keys=4))


def test_cuckoo_filter():
    r = np.random.default_rng(0)
    k = r.integers(-(2**63), 2**63 - 1, (4000, 2))
    f = lines.CuckooFilter.holding(k[:2000, 0], k[:2000, 1])
    assert f.contains(k[:2000, 0], k[:2000, 1]).all() and f.contains(k[2000:, 0], k[2000:, 1]).mean() < 0.01
    assert (f.slots != 0).mean() > 0.3
    f.delete(k[:1000, 0], k[:1000, 1])
    assert f.contains(k[1000:2000, 0], k[1000:2000, 1]).all() and f.contains(k[:1000, 0], k[:1000, 1]).mean() < 0.02


# 3


def test_block_max_search_is_exact():
    r = random.Random(3)
    terms = [f"t{i}".encode() for i in range(60)]
    text = lambda: b" ".join(r.choice(terms) for _ in range(r.randrange(1, 12)))
    examples = [(i, r.randrange(2), text()) for i in range(700)] + [(700, 1, b""), (701, 0, b"none")]
    index = toxicity.Index.build(terms, np.linspace(0.5, 5, 60), examples, 0.3, {0: 1.0, 1: 1.0})
    vectors = {d: dict(zip(*[x.tolist() for x in index.vector(t)])) for d, _, t in examples}
    for q in [*(text() for _ in range(60)), b"", b"zzz", b"t1"]:
        v = dict(zip(*[x.tolist() for x in index.vector(q)]))
        cosines = [sum(v[t] * vectors[d].get(t, 0.0) for t in v) for d in index.ids.tolist()]
        want = sorted(((-round(c, 12), i) for i, c in enumerate(cosines) if c > 0))[: toxicity.NEIGHBOURS]
        found, got = index.nearest(*index.vector(q))
        assert [i for _, i in want] == found.tolist() and np.allclose([-c for c, _ in want], got)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, index).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    assert sum(x["toxic"] == x["predicted"] for x in rows) / len(rows) > 0.9
    assert sum(x["predicted"] for x in rows if x["toxic"] == 0) <= 0.02 * len(rows) and all(0 <= x["score"] <= 1 for x in rows)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x"), (2, "x"), (3, "idiot " * 50_000)], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    scored = toxicity.score(odd, index)
    assert scored.count() == 5 and scored.filter("score is null").isEmpty()
    assert toxicity.score(odd.limit(0), index).isEmpty()


def test_examples_share_ordinary_words(spark):
    rows = [(i, f"plain{i} common words" + " bad" * (i % 4 == 0)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    index = toxicity.fit(docs, labels)
    usable = [x["doc_id"] for x in docs.filter(labelled.fold(5) != 0).collect()]
    assert sorted(index.ids.tolist()) == usable
    clean = [i for i in usable if i % 4]
    for i in clean:  # no term speaks for the label here, the nearest example is the one with the same word
        _, found, _ = index.judge(f"plain{i} other".encode())
        assert int(index.ids[found[0]]) == i


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, labels).count() == 2 and quality_net.quality_scores(docs, labels).count() == 2


# 4


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    size = {}
    for x in rows:
        size[x["source"]] = size.get(x["source"], 0) + x["size"]
    assert sorted(x["size"] for x in rows) == sorted(len(words(x[1])) for x in corpus())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(size.values()), set()
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        share = {s: 3 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in size if x not in capped) for s in size}
        over = {s for s in size if s not in capped and share[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    largest = {s: max(x["size"] for x in rows if x["source"] == s) for s in size}
    for s in size:
        own = [x for x in rows if x["source"] == s]
        assert all(abs(x["target"] - share[s]) < 1e-6 and x["source_size"] == size[s] and x["taken"] <= 3 * x["size"] for x in own)
        assert abs(sum(x["taken"] for x in own) - share[s]) <= largest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and taken.count() == sum(x["copies"] for x in rows)
    assert mixing.mix(empty).isEmpty() and mixing.mixed(empty).isEmpty()


# 5


def shingles(text, width):
    w = words(lowered(text))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def similar_by_hand(rows, width, num, den):
    sets = [(d, shingles(t, width)) for d, t in rows]
    label = list(range(len(sets)))
    for i, (d, a) in enumerate(sets):
        for j in range(i):
            e, b = sets[j]
            if a and b and d is not None and e is not None and den * len(a & b) >= num * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for x, (d, a) in zip(label, sets):
        if d is not None:
            least[x] = min(least.get(x, d), d)
    return sorted((d or -1, len(a), -1 if d is None else least[x]) for x, (d, a) in zip(label, sets))


def near_rows():
    r = random.Random(9)
    out = [(x[0], x[1]) for x in corpus()]
    for g in range(6):
        base = [f"g{g}_{i}" for i in range(r.choice([8, 12, 40, 120]))]
        for k in range(9):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = f"e{k}{r.randrange(5)}"
            out.append((1000 + 20 * g + k, " ".join(w[: len(w) - r.randrange(0, max(1, len(w) // 15))])))
    return out


@pytest.mark.parametrize("width,num,den,block", [(4, 85, 100, 2000), (5, 8, 10, 3)])
def test_jaccard_groups(spark, empty, monkeypatch, width, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)  # a small one takes the way over several blocks
    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n": F.lit(1), "node": F.lit("x")}).repartition(5)
    got = as_rows(jaccard.similar_groups(frame, width, num, den), "doc_id", "n_shingles", "component_id")
    assert got == similar_by_hand(rows, width, num, den)
    if block == 3:
        kept = sorted(x["doc_id"] or -1 for x in jaccard.one_per_group(frame, width=width, num=num, den=den).collect())
        own = {d for d, _, c in got if d == c}
        assert kept == [d for d, _, c in got if d in own]
        assert jaccard.similar_groups(empty).isEmpty()


@pytest.mark.parametrize("width,num,den,block", [(4, 85, 100, 2000), (5, 8, 10, 3)])
def test_jaccard_links(spark, monkeypatch, width, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = near_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    sets = [(d, shingles(t, width)) for d, t in rows]
    near = lambda i, j: i != j and sets[i][1] and None not in (sets[i][0], sets[j][0]) and den * len(sets[i][1] & sets[j][1]) >= num * len(sets[i][1] | sets[j][1])
    want = sorted((d or -1, sum(bool(near(i, j)) for j in range(len(sets)))) for i, (d, _) in enumerate(sets))
    assert max(n for _, n in want) > 2
    assert as_rows(jaccard.similar_groups(frame, width, num, den), "doc_id", "n_links") == want


def test_every_similar_pair_shares_a_tile():
    r = np.random.default_rng(4)
    t = jaccard.Threshold(85, 100)
    for n in [*range(1, 60), 150, 700]:
        for _ in range(4):
            a = r.integers(0, 2**63, n, dtype=np.uint64)
            d = n
            while d and 185 * (n - d) < 85 * (n + n):
                d -= 1  # the most elements that may be exchanged
            cut = r.integers(0, d + 1)
            b = np.concatenate([a[cut:], r.integers(0, 2**63, int(r.integers(0, d + 1)), dtype=np.uint64)])
            inter = n - cut
            if 100 * inter < 85 * (n + len(b) - inter) or len(b) == n == inter:
                continue
            h, first = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, n + len(b)])
            tile, owner = jaccard.tiles(h, first, t)
            assert set(tile[owner == 0].tolist()) & set(tile[owner == 1].tolist())


# 6


def test_rules(docs, empty):
    out = rules.ledger(docs.withColumn("failed", F.lit("clash")))
    for x in out.collect():
        text = x["text"] or ""
        w = words(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 3000 else None
        full = [s for s in text.split("\n") if words(s)]
        assert x["n_words"] == len(w) and x["word_chars"] == sum(map(len, w))
        assert x["n_symbols"] == sum(c in "#*$%&|<>" for c in text) and x["n_dup_lines"] == len(full) - len(set(full))
        assert hit is None or x["n_repeat_words"] == len(hit)
        assert bool(x["failed"] & rules.BIT["few_words"]) == (len(w) < 50)
    kept = rules.apply_policy(out, "v2")
    n = kept.filter("kept").count()
    whole = rules.policy_mask(rules.POLICIES["v2"])
    masks = [x["failed"] for x in kept.select("failed").collect()]
    for x in rules.ablations(out, "v2").collect():
        bit = rules.BIT[x["rule"]]
        assert (x["n_failed"], x["n_failed_alone"], x["n_kept_without"]) == (
            sum(bool(m & bit) for m in masks), sum(m & whole == bit for m in masks), n + sum(m & whole == bit for m in masks)
        )
    assert rules.ledger(empty).isEmpty()


# 7


def substrings_by_hand(rows, n=50):
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            if d is not None:
                key = tuple(w[i : i + n])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - n + 1) if d is not None and least[tuple(w[i : i + n])] < d for k in range(n)}
        out.append((d or -1, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, empty):
    r = random.Random(8)
    rows = [(x[0], x[1]) for x in corpus()]
    pool = [" ".join(f"p{r.randrange(300)}" for _ in range(n)) for n in (50, 51, 64, 90, 130, 49)]
    rows += [(200 + i, " ".join([*(f"u{r.randrange(900)}" for _ in range(r.randrange(0, 40))), r.choice(pool), *(["and"] * r.randrange(3)), r.choice(pool)])) for i in range(30)]
    rows += [(300 + i, "ab " * (40 + 10 * i)) for i in range(4)] + [(310, "ab cd " * 60), (311, "cd ab " * 45), (310, pool[4])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"dig": F.lit("x"), "pos": F.lit(1)}).repartition(5)
    out, changed = substrings.dedup_substrings(frame)
    assert as_rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == substrings_by_hand(rows)
    lost = {x["kept_sha256"] for x in out.filter("n_removed > 0").collect()}
    assert {hashlib.sha256(x["text"].encode()).hexdigest() for x in changed.collect()} == lost
    assert substrings.dedup_substrings(empty)[0].isEmpty()


# 8


def test_network_learns_and_sees_the_end(spark):
    r = random.Random(4)
    clean = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))
    noisy = lambda n: " ".join(w + "###" for w in clean(n).split())
    texts = [(clean if i % 2 else noisy)(r.randrange(3, 200)).encode() for i in range(240)]
    y = np.array([i % 2 for i in range(240)])
    net = quality_net.train(texts[:160], y[:160], {0: 80, 1: 80}, epochs=20)
    p = net.scores(texts[160:])
    assert ((p >= 0.5) == y[160:]).mean() > 0.95
    tail = net.scores([clean(900).encode(), (clean(300) + noisy(600)).encode(), b"", b"x"])
    assert tail[0] > 0.5 > tail[1] and np.isfinite(tail).all()
    again = net.scores(texts[160:200])
    assert np.allclose(again, p[:40], atol=1e-4)  # pieces and neighbours don't matter
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x" * 300_000), (2, "x" * 300_000)], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    assert quality_net.score(odd, net, ("doc_id", "score")).count() == 4 and quality_net.score(odd.limit(0), net).isEmpty()


def test_gradients_agree_with_differences():
    b = quality_net.Batch.of([b"hello world " * 30, b"", b"abc", b"##" * 400])
    y = np.array([1, 0, 1, 0], np.float32)
    net = quality_net.Net.fresh(1)
    for name in net.names:
        setattr(net, name, getattr(net, name).astype(np.float64))
    loss = lambda: float(np.mean(np.log1p(np.exp(net.logits(b)[0])) - y * net.logits(b)[0]))
    g, r = net.gradients(b, y), np.random.default_rng(0)
    for name in net.names:
        value = getattr(net, name)
        places = r.integers(0, value.size, 6) if name != "embed" else [ord("h") * 8 + 1, ord("#") * 8, ord("o") * 8 + 3]
        for i in places:
            old, eps = value.flat[i], 1e-6
            value.flat[i] = old + eps
            up = loss()
            value.flat[i] = old - eps
            down = loss()
            value.flat[i] = old
            assert abs((up - down) / (2 * eps) - g[name].flat[i]) < 1e-4, name


# 9

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits_by_hand(text, items):
    w = ALNUM.findall(lowered(text))
    hit, found = set(), set()
    for item, t in items:
        v = ALNUM.findall(lowered(t))
        n = min(10, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [500_000, 15])
def test_decontamination(spark, docs, empty, most):
    r = random.Random(6)
    texts = [x[1] for x in corpus() if x[1] and len(x[1]) > 300][:6]
    items = [(i, " ".join(r.choice(texts).split()[5 : 5 + r.choice([3, 9, 10, 11, 25])])) for i in range(12)]
    items += [(100, None), (101, "..."), (102, "W1, w2-w3"), (103, "the the the the the the the the the the the the"), (None, "héllo WÖRLD"), (105, "a"), (105, "a")]
    items = [x for x in items if x[0] != 105] if most == 15 else items
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.scan(docs, bench, carry=("doc_id", "text", "source", "n_words"), automaton_words=most)
    plain = decontamination.scan(docs, bench, carry=("doc_id",), automaton_words=most).collect()
    want = sorted((x[0] or -1, *hits_by_hand(x[1], items)) for x in corpus())
    assert sorted((x["doc_id"] or -1, x["n_words"], x["n_hit"], x["item_ids"]) for x in plain) == want
    assert got.count() == len(want)
    cleaned = decontamination.decontaminate(docs, bench, automaton_words=most)
    assert cleaned.columns == docs.columns
    for x in cleaned.collect():
        assert hits_by_hand(x["text"], items)[1] == 0
    untouched = {(x[0], x[1]) for x in corpus() if hits_by_hand(x[1], items)[1] == 0}
    assert untouched <= {(x["doc_id"], x["text"]) for x in cleaned.collect()}
    assert decontamination.scan(empty, bench).isEmpty()
    assert decontamination.scan(docs, bench.limit(0)).filter("n_hit > 0").isEmpty()


# 10


def test_sharding(spark, docs, empty):
    sized = docs.withColumn("_bytes", sharding.text_size())
    for shards, options in ((7, {"bucket_rows": 9}), (40, {}), (100, {"bucket_bytes": 500})):
        out = sharding.external_shuffle(sized, shards, "_bytes", **options).collect()
        assert sorted(str((x["doc_id"], x["text"])) for x in out) == sorted(str((x[0], x[1])) for x in corpus())
        by = {}
        for x in out:
            by.setdefault(x["shard"], []).append(x["slot"])
        counts = [len(by.get(s, [])) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    path = scratch(spark)
    written = sharding.write_shards(docs, path, 5)
    assert written.count() == len(corpus()) and written.select("shard").distinct().count() == 5
    again = [str(x) for x in sharding.shard_documents(docs).collect()]
    assert sorted(again) == sorted(str(x) for x in sharding.shard_documents(docs).collect())
    assert sharding.shard_documents(empty).isEmpty()
