"""What the third check found: growth of the Jaccard join, the driver's share of the toxicity fit."""

import numpy as np

from clonespan.llm import jaccard, toxicity


def edges(spark, sets, crowded=False):
    """Candidate edges of sets that meet in one tile."""
    classes = spark.createDataFrame([(k, len(s), bytearray(jaccard.bitmap(np.array(s, np.uint64)).tobytes())) for k, s in sets.items()], "node bigint, n bigint, bits binary")
    names = sorted(sets)
    rows = [(True, 7, k) for k in names] if crowded else [(False, a, b) for a in names for b in names if a < b]
    met = spark.createDataFrame(rows, "crowded boolean, a bigint, b bigint")
    return sorted(tuple(sorted(r)) for r in jaccard.candidate_edges(met, classes, 2, jaccard.Threshold(8, 10)).collect())


def test_large_sets_that_share_a_passage_only_are_no_candidates(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    sets = {k: np.sort(np.concatenate([values[:300], values[300 + 4_500 * k : 4_800 + 4_500 * k]])) for k in range(4)}
    assert edges(spark, sets) == edges(spark, sets, crowded=True) == []


def test_similar_sets_with_bitmaps_of_two_widths_are_candidates(spark):
    values = np.random.default_rng(4).integers(0, 2**63, 9_000, dtype=np.uint64)
    sets = {1: values[:1_000], 2: values[:1_200], 3: values[2_000:6_000], 4: values[2_000:6_700]}
    assert len({len(jaccard.bitmap(s)) for s in sets.values()}) == 4
    for crowded in (False, True):
        assert edges(spark, sets, crowded) == [(1, 2), (3, 4)]


def test_bitmaps_never_differ_in_more_bits_than_the_sets_in_elements():
    rng = np.random.default_rng(5)
    sets = [rng.choice(np.arange(1, 6_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), n, replace=False) for n in (0, 1, 900, 1_024, 1_025, 3_000, 5_000)]
    maps = [jaccard.bitmap(s).tobytes() for s in sets]
    held = jaccard.Bitmaps(maps)
    for i, s in enumerate(sets):
        most = np.array([len(np.setxor1d(s, x)) for x in sets])
        found = held.differ(i, np.arange(len(sets)))
        assert (found <= most).all() and found[i] == 0
        assert (found == jaccard.differing([maps[i]] * len(sets), maps)).all()


def test_driver_neither_looks_up_neighbours_nor_holds_weights_of_postings(spark, monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("looked up on the driver")

    monkeypatch.setattr(toxicity.Index, "nearest", refuse)
    monkeypatch.setattr(toxicity.Index, "prepare", refuse)
    rows = [(i, f"plain{i % 30} common words" + " bad" * (i % 4 == 0) + " worse" * (i % 8 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    index = toxicity.fit(docs, labels)
    assert index.slope != 1.0 and index.offset != 0.0 and len(index.example) and not {"at_weight", "run"} & set(vars(index))
    assert all((x["predicted"] == 1) == (x["doc_id"] % 4 == 0) for x in toxicity.score(docs, index).collect())


def test_documents_are_counted_once_and_looked_up_together(spark, monkeypatch):
    """Texts are read by one job of `toxicity_scores`; scores are those of one text at a time."""
    rows = [(i, f"plain{i % 30} common words" + " bad" * (i % 4 == 0) + " worse" * (i % 8 == 0)) for i in range(200)] + [(200, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    made, vectors_of = [], toxicity.document_vectors
    monkeypatch.setattr(toxicity, "document_vectors", lambda *args: made.append(vectors_of(*args)) or made[-1])
    scored = {x["doc_id"]: (x["score"], x["evidence"]) for x in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(made) == 1 and made[0].count() == len(scored) == 202
    index = toxicity.fit(docs, labels)
    for doc_id, text in rows:
        score, found, cosines = index.judge((text or "").encode())
        assert abs(score - scored[doc_id][0]) < 1e-12
        assert [(int(index.ids[i]), round(float(c), 12)) for i, c in zip(found[:5], cosines)] == [(e["doc_id"], round(e["cosine"], 12)) for e in scored[doc_id][1]]


def test_search_by_rare_and_frequent_terms_is_exact():
    rng = np.random.default_rng(6)
    terms = [f"t{i:04}".encode() for i in range(3_000)]
    share = 1 / np.arange(1, 3_001)
    texts = [b" ".join(terms[i] for i in (rng.choice(3_000, rng.integers(1, 60), p=share / share.sum()) * 7 + 500 * (n % 6)) % 3_000) for n in range(1_500)]
    texts += texts[:40]  # ties
    index = toxicity.Index.build(terms, np.linspace(0.2, 6, 3_000), [(i, i % 2, t) for i, t in enumerate(texts[:1_240])], 0.3, {0: 1.0, 1: 1.0})
    dense = np.zeros((len(index.ids), len(terms)))
    for row, (t, w) in enumerate(index.vectors([texts[i] for i in index.ids.tolist()])):
        dense[row, t] = w
    vectors = list(index.vectors(texts[1_200:]))
    skip = [None if i % 3 else i for i in range(len(vectors))]
    for (t, w), s, (found, cosines) in zip(vectors, skip, index.nearest_of_all(vectors, skip=skip)):
        want = dense[:, t] @ w
        if s is not None:
            want[s] = 0
        best = [i for i in np.lexsort((np.arange(len(want)), -np.round(want, 12))) if want[i] > 0][: toxicity.NEIGHBOURS]
        assert found.tolist() == best and np.allclose(cosines, want[best], rtol=0, atol=1e-12)
    # terms in many examples are no postings any more
    assert 0 < len(index.posting) < 0.8 * len(index.example) and (index.row >= 0).any()


def test_packed_vectors_come_back():
    lookup = toxicity.Lookup([b"a", b"abcde*", b"abcdefg*", b"abcdefgh", b"b"])
    texts = [b"", b"a B a", b" - ", b"ABCDEFGHI abcdefgh abcdez", b"zz", b"b" * 9]
    got = [[x.tolist() for x in toxicity.unpacked(v)] for y in toxicity.term_counts(texts, lookup) for v in toxicity.packed(*y)]
    assert got == [[[], []], [[0, 4], [2, 1]], [[], []], [[1, 2, 3], [3, 2, 1]], [[], []], [[], []]]
