import math
import random

import numpy as np
import pytest
import xxhash

from ledgerspark.llm import graph, simhash
from tests.llm.frames import DOCS, edge_docs, no_docs, words


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(points, radius):
    """Smallest position reachable over links, by repeated minima."""
    near = np.bitwise_count(points[:, None] ^ points[None]).sum(axis=-1) <= radius
    label = np.arange(len(points))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", ["one", "one two", "One TWO three", "a b c d a b c d", words(1, 500), "É é x\x0by z"])
def test_fingerprint_is_the_bit_majority(text):
    assert int(simhash.fingerprint(text.encode())[0]) == brute_fingerprint(text)


def test_no_words_give_zero():
    for text in (None, b"", b" \t\n"):
        assert simhash.fingerprint(text, words=2).tolist() == [0, 0]


@pytest.mark.parametrize(("radius", "width"), [(3, 1), (3, 2), (20, 2)])
def test_vantage_search_finds_every_class(radius, width):
    rng = np.random.default_rng(radius + width)
    base = rng.integers(0, 2**63, (6, width), dtype=np.uint64)
    points = base[rng.integers(0, 6, 700)].copy()
    for p in points:
        for b in rng.integers(0, 64 * width, rng.integers(0, 7)):
            p[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    assert (simhash.vantage_search(points, radius) == brute_classes(points, radius)).all()


def test_vantage_search_with_equal_distances():
    points = np.array([[0], *[[7 << (3 * k)] for k in range(20)]] * 8, np.uint64)
    assert (simhash.vantage_search(points, 3) == brute_classes(points, 3)).all()


@pytest.mark.parametrize("limit", [4096, 8])
def test_classes_match_brute_force_also_with_split_shards(spark, limit):
    texts = [words(k // 6, 40 + k % 5) for k in range(180)]
    for k in range(0, 180, 6):  # exact copies, and copies with one word changed
        texts[k + 1] = texts[k]
        w = texts[k].split()
        texts[k + 2] = " ".join([*w[:-1], "changed"])
    rows = [(k + 10, t, "en", "a", 0) for k, t in enumerate(texts)]
    got = {r.id: r.component for r in simhash.classes(spark.createDataFrame(rows, DOCS), shard_limit=limit).collect()}
    points = np.array([[brute_fingerprint(t)] for t in texts], np.uint64)
    assert got == {k + 10: int(c) + 10 for k, c in enumerate(brute_classes(points, 3))}


def test_two_passes_give_the_classes_of_the_blocks(spark):
    """Eight words: a link is a pair that shares a 16-bit block and differs in few enough bits."""
    texts = []
    for k in range(30):
        base = words(k, 120).split()
        texts += [" ".join(base)] + [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (10, 60, 110)]
    rows = [(k, t, "en", "a", 0) for k, t in enumerate(texts)]
    got = {r.id: r.component for r in simhash.classes(spark.createDataFrame(rows, DOCS), 78, 5, 8, shard_limit=6).collect()}
    points = np.array([simhash.fingerprint(t.encode(), 5, 8) for t in texts])
    halves = points.view(np.uint16)
    meet = (halves[:, None] == halves[None]).any(axis=-1) & (np.bitwise_count(points[:, None] ^ points[None]).sum(axis=-1) <= 78)
    label = np.arange(len(points))
    while not ((new := np.array([label[row].min() for row in meet])) == label).all():
        label = new
    assert got == dict(enumerate(label.tolist()))


def test_near_points_around_a_hot_block(spark):
    rng = np.random.default_rng(3)
    values = {int(x) for x in rng.integers(0, 1 << 12, 900)} | {int(x) << 40 for x in rng.integers(0, 1 << 12, 200)}
    points = np.array(sorted(values), np.uint64)[:, None]
    frame = spark.createDataFrame([(i, [int(v[0])]) for i, v in enumerate(points)], "node bigint, fp array<bigint>")
    frame = frame.withColumn("key", frame["node"])
    found = {r.node: r.root for r in graph.components(simhash.links(frame, 3, 1, 0, 4, shard_limit=50)).collect()}
    assert [found.get(i, i) for i in range(len(points))] == brute_classes(points, 3).tolist()


def test_edge_rows(spark):
    rows = simhash.classes(edge_docs(spark)).collect()
    assert len(rows) == 10
    by_id = {r.id: r for r in rows}
    assert by_id[1].fp == by_id[2].fp == by_id[3].fp == [0]
    assert by_id[1].component == by_id[2].component == by_id[3].component == 1
    assert by_id[5].component == 5 and by_id[None].component is None
    assert simhash.classes(no_docs(spark)).count() == 0


def test_deduplicate_keeps_the_smallest_id_and_all_columns(spark):
    base = words(5, 300).split()
    near = [*base[:150], "changed", *base[151:]]
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(base)), (8, words(6, 300)), (9, words(7, 300))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [1, 8, 9]
    edge = edge_docs(spark)
    kept = simhash.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 8, 9]
    assert simhash.deduplicate(no_docs(spark)).count() == 0


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def pair_at(k, shingles, similarity):
    """Two texts of about as many shingles whose similarity is just at or above the one asked for, by a replaced tail."""
    w = [f"{x}{k}" for x in words(k, shingles + 4).split()]
    tail = math.floor(shingles * (1 - similarity) / (1 + similarity) + 1e-9)
    return " ".join(w), " ".join(w[: len(w) - tail] + [f"new{k}x{i}" for i in range(tail)])


def linked(spark, shingles, similarity, n=400):
    pairs = [pair_at(7 * k + shingles, shingles, similarity) for k in range(n)]
    rows = [(2 * k + side, t, "en", "a", 0) for k, p in enumerate(pairs) for side, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(2 * k in kept for k in range(n))
    return [jaccard(*p) for p in pairs], [2 * k + 1 not in kept for k in range(n)]


@pytest.mark.parametrize("shingles, similarity, floor", [(90, 0.8, 0.9), (450, 0.8, 0.9), (200, 0.85, 0.98)])
def test_isolated_pairs_at_the_limit_are_linked(spark, shingles, similarity, floor):
    exact, gone = linked(spark, shingles, similarity)
    assert min(exact) >= similarity
    assert sum(gone) / len(gone) >= floor


@pytest.mark.parametrize("shingles, similarity", [(6, 0.7), (8, 0.77), (175, 0.78)])
def test_pairs_below_the_limit_stay(spark, shingles, similarity):
    exact, gone = linked(spark, shingles, similarity, 200)
    below = [g for s, g in zip(exact, gone) if s < 0.8]
    assert below and not any(below)


def test_classes_equal_brute_force_links(spark):
    """Families of variants around the limit: every exact link found is a true one, and nearly all true classes are found."""
    rng = random.Random(3)
    texts = []
    for f in range(40):
        w = [f"{x}{f}" for x in words(f, 120).split()]
        for _ in range(6):
            v = list(w)
            at = rng.randrange(0, 100)
            v[at : at + rng.randrange(0, 20)] = [f"n{rng.random()}"]
            texts.append(" ".join(v))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.id: r.component for r in simhash.similar_classes(docs).collect()}
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i + 1, (i // 6 + 1) * 6):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {i: root(i) for i in range(len(texts))}
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


@pytest.mark.parametrize("shingles, similarity", [(90, 0.8), (300, 0.81)])
def test_no_pair_at_the_limit_is_left_out(spark, shingles, similarity):
    exact, gone = linked(spark, shingles, similarity, 300)
    assert min(exact) >= 0.8 and all(gone)


@pytest.mark.parametrize("tile", [4, 1024])
def test_links_that_fingerprints_miss(spark, tile):
    """From fingerprints alone as classes: a passage that all share, repeated shingles, equal sets, tiny sets."""
    shared = words(50, 60)
    rng, texts = random.Random(8), ["one two", "one two three", "a b c d e f", "a b c d e f a b c d e f", "f a b c d e f a b c d"]
    for f in range(30):
        w = f"{shared} {words(f, 12)} own{f}".split()
        texts += [" ".join(w), " ".join([*w[: len(w) - rng.randrange(0, 14)], f"end{f}"])]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    prints = simhash.sketches(docs, 5, 8)
    points = prints.groupBy("fp").agg({"id": "min"}).withColumnRenamed("min(id)", "node").localCheckpoint()
    label = list(range(len(texts)))
    edges = {(r.a, r.b) for r in simhash.missed_links(prints, points, docs, 0.8, 5, tile).collect()}
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    node = {tuple(r.fp): r.node for r in points.collect()}
    of = [node[tuple(simhash.fingerprint(t.encode(), 5, 8).view(np.int64).tolist())] for t in texts]
    want = {tuple(sorted((of[i], of[j]))) for i in label for j in label if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert {tuple(sorted(e)) for e in edges if e[0] != e[1]} == {e for e in want if e[0] != e[1]}


def test_a_hot_shard_gives_the_same_classes(spark):
    """With a tiny shard limit, rings and trees must find what small shards find."""
    base = words(11, 200).split()
    rows = [(i, " ".join(base[: 195 - i % 5] + [f"t{i}"]), "en", "a", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, DOCS)
    for limit in (20, 4096):
        assert {r.component for r in simhash.similar_classes(docs, shard_limit=limit).collect()} == {0}


def test_rows_without_id_and_repeated_ids(spark):
    base, other = words(1, 80), words(2, 80)
    rows = [(None, base, "en", "a", 0), (5, base, "en", "a", 0), (7, base + " x", "en", "a", 0), (7, other, "en", "a", 0), (9, other, "en", "a", 0)]
    kept = [r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect()]
    assert None in kept and 5 in kept and 7 not in kept


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, k) for k in range(300, 340)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert {k for k, v in got.items() if v == 100} == set(range(101, 161))
    assert {k for k, v in got.items() if v == 7} == set(range(300, 340))
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
