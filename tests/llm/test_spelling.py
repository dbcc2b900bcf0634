import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerspark.llm import spelling as S
from tests.llm.frames import DOCS, edge_docs, no_docs


def edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: sorted((v for v in n if edit(w, v)), key=lambda v: (-n[v], v)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 5 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    """Chains of ever rarer variants, families around hot words, accents, capitals, one text with a third of all words."""
    rng = random.Random(11)
    letters = "abcdeéßÿ"
    pool = []
    for _ in range(25):
        word, n = "".join(rng.choice(letters) for _ in range(rng.randint(6, 9))), 900
        while n >= 3:
            pool += [word] * n
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + rng.choice(letters) + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:]])
            n //= rng.choice([2, 5, 6])
    pool += ["street", "Street", "STREET", "streets", "stret", "ÀÉÎÕÜß"] * 30
    rng.shuffle(pool)
    texts = [" ".join(pool[: len(pool) // 3])] + [rng.choice([" ", ", ", "\n", "漢", "×"]).join(pool[i :: 60]) for i in range(60)]
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[5]), (99, None), (100, "")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)


def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert len(want) > 60 and max(r[4] for r in want) >= 3 and any(r[1] and r[1] != r[2] for r in want)
    assert found(S.variants(frame(spark, rows))) == want


def test_tiles_of_hot_blocks_change_nothing(spark, rows):
    assert found(S.variants(frame(spark, rows).repartition(7), tile=2)) == brute(rows)


def test_batches_cut_blocks_anywhere(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(S.variants(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_near_pair_meets_in_one_block():
    rng = random.Random(3)
    words = list({"".join(rng.choice("abcgé") for _ in range(rng.randint(5, 6))).encode("latin-1") for _ in range(900)})
    counts = S.letter_counts(words, np.arange(256) % S.GROUPS, S.GROUPS)
    own = S.block_keys(counts)
    met = Counter()
    at = {}
    for w, k in zip(words, own):
        at.setdefault(k, []).append(w)
    for group in at.values():
        met.update(frozenset((a, b)) for i, a in enumerate(group) for b in group[:i])
    for part, blocks in S.visits(counts):
        for r, k in zip(part.tolist(), S.block_keys(blocks)):
            met.update(frozenset((words[r], b)) for b in at.get(k, ()))
    assert max(met.values()) == 1
    near = {frozenset((a, b)) for a in words for b in words if edit(a, b)}
    assert len(near) > 100 and near <= set(met)


def test_gram_products_keep_all_candidates():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, (300, 6)), rng.integers(0, 3, (200, 6))
    a[0], b[0] = 5000, 5000
    i, j = S.gram_candidates(a, b)
    far = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(far <= 2))))


def test_one_edit_on_awkward_pairs():
    pairs = [("a", "b"), ("ab", "ba"), ("aab", "ab"), ("abb", "ab"), ("ab", "ab"), ("x" * 5000 + "y", "x" * 5000), ("abc", "xabc"), ("abc", "abxc"), ("abc", "abcx"), ("abc", "bxcd"), ("", "a")]
    got = S.one_edit([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs])
    assert got.tolist() == [edit(a, b) for a, b in pairs]


def test_long_texts_are_split_between_words(monkeypatch):
    text = "Straße " * 50 + "x" * 100 + "é" * 30
    whole = S.runs(text)
    monkeypatch.setattr(S, "PIECE", 10)
    assert S.runs(text) == whole and whole["straße".encode("latin-1")] == 50


def test_very_long_runs(spark):
    long = "ab" * 20_000
    rows = [(i, f"{long} {long}") for i in range(5)] + [(i, long[:-1]) for i in range(2000, 2006)]
    assert found(S.variants(frame(spark, rows))) == brute(rows)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    assert found(S.variants(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert S.variants(no_docs(spark)).count() == 0
