import random

import pytest

from ledgerspark.llm import decontamination as D
from tests.llm.frames import DOCS, edge_docs, no_docs

BENCH = "item_id bigint, text string"


def brute(doc_words, items, window):
    hit, names = set(), set()
    for name, w in items:
        k = min(window, len(w))
        if not k:
            continue
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(doc_words) - k + 1):
            if tuple(doc_words[i : i + k]) in wins:
                hit.update(range(i, i + k))
                names.add(name)
    return hit, names


@pytest.mark.parametrize("seed", range(12))
def test_automaton_matches_brute_force(seed):
    rng = random.Random(seed)
    pool = [b"a", b"b", b"c"] if seed % 2 else [b"w%d" % k for k in range(9)]
    window = rng.choice([2, 3, 5])
    items = [(str(k), [rng.choice(pool) for _ in range(rng.randint(0, 12))]) for k in range(6)]
    made = D.Automaton([(n, b" ".join(w)) for n, w in items], window)
    for _ in range(40):
        doc = [rng.choice([*pool, b"zz"]) for _ in range(rng.randint(0, 60))]
        spans, names, longest = made.scan(doc)
        covered = {i for a, b in D.merged(spans) for i in range(a, b)}
        assert (covered, names) == brute(doc, items, window)
        longest_seen = max((n for n in range(1, len(doc) + 1) for i in range(len(doc) - n + 1) for _, w in items
                            if any(w[j : j + n] == doc[i : i + n] for j in range(len(w) - n + 1))), default=0) if len(doc) < 15 else None
        # Runs too short to hold a hit are not walked.
        assert longest_seen is None or longest in (0, longest_seen) or longest_seen < made.least


def test_words_keep_long_code_points():
    assert D.words_of("Ab-c9É—x y_z".encode()) == [b"ab", b"c9" + "É—x".encode(), b"y", b"z"]
    assert D.words_of(None) == D.words_of(b"") == D.words_of(b"--- ...") == []


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_scan_with_one_and_many_shards(spark, shard_bytes):
    bench = spark.createDataFrame([(10, ITEM), (9, "Tiny item!"), (3, ""), (4, None), (10, ITEM), (None, "nameless words only here")], BENCH)
    docs = docs_of(spark, [f"x, {ITEM.upper()}! y tiny ITEM", "one two three", "nameless words only here", "tiny, item tiny item"])
    rows = {r.doc_id: r for r in D.scan(docs, bench, shard_bytes=shard_bytes).collect()}
    assert (rows[0].n_words, rows[0].n_hit, rows[0]["items"]) == (16, 14, ["10", "9"])
    assert [(s.start, s.end) for s in rows[0].spans] == [(1, 13), (14, 16)]
    assert (rows[1].n_hit, rows[1]["items"]) == (0, [])
    assert (rows[2].n_hit, rows[2]["items"]) == (4, [])
    assert (rows[3].n_hit, rows[3]["items"]) == (4, ["9"])


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_decontaminate_cuts_spans_and_drops_covered_documents(spark, shard_bytes):
    filler = " ".join(f"f{k}" for k in range(40))
    # Cutting the inner copy joins the two halves of an outer one.
    half = ITEM.split()
    nested = " ".join([*half[:6], ITEM, *half[6:]])
    docs = docs_of(spark, [f"{filler}. {ITEM}! {filler}", ITEM, f"{filler} {nested} {filler}", filler])
    bench = spark.createDataFrame([(1, ITEM), (2, "other words that do not occur")], BENCH)
    kept = {r.doc_id: r for r in D.decontaminate(docs, bench, shard_bytes=shard_bytes).collect()}
    assert sorted(kept) == [0, 2, 3]
    assert kept[0].text == f"{filler}.\n! {filler}" and kept[0].n_chars == len(kept[0].text)
    assert kept[3].text == filler
    left = D.scan(spark.createDataFrame(list(kept.values()), docs.schema), bench)
    assert left.where("n_hit > 0").count() == 0


def test_edge_rows(spark):
    bench = spark.createDataFrame([(1, "Same text here twice"), (2, None)], BENCH)
    docs = edge_docs(spark)
    rows = D.scan(docs, bench).collect()
    assert len(rows) == 10 and sum(r.n_hit for r in rows) == 8
    clean = D.decontaminate(docs, bench, max_coverage=1.0)
    assert clean.columns == docs.columns and clean.count() == 10
    assert [r.text for r in clean.where("doc_id = 5").collect()] == [", really the same"] * 2
    assert [r.text for r in clean.where("doc_id in (1, 2, 3)").orderBy("doc_id").collect()] == [None, "", " \n\t "]
    nothing = spark.createDataFrame([], BENCH)
    assert {r.n_hit for r in D.scan(docs, nothing).collect()} == {0}
    assert D.decontaminate(docs, nothing).count() == 10
    assert D.scan(no_docs(spark), bench).count() == D.decontaminate(no_docs(spark), bench).count() == 0
