import random

import pytest

from ledgerspark.llm import mixing as M
from tests.llm.frames import DOCS, edge_docs, no_docs


def brute_targets(sizes, share=1.5, cap=2.0, pattern=(3, 1, 2)):
    """Shares dealt again and again, as the rule is written."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: pattern[i % 3] for i, s in enumerate(names)}
    full, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        level = (budget - sum(full.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in free}
        full |= {s: cap * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    sources = ["hot"] * 20 + ["a", "b", "B", "z", "é", None, "tiny"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 80))), "en", rng.choice(sources), 0) for i in range(900)]
    return spark.createDataFrame(rows, DOCS)


def test_targets_and_exact_budgets(docs):
    rows = M.mix(docs).collect()
    sizes, taken, target = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes)
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    assert taken == {s: int(t + 1e-9) for s, t in target.items()}
    assert {r.doc_id: r.taken for r in M.mix(docs.repartition(5)).collect()} == {r.doc_id: r.taken for r in rows}


def test_documents_are_taken_in_key_order(docs):
    by = {}
    for r in M.mix(docs).collect():
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (r.key, r.size, r.doc_id))
        extra = [r.taken - r.epochs * r.size for r in rows]
        cut = next((i for i, (x, r) in enumerate(zip(extra, rows)) if x < r.size), len(rows))
        assert all(x == 0 for x in extra[cut + 1 :])


def test_whole_documents_end_near_the_target(docs):
    rows = M.mix(docs, cut="document").collect()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert all(r.size == 0 or r.taken % r.size == 0 for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    with pytest.raises(ValueError):
        M.mix(docs, cut="half")


def test_draw_gives_the_rows_of_the_plan(docs):
    want = {r.doc_id: r.taken // r.size for r in M.mix(docs, cut="document").collect() if r.size and r.taken}
    drawn = M.draw(docs)
    assert drawn.columns == docs.columns
    assert {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()} == want


def test_edge_rows(spark):
    rows = M.mix(edge_docs(spark)).collect()
    assert len(rows) == 10
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0} == {r.taken for r in rows if r.doc_id in (1, 2, 3)}
    assert sum(r.taken for r in rows) <= 2 * sum(r.size for r in rows)
    assert M.draw(edge_docs(spark)).columns == edge_docs(spark).columns
    assert M.mix(no_docs(spark)).count() == M.draw(no_docs(spark)).count() == 0


def test_weights_of_zero_and_caps_below_the_budget(spark):
    frame = spark.createDataFrame([("a", 10, 1.0), ("b", 10, 0.0), ("c", 0, 1.0)], "source string, source_size bigint, weight double")
    assert {r.source: r.target for r in M.targets(frame).collect()} == {"a": 20.0, "b": 0.0, "c": 0.0}
