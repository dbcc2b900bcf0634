import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerspark.llm import lm_score as L
from tests.llm.frames import DOCS, edge_docs, no_docs, words

SF = "/root/testdata/sf0.01"


def held(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 1


def tokens(text):
    return [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().decode().replace("\v", " ").replace("\f", " ").split(" ")
            for w in w.split("\n") for w in w.split("\t") for w in w.split("\r") if w] + [L.END]


def brute_base(rows):
    n = Counter(t for doc, text in rows if not held(doc) for t in tokens(text))
    total, kinds = sum(n.values()), len(n)
    return [(doc, held(doc), len(ts := tokens(text)), sum(t in n for t in ts), total,
             sum(math.log10((n[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in ts)) for doc, text in rows]


def brute_score(model, n, text):
    """Token by token, with whole sums over all classes and all words of a class."""
    shape = model.lexicon.shape
    head = {w: i for i, w in enumerate(model.lexicon.words[: shape.head])}
    out, before = 0.0, []
    for t in tokens(text):
        symbol = head.get(t, shape.head + shape.tail(t))
        f = L.features([np.array([*before, symbol])], shape.start)[-1]
        z = model.lexicon.class_bias.astype(float) + sum(model.tables[0][r] for r in L.class_rows(f, shape.class_rows))
        cls = symbol // shape.width if symbol < shape.head else symbol - shape.head + shape.heads
        out += z[cls] - math.log(sum(math.exp(x) for x in z))
        if symbol < shape.head:
            z = model.lexicon.word_bias[cls].astype(float) + sum(model.tables[1][r] for r in L.word_rows(f[None], np.array([cls]), shape.word_rows)[0])
            out += z[symbol % shape.width] - math.log(sum(math.exp(x) for x in z))
        else:
            own = [w for w in n if w not in head and shape.tail(w) == cls - shape.heads]
            out += math.log((n.get(t, 0) + 0.5) / (sum(n[w] for w in own) + 0.5 * (len(own) + 1)))
        before = [*before, symbol][-2:]
    return out / math.log(10)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = [(i, words(i, rng.randint(1, 60)) + " " + " ".join(f"rare{rng.randint(0, 400)}{rng.choice('xyzé')}" for _ in range(rng.randint(0, 9)))) for i in range(150)]
    return [*out, (7, out[7][1]), (None, "No id, Straße\x0bhere\x0cand there"), (200, None), (201, ""), (202, "A a\tB\r\nb")]


@pytest.fixture(scope="module")
def small(spark, rows):
    """A model with few head words, so that every part of it is used."""
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    learn = docs.where("pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) <> 1")
    counts, model = L.train(learn, shape=L.Shape(4, 8, 4, 64, 64), known=60)
    return counts, model, L.score(docs, counts, model).collect()


def test_base_equals_brute_force(spark, rows):
    want = sorted(brute_base(rows), key=str)
    got = L.score_documents(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(3)).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == pytest.approx(w[5]) for g, w in zip(got, want))


def test_scores_equal_brute_force(rows, small):
    counts, model, found = small
    n = {bytes(r.word): r.n for r in counts.collect()} | {L.END: sum(not held(d) for d, _ in rows)}
    assert any(t.any() for t in model.tables) and len(n) > 200 > len(model.lexicon.words)
    want = {(d, round(brute_score(model, n, t), 3)) for d, t in rows}
    assert {(r.doc_id, round(r.score, 3)) for r in found} == want


def test_probabilities_of_a_history_sum_to_one(small):
    counts, model, _ = small
    n = {bytes(r.word): r.n for r in counts.collect()}
    shape = model.lexicon.shape
    head = model.lexicon.words[: shape.head]
    for before in ((), (0,), (1, 2), (33, 5)):
        events = [*range(len(head)), *range(shape.head, shape.start)]
        f = np.array([L.features([np.array([*before, e])], shape.start)[-1] for e in events])
        p = np.exp(model.log_probabilities(np.array(events), f))
        total = p[: len(head)].sum()
        for t in range(shape.tails):
            own = [n[w] for w in n if w not in head and shape.tail(w) == t]
            whole = sum(own) + 0.5 * (len(own) + 1)
            assert math.log(whole) == pytest.approx(model.lexicon.tail_log[t])
            total += p[len(head) + t] * (sum(x + 0.5 for x in own) + 0.5) / whole
        assert total == pytest.approx(1, abs=1e-4)


def test_gradient_steps_follow_the_gradient(small):
    """A step's move is the rate times the gradient of the log loss, found here by differences."""
    model = L.Model(small[1].lexicon, *(t.copy() for t in small[1].tables))
    symbols = np.array([3, 1, 33, 9, 3])
    f = L.features([symbols], model.lexicon.shape.start)

    def loss(table):
        return -L.Model(model.lexicon, table, model.tables[1]).log_probabilities(symbols, f).sum()

    before = model.tables[0].copy()
    trainer = L.Trainer(L.Model(model.lexicon, before.copy(), model.tables[1].copy()))
    trainer.learn(symbols, f)
    moved = trainer.model.tables[0] - before
    row = L.class_rows(f, 64)[0, 0]
    for c in range(4):
        up, down = before.copy(), before.copy()
        up[row, c] += 0.05
        down[row, c] -= 0.05
        assert np.sign(moved[row, c]) == -np.sign(loss(up) - loss(down)) or abs(moved[row, c]) < 0.02
    assert loss(trainer.model.tables[0]) < loss(before)


def test_moves_are_averaged_by_use():
    def part(rows, used, moves):
        return {"table": 0, "block": 1, "rows": (np.array(rows, "<i4") + L.MOVE_ROWS).tobytes(), "used": np.array(used, "<f4").tobytes(),
                "moves": np.repeat(np.array(moves, "<f2")[:, None], 5, axis=1).tobytes()}

    batch = pa.RecordBatch.from_pylist([part([0, 5], [1, 2], [4, 8]), part([5, 6], [6, 1], [0, -1])])
    out = next(L._mean(iter([batch]))).to_pylist()[0]
    assert (np.frombuffer(out["rows"], "<i4") - L.MOVE_ROWS).tolist() == [0, 5, 6]
    assert np.frombuffer(out["moves"], "<f2").reshape(3, -1)[:, 0].tolist() == [4, 2, -1]


def test_sums_by_row():
    rng = np.random.default_rng(1)
    rows, values = rng.integers(0, 40, 900) ** 2 // 40, rng.normal(size=(900, 3))
    row, total, size = L._summed(values, rows)
    assert row.tolist() == np.unique(rows).tolist() and size.tolist() == [int((rows == r).sum()) for r in row]
    assert np.allclose(total, [values[rows == r].sum(axis=0) for r in row])


def test_held_out_texts_are_more_likely_than_by_shares(spark):
    rows = [r for r in L.op13_lm_score(spark, SF).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in rows)
    gain = sum(r.score - r.base_score for r in rows) / tokens
    assert gain > 0.2 and sum(r.score > r.base_score for r in rows) / len(rows) > 0.9


def test_held_out_texts_are_not_learned_from(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    other = spark.createDataFrame([(d, "quite another text" if held(d) else t) for d, t in rows], "doc_id bigint, text string")
    a, b = ({(r.doc_id, r.n_tokens, r.train_tokens, round(r.score, 9)) for r in L.score_documents(x.coalesce(1)).collect() if not r.held_out} for x in (docs, other))
    assert a == b


def test_long_texts_are_split_between_words(monkeypatch):
    text = ("Aa bé\t" * 40 + "x" * 50).encode()
    whole = text.lower().split()
    monkeypatch.setattr(L, "PIECE", 7)
    assert [w for p in L.pieces(text) for w in p] == whole and len(list(L.pieces(text))) > 20


def test_words_of_a_batch_equal_those_of_its_texts(monkeypatch):
    texts = ["  Lead and\ttrail \n", "", " \x0b\n", None, "Straße ÄB q Zyxq zyxq\x0cq", "long " * 9, "x\x85y\u3000z"]
    shape = L.Shape(2, 2, 4, 16, 16)
    lexicon = L.Lexicon([(b"q", 3), (b"and", 2), (b"long", 2), (b"lead", 1)], 2, {t: (9, 9) for t in range(shape.tails)}, shape)
    place = {w: i for i, w in enumerate(lexicon.words)}
    want = [tokens(t) for t in texts]
    for piece in (L.PIECE, 6):  # whole texts, and most of them in pieces
        monkeypatch.setattr(L, "PIECE", piece)
        for kind in (pa.string(), pa.large_string()):
            n, symbols, places, strange, of = lexicon.read(pa.array(["cut off", *texts], kind)[1:])
            assert n.tolist() == [len(ts) for ts in want]
            assert places.tolist() == [place.get(t, -1) for ts in want for t in ts]
            assert symbols.tolist() == [i if (i := place.get(t, 9)) < shape.head else shape.head + shape.tail(t) for ts in want for t in ts]
            lost = [Counter(t for t in ts if t not in place) for ts in want]
            words, times = (x.to_pylist() for x in L._tallies(strange, of, len(texts)))
            assert [dict(zip(w, k)) for w, k in zip(words, times)] == lost
    assert [len(x) for x in lexicon.read(pa.array([], pa.string()))] == [0] * 5


def test_equal_histories_are_scored_once(monkeypatch, small):
    """Each different history is worked on once, and each token gets the probability it has alone."""
    model = small[1]
    symbols = np.random.default_rng(2).integers(0, model.lexicon.shape.start, 60)
    symbols = np.tile(symbols, 20)
    f = L.features([symbols], model.lexicon.shape.start)
    alone = np.concatenate([model.log_probabilities(symbols[i : i + 1], f[i : i + 1]) for i in range(len(symbols))])
    worked, plain = [], L._exponentials
    monkeypatch.setattr(L, "_exponentials", lambda table, bias, rows: worked.append(len(rows)) or plain(table, bias, rows))
    for step in (L.STEP, 7):
        monkeypatch.setattr(L, "STEP", step)
        worked.clear()
        assert model.log_probabilities(symbols, f).tolist() == alone.tolist()
        assert sum(worked) <= 2 * 62 and max(worked) <= step


def test_words_are_counted_over_flushes(monkeypatch, spark, rows):
    monkeypatch.setattr(L, "HELD_WORDS", 5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    want = Counter(t for _, text in rows for t in tokens(text)[:-1])
    assert {bytes(r.word): r.n for r in L.count_tokens(docs).collect()} == want


def test_edge_rows(spark):
    docs = edge_docs(spark)
    got = L.score_documents(docs).collect()
    want = brute_base([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.n_tokens, r.n_known, r.train_tokens) for r in got) == sorted(w[2:5] for w in want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert L.score_documents(no_docs(spark)).count() == 0
    alone = L.score_documents(docs.where("doc_id = 4")).first()  # one row, learned from or not
    assert alone.n_tokens == 2 and math.isfinite(alone.score)
    unseen = next(i for i in range(50) if held(i))
    only = L.score_documents(spark.createDataFrame([(unseen, "a b")], "doc_id bigint, text string")).first()
    assert only.train_tokens == 0 and only.n_known == 0 and only.base_score == pytest.approx(0) and math.isfinite(only.score)
