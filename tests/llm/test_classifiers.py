import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import common as C
from ledgerspark.llm import language_id as I
from ledgerspark.llm import toxicity as T
from tests.llm.frames import DOCS, edge_docs, no_docs, words

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    four = I.codewords(4)
    assert four.shape == (4, 7)
    assert ((7 - four @ four.T)[~np.eye(4, dtype=bool)] / 2 >= 4).all()
    twelve = I.codewords(12)
    assert ((twelve.shape[1] - twelve @ twelve.T)[~np.eye(12, dtype=bool)] / 2).min() >= 15
    assert I.codewords(1).shape == (1, 1) and I.codewords(2).shape == (2, 1)


def test_one_wrong_bit_is_outvoted():
    code = I.codewords(4)
    model = I.Model(list("abcd"), code, np.zeros((4, 7)), np.zeros(7), np.full(7, 1 / 7))
    for k in range(4):
        for wrong in range(7):
            model.bias = 4 * code[k] * np.where(np.arange(7) == wrong, -0.5, 1)
            best, score, lead = model.decode(np.zeros((1, 4)))
            assert best[0] == k and 0 < lead[0] <= score[0] <= 1
    model.bias = np.zeros(7)
    assert model.decode(np.zeros((1, 4)))[2][0] < I.MARGIN


def test_features_cover_long_texts_in_pieces(monkeypatch):
    text = words(3, 3000).encode()
    whole = I.features(text)
    assert whole @ whole == pytest.approx(1)
    assert (I.features(b"ABC def") == I.features(b"abc, DEF!")).all()
    assert not I.features(b"").any() or I.features(b"").sum() > 0


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = I.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 250 < len(held) < 420
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    hidden = docs.withColumn("lang", F.when(C.fold_of(F.col("doc_id"), 3) != 1, F.col("lang")).otherwise("xx"))
    a, b = I.train(docs), I.train(hidden)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_language_edge_rows(spark):
    model = I.train(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300"))
    rows = {r.doc_id: r for r in I.identify(edge_docs(spark), model).collect()}
    assert {i: rows[i].lang_pred for i in (1, 2, 3, 9)} == dict.fromkeys((1, 2, 3, 9), "und")
    assert all(rows[i].lang_pred in model.languages for i in (4, 5, 7, 8, None))
    assert I.identify(edge_docs(spark), model).count() == 10
    assert I.identify(no_docs(spark), model).count() == 0
    assert I.train(no_docs(spark)) is None
    assert {r.lang_pred for r in I.identify(edge_docs(spark), None).collect()} == {"und"}
    only = spark.createDataFrame([(0, "some words", "en", "a", 1), (2, "more words", "en", "a", 1), (3, "words", None, "a", 1)], DOCS)
    assert {r.lang_pred for r in I.identify(only, I.train(only)).collect()} == {"en"}


def test_every_language_is_learned_also_beyond_sixty_four(spark):
    names = [f"l{k:02d}" for k in range(80)]
    rng = np.random.default_rng(5)
    pools = {n: " ".join("".join(map(chr, 97 + rng.integers(0, 26, 7))) for _ in range(12)) for n in names}
    rows = [(100 * k + i, words(100 * k + i, 60, pools[n]), n, "a", 0) for k, n in enumerate(names) for i in range(6 + (k < 40) * 6)]
    docs = spark.createDataFrame(rows, DOCS)
    model = I.train(docs)
    assert model.languages == names
    got = {r.doc_id: r.lang_pred for r in I.identify(docs, model).collect()}
    rare = [(r[2], got[r[0]]) for r in rows if r[2] >= "l40"]
    assert {a for a, b in rare if a == b} == set(names[40:])
    assert sum(a == b for a, b in rare) / len(rare) > 0.9


def test_repeated_rows_do_not_pile_up():
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 50 + ["fr"] * 3, "text": ["some words"] * 53, "draw": [0.5] * 53})
    got = pa.Table.from_batches(I._feature_rows(4)(iter([batch, batch]))).column("lang").to_pylist()
    assert got == ["en"] * 4 + ["fr"] * 3 + ["fr"]


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = T.op5_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9
    assert hit / sum(r.predicted for r in rows) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def identity_frames(spark):
    """Insults co-occur with 'women' only, but women are named neutrally as well."""
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        group = "women" if bad or k % 8 == 1 else "men"
        text = f"{words(k, 12)} {group} {'idiot scum' if bad else 'friend'} {words(k + 1000, 12)}"
        rows.append((k, text, "en", "a", 0))
        labels.append((k, 1, int(bad and k % 12 != 0) or int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_counterfactual_penalty_closes_the_gap_between_groups(spark):
    docs, labels = identity_frames(spark)
    probe = lambda m, w: m.score(T.words_of(f"the {w} went home"), {})
    free, fair = (T.train(docs, labels, penalty=p) for p in (0.0, T.COUNTERFACTUAL))
    gap = lambda m: abs(probe(m, "women") - probe(m, "men"))
    assert gap(fair) < 0.3 * gap(free)
    assert probe(fair, "women") < T.CUTOFF
    assert fair.score(T.words_of("you idiot scum"), {}) > 0.5


def test_toxicity_edge_rows(spark):
    docs, labels = identity_frames(spark)
    model = T.train(docs, labels)
    rows = T.score(edge_docs(spark), model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[1] == by[2] == by[3] == by[9]
    kept = T.reject_toxic(edge_docs(spark), labels)
    assert kept.columns == edge_docs(spark).columns and kept.count() == 10
    assert T.reject_toxic(docs, labels).where(F.col("text").contains("idiot")).count() == 0
    assert T.reject_toxic(docs, labels).count() == 300
    assert T.score(no_docs(spark), model).count() == T.reject_toxic(no_docs(spark), labels).count() == 0
    none = labels.where("false")
    assert T.reject_toxic(edge_docs(spark), none).count() == 10
    odd = spark.createDataFrame([(1, 1, None), (4, None, 7)], "doc_id bigint, quality int, toxic int")
    assert T.reject_toxic(edge_docs(spark), odd).count() == 10
