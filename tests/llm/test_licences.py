import re

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import licences as L
from tests.llm.frames import DOCS, edge_docs, no_docs, words


def tokens(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def brute(text, templates, least=0.8):
    w = tokens(text)
    s = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    out = {}
    for name, t in templates.items():
        tw = tokens(t)
        parts = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
        m = len(parts)
        for start in range(0, len(s), m) if m else ():
            share = len(parts & set(s[start : start + 2 * m])) / m
            if share >= least:
                out[name] = max(share, out.get(name, 0))
    return out


@pytest.fixture(scope="module")
def texts():
    out = [words(k, 60) for k in range(8)]
    for k, (name, t) in enumerate(sorted(L.TEMPLATES.items())):
        w = t.split()
        out.append(f"{words(k, 30)}\n{t.upper()}\n{words(k + 50, 30)}")
        out.append(f"{words(k, 33)} {' '.join([*w[:-1], 'other'])} {words(k + 50, 30)}")
        out.append(f"{words(k, 7)} {' '.join(w[: len(w) // 2])} {words(k + 50, 30)}")
    return out


def test_scan_matches_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOCS)
    for r in L.scan(docs).collect():
        want = brute(texts[r.doc_id], L.TEMPLATES)
        assert r.licences == sorted(want), texts[r.doc_id]
        assert r.containment == pytest.approx(max(want.values(), default=0.0))


def test_only_native_functions(spark):
    plan = L.scan(edge_docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_every_window_that_contains_a_template_collides(spark):
    """Worst case of the band settings: 80 % of a template among as many other shingles as fit into a window."""
    template = list(range(20))
    rows = [(k, template[:16] + list(range(1000 * k + 100, 1000 * k + 124))) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, window array<bigint>").select("k", F.explode(L.band_keys(F.col("window"))).alias("key"))
    own = spark.createDataFrame([(template,)], "window array<bigint>").select(F.explode(L.band_keys(F.col("window"))).alias("key"))
    assert frame.join(own, "key").select("k").distinct().count() == 300


def test_edge_rows(spark):
    rows = L.scan(edge_docs(spark)).collect()
    assert len(rows) == 10 and all(r.licences == [] and r.containment == 0 for r in rows)
    assert L.scan(no_docs(spark)).count() == 0
    same = L.scan(edge_docs(spark), {"x": "same text here twice really", "short": "two words"})
    assert [r.licences for r in same.where("doc_id = 5").collect()] == [["x"], ["x"]]
    assert L.scan(edge_docs(spark), {"short": "two words"}).where("size(licences) > 0").count() == 0
    assert L.scan(edge_docs(spark), {"none": "here: 'a text whose row has no id'"}).where("size(licences) > 0").count() == 0
    nameless = L.scan(edge_docs(spark), {"x": "text whose row has no"}).where("size(licences) > 0").collect()
    assert [r.doc_id for r in nameless] == [None]
