import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import quality_rules as Q
from tests.llm.frames import DOCS, edge_docs, no_docs, words


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [
    None, "", " \n ", "a b c d e", "a b c d e a b c d e", "x " * 30, "one\ntwo\none\n\n \none", "# * $ a|b <c> &",
    "a b c d e f a b c d e g " * 3, "漢字 é\u00a0z\x0bq\x0cr\rs", words(1, 400) + "\n" + words(1, 400), words(2, 30_000),
    "a b c d e x a b c d e f b c d e f",
]


def test_metrics_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(TEXTS)], DOCS)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in Q.metrics(docs).collect():
        assert tuple(r[n] for n in names) == brute(TEXTS[r.doc_id]), r.doc_id


def test_binomial_bound_is_exact(spark):
    cases = [(0, 500, 0.01), (3, 900, 0.01), (7, 2000, 0.01), (90, 9000, 0.02), (20, 1000, 0.02), (0, 1, 0.5)]
    for k, n, p in cases:
        frame = spark.createDataFrame([(k, n)], "k bigint, n bigint")
        got = frame.select(Q.log_binomial_cdf(F.col("k"), F.col("n"), p)).first()[0]
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(0.0 if k >= n * p else math.log(exact), rel=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """On data where every cutoff's true risk is known, no cutoff above the risk is chosen, and safe ones are."""
    rules = {"m": ("m", 1, tuple(k / 100 for k in range(90, 100)))}
    frame = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "big").otherwise("big2").alias("stratum"), (F.xxhash64("id") % 100_000 / 1e5).alias("m"))
    frame = frame.withColumn("m", F.abs("m")).unionByName(frame.limit(50).withColumn("stratum", F.lit("small")))
    cuts = {r.stratum: r.cut_m for r in Q.choose_cutoffs(frame, risk=0.05, error=0.05, rules=rules).collect()}
    assert set(cuts) == {"big", "big2"}
    for s, cut in cuts.items():
        assert 0.95 <= cut <= 0.97
        assert frame.where(F.col("stratum") == s).where(F.col("m") > cut).count() <= 0.05 * 10_000


def test_only_native_functions(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    plan = Q.judge(edge_docs(spark), labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_rejects_junk_and_keeps_clean_rows(spark):
    rows, labels = [], []
    for k in range(3000):
        bad = k % 5 == 0
        w = words(k, 40).split()
        rows.append((k, " ".join(x + ("%%%" if bad else "") for x in w), "en" if k % 2 else None, "a", 0))
        labels.append((k, 0 if bad else 1, 0))
    labels += [(1, 1, 0), (99_999, 1, 0), (3, None, 0)]
    verdict = {r.doc_id: r for r in Q.judge(
        spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert len(verdict) == 3000
    assert not any(verdict[k].kept for k in range(0, 3000, 5))
    good = [verdict[k].kept for k in range(3000) if k % 5]
    assert sum(good) / len(good) > 0.98


def test_edge_rows(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = Q.judge(edge_docs(spark), labels).collect()
    assert len(rows) == 10
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 4))
    assert next(r for r in rows if r.doc_id == 7).n_words == 60_000
    assert Q.judge(no_docs(spark), labels).count() == 0
