"""Bootstrap by weight vectors against replicates drawn one by one, with small pieces, hot scores and awkward rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.functions.hashing import poisson_bounds
from ledgerspark.operators import stats as S

N = 40


def weight(i, replicate, seed=42):
    if replicate == 0:
        return 1
    text = f"{seed}|{(replicate - 1) // 4}" + ("" if i is None else f"|{i}")
    at = 8 * ((replicate - 1) % 4)
    return sum(int(hashlib.md5(text.encode()).hexdigest()[at : at + 8], 16) >= b for b in poisson_bounds())


@pytest.fixture(scope="module")
def data():
    rng = random.Random(21)
    out = []
    for i in range(700):
        y = int(rng.random() < 0.3)
        p = 0.5 if i % 3 == 0 else round(rng.random() * 0.7 + 0.3 * y, 2)  # a third of the rows share one score
        q = p if i % 3 == 0 else min(1.0, p + 0.1 * y + 0.001 * (i % 7))
        out.append((str(i), "s" if i % 4 else "t", y, p, q, float(rng.randint(0, 900)) if i % 11 else None))
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "id string, seg string, y int, p double, q double, usd double").repartition(5)


def summary(pairs):
    base, treat = pairs[0]
    deltas = [t - b for b, t in pairs[1:]]
    p = min(1.0, 2 * min(np.mean([d <= 0 for d in deltas]), np.mean([d >= 0 for d in deltas])))
    return [round(x, 4) for x in (base, treat, treat - base, np.quantile(deltas, 0.025), np.quantile(deltas, 0.975), p)]


def same(row, want):
    got = [row[c] for c in ("base", "treatment", "delta", "ci_low", "ci_high", "p_value")]
    assert got == [pytest.approx(w, abs=1.01e-4) for w in want]


def average_precision(rows):
    points, pos, seen, out = {}, 0, 0, 0.0
    for w, y, s in rows:
        a, b = points.get(s, (0, 0))
        points[s] = a + w * y, b + w
    total = sum(a for a, _ in points.values())
    for s in sorted(points, reverse=True):
        a, b = points[s]
        pos, seen = pos + a, seen + b
        out += a * pos / seen if seen else 0
    return out / total


def recall(rows):
    rows = sorted(rows, key=lambda r: (-r[2], hashlib.md5(r[3].encode()).hexdigest()))
    k, at, got = max(1, math.ceil(0.1 * sum(r[0] for r in rows))), 0, 0.0
    for w, usd, _, _ in rows:
        got += max(0, min(w, k - at)) * (usd or 0)
        at += w
    return got / sum(w * (usd or 0) for w, usd, _, _ in rows)


def test_weights_are_the_written_draws():
    ids = ["a", None, "7", ""]
    got = S.replicate_weights(ids, N, 42)
    assert got.tolist() == [[weight(i, r) for r in range(N + 1)] for i in ids]
    assert S.replicate_weights([], N, 42).shape == (0, N + 1)
    many = S.replicate_weights([str(i) for i in range(3000)], 8, 1)[:, 1:]
    assert many.mean() == pytest.approx(1, abs=0.03) and many.var() == pytest.approx(1, abs=0.06)


def test_means_equal_single_draws(df, data):
    rows = {r["seg"]: r for r in S.paired_bootstrap(df, S.weighted_brier("y"), "p", "q", n_boot=N, keys=["seg"]).collect()}
    for seg in "st":
        own = [d for d in data if d[1] == seg]
        mean = lambda c, r: sum(weight(d[0], r) * (d[c] - d[2]) ** 2 for d in own) / sum(weight(d[0], r) for d in own)
        same(rows[seg], summary([(mean(3, r), mean(4, r)) for r in range(N + 1)]))


@pytest.mark.parametrize("size", [50, 10_000])
def test_curves_equal_single_draws(df, data, size, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        rows = {r["seg"]: r for r in S.bootstrap_pr_auc(df, "p", "q", n_boot=N, keys=["seg"], rows_per_range=size).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for seg in "st":
        own = [d for d in data if d[1] == seg]
        same(rows[seg], summary([tuple(average_precision([(weight(d[0], r), d[2], d[c]) for d in own]) for c in (3, 4)) for r in range(N + 1)]))


@pytest.mark.parametrize("size", [40, 10_000])
def test_recall_equals_single_draws(df, data, size):
    row = S.bootstrap_dollar_recall(df, "usd", "p", "q", n_boot=N, rows_per_range=size).first()
    same(row, summary([tuple(recall([(weight(d[0], r), d[5], d[c], d[0]) for d in data]) for c in (3, 4)) for r in range(N + 1)]))


def test_large_weight_sums_and_missing_values(spark):
    rows = spark.range(900).select(F.col("id").cast("string"), F.lit(1).alias("y"), F.lit(0.5).alias("p"), F.when(F.col("id") > 0, 0.5).alias("q"))
    row = S.bootstrap_pr_auc(rows, "p", "q", n_boot=8).first()
    assert row["base"] is None and row["treatment"] is None  # one class only
    mean = S.paired_bootstrap(rows, S.weighted_mae("y"), "p", "q", n_boot=8).first()
    assert mean["base"] == 0.5 and mean["delta"] == 0 and not mean["significant"]
    empty = rows.filter("id = 'none'")
    assert S.bootstrap_dollar_recall(empty.withColumn("usd", F.lit(1.0)), "usd", "p", "q", n_boot=8).first()["base"] is None


def test_shuffled_rows_do_not_grow_with_replicates(df):
    """One row a task, key and replicate leaves the scan of a mean; cells of a curve carry all replicates at once."""
    plan = S.paired_bootstrap(df, S.weighted_brier("y"), "p", "q", n_boot=N)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


def test_md5_side_by_side_is_md5():
    import hashlib

    from ledgerspark.functions.hashing import md5_numbers

    starts = [b"", b"42|0", b"42|37"]
    for ends in ([b"|%d" % 7**i for i in range(40)] + [b"", b"|\x00", "|\u00e9".encode()], [b"|" + b"x" * k for k in (49, 50, 51, 200)], []):
        want = [[int(hashlib.md5(s + e).hexdigest()[8 * j : 8 * j + 8], 16) for s in starts for j in range(4)] for e in ends]
        assert md5_numbers(starts, ends).tolist() == want


def test_losses_of_one_pass_are_those_of_their_own(spark):
    rows = [(i, f"s{i % 2}", i % 3 / 2, None if i % 5 == 0 else i % 7 / 7, i % 4 / 4, None if i % 2 else i / 60, i / 50) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, seg string, y double, p double, q double, e double, f double")
    both = [(S.weighted_brier("y"), "p", "q"), (S.weighted_mae("y"), "e", "f")]
    for got, (loss, base, treat) in zip(S.paired_bootstraps(df, both, n_boot=20, keys=["seg"]), both):
        alone = S.paired_bootstrap(df.filter(f"{base} IS NOT NULL"), loss, base, treat, n_boot=20, keys=["seg"])
        assert sorted(got.collect()) == sorted(alone.collect())
