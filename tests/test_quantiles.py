"""Bracketed quantiles against numpy: hot values, ties, nulls, narrow sketches, forced narrowing, and the reads they take."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import drift as DR
from ledgerspark.operators import profile as PR
from ledgerspark.operators import quantiles as Q

PROBS = {f"q{i}": i / 10 for i in range(11)} | {"odd": 0.3333}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(6)
    out = []
    for i in range(5000):
        out.append((
            rng.gauss(0, 1), 7.0 if i % 3 == 0 else rng.random() * 10, float(rng.randint(0, 3)), None if i % 2 else rng.expovariate(1),
            float("nan") if i % 5 == 0 else i / 7, 4.0, None))
    return out


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, "smooth double, hot double, few double, holes double, nans double, same double, nothing double").repartition(4).cache()


@pytest.mark.parametrize(("accuracy", "most"), [(10_000, 10**6), (50, 10**6), (50, 200), (20, 1)])
def test_equals_numpy(df, data, accuracy, most):
    found, extra = Q.wide_quantiles(df, df.columns, PROBS, [F.count(F.lit(1)).alias("rows")], accuracy, most)
    rows = {r["column"]: r for r in found.collect()}
    assert extra["rows"] == 5000 and set(rows) == set(df.columns) - {"nothing"}
    for c, name in enumerate(df.columns[:-1]):
        own = np.array([r[c] for r in data if r[c] is not None and r[c] == r[c]])
        assert rows[name]["n_valid"] == len(own)
        for q, p in PROBS.items():
            assert rows[name][q] == pytest.approx(np.quantile(own, p), abs=1e-12)
            assert rows[name][f"below_{q}"] == (own < rows[name][q]).sum()


def test_brackets_that_miss_are_counted_whole(df, data, monkeypatch):
    monkeypatch.setattr(Q, "_disjoint", lambda brackets: [(99.0, 100.0)])
    row = Q.wide_quantiles(df, ["smooth"], {"q": 0.5})[0].first()
    assert row["q"] == pytest.approx(np.median([r[0] for r in data]))


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(3.0,)], "v double")
    assert Q.wide_quantiles(one, ["v"], PROBS)[0].first()["q7"] == 3.0
    assert Q.wide_quantiles(one.filter("v > 5"), ["v"], PROBS)[0].count() == 0
    two = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert Q.wide_quantiles(two, ["v"], {"m": 0.5})[0].first()["m"] == 1.5


def test_only_bracket_values_are_shuffled(spark):
    """Of 200,000 values a column, some hundred leave the second read."""
    wide = spark.range(200_000).select(
        *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**12)).cast("double").alias(f"c{i}") for i in range(3)])
    values = [F.col(f"c{i}") for i in range(3)]
    first = wide.agg(*[F.percentile_approx(v, [0.4997, 0.5003], Q.ACCURACY).alias(f"q{i}") for i, v in enumerate(values)]).first()
    counted = Q._counted(wide, values, {i: [tuple(first[f"q{i}"])] for i in range(3)})
    assert counted.count() < 3 * 400


def test_drift_equals_the_long_form(df):
    early, late = df.filter("hash(smooth) % 2 = 0"), df.withColumns({"smooth": F.col("smooth") + 0.4, "few": F.col("few") * 2})
    names = ["smooth", "hot", "few", "holes", "same", "nothing"]
    got = {r["feature"]: r["psi"] for r in DR.wide_psi(early, late, names).collect()}
    long = DR.psi_long(PR.long_form(early, names, "double", "feature"), PR.long_form(late, names, "double", "feature"))
    want = {r["feature"]: r["psi"] for r in long.collect()}
    assert set(got) == set(names) and got["nothing"] is None
    assert {c: pytest.approx(v, abs=1e-12) for c, v in want.items()} == {c: got[c] for c in want}
