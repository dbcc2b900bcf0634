"""Ranks and quantiles with forced small ranges and one value holding a third of the rows."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import metrics as M
from ledgerspark.operators import ordering as O
from ledgerspark.operators import ranking as R
from ledgerspark.operators import stats as S

SMALL = 50


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 900
    v = np.round(rng.normal(size=n), 2)
    v[: n // 3] = 0.5
    y = (rng.random(n) < 0.4).astype(int)
    return pd.DataFrame({
        "id": np.arange(n), "v": v, "y": y, "p": np.round(np.clip(v * 0.1 + y * 0.1 + rng.random(n) * 0.5, 0, 1), 2),
        "k": np.where(np.arange(n) % 3 == 0, "a", "b"), "usd": rng.integers(1, 1000, n).astype(float),
    })


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows)


def test_ranges_are_really_used(df):
    assert len(R.range_bounds(df, "v", rows_per_range=SMALL)[()]) > 3
    assert R.range_bounds(df, "v") == {}


@pytest.mark.parametrize("size", [SMALL, 10**6])
def test_average_rank(df, rows, size):
    got = R.with_average_rank(df, "v", "r", rows_per_range=size).toPandas().set_index("id")["r"].sort_index()
    assert np.allclose(got, rows["v"].rank(method="average"))
    keyed = R.with_average_rank(df, "v", "r", ["k"], size).toPandas().set_index("id")["r"].sort_index()
    assert np.allclose(keyed, rows.groupby("k")["v"].rank(method="average"))


@pytest.mark.parametrize("size", [SMALL, 10**6])
def test_dense_rank_and_nulls(spark, df, rows, size):
    with_null = df.select("id", F.when(F.col("id") % 10 != 0, F.col("v")).alias("v"))
    got = R.dense_rank_desc(with_null, "v", "r", size).toPandas().set_index("id")["r"].sort_index()
    want = rows["v"].where(rows["id"] % 10 != 0).rank(method="dense", ascending=False, na_option="bottom")
    assert (got.to_numpy() == want.to_numpy().astype(int)).all()


@pytest.mark.parametrize("size", [SMALL, 10**6])
def test_exact_quantiles(df, rows, size):
    probs = {"a": 0.0, "b": 0.1, "c": 0.333, "d": 0.5, "e": 0.977, "f": 1.0}
    got = R.exact_quantiles(df, "v", probs, rows_per_range=size).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(np.quantile(rows["v"], p))


@pytest.mark.parametrize("size", [SMALL, 10**6])
def test_positions_are_a_permutation_in_order(df, rows, size):
    got = R.global_positions(df, "v", "id", rows_per_range=size).toPandas().sort_values("position")
    assert got["position"].tolist() == list(range(1, len(rows) + 1))
    assert (np.diff(got["v"]) <= 0).all()


def test_rank_normalize_rules(spark):
    one = spark.createDataFrame([(1, 5.0), (2, None)], "id int, v double")
    got = {r["id"]: r["s"] for r in R.rank_normalize(one, "v", "s").collect()}
    assert got == {1: 0.5, 2: None}
    three = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 9.0)], "id int, v double")
    got = {r["id"]: r["s"] for r in R.rank_normalize(three, "v", "s").collect()}
    assert got[1] == 0.0 and got[4] == 1.0 and got[2] == got[3] == pytest.approx(0.5)


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


@pytest.mark.parametrize("size", [SMALL, 10**6])
def test_auc_against_pair_counting(df, rows, size):
    want = auc(rows["y"].to_numpy(), rows["p"].to_numpy())
    assert M.roc_auc(df, score="p", rows_per_range=size).first()[0] == pytest.approx(want)
    both = M.curve_metrics(df, score="p", keys=["k"], rows_per_range=size).toPandas().set_index("k")
    for k, part in rows.groupby("k"):
        assert both.loc[k, "roc_auc"] == pytest.approx(auc(part["y"].to_numpy(), part["p"].to_numpy()))


def test_one_class_has_no_auc(df):
    row = M.curve_metrics(df.filter("y = 1"), score="p").first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_average_precision(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, score double")
    assert M.pr_auc(df).first()[0] == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)


def test_dollar_recall(spark):
    df = spark.createDataFrame([(i, d, s) for i, (d, s) in enumerate([(1000.0, 0.9), (10.0, 0.5), (5.0, 0.4), (3.0, 0.1)])], "id int, usd double, s double")
    assert M.dollar_recall_at_k(df, "usd", "s", 0.25).first()["recall"] == pytest.approx(1000 / 1018)
    assert M.dollar_recall_at_k(df.withColumn("usd", F.lit(0.0)), "usd", "s", 0.25).first()["recall"] is None


@pytest.mark.parametrize("size", [SMALL, 10**6])
def test_dollar_recall_with_ties(df, rows, size):
    import hashlib

    order = rows.assign(h=[hashlib.md5(str(i).encode()).hexdigest() for i in rows["id"]]).sort_values(["v", "h"], ascending=[False, True])
    k = int(np.ceil(0.2 * len(rows)))
    want = order["usd"].head(k).sum() / rows["usd"].sum()
    assert M.dollar_recall_at_k(df, "usd", "v", 0.2, rows_per_range=size).first()["recall"] == pytest.approx(want)


def test_regression_metrics_spearman(df, rows):
    row = M.regression_metrics(df, "usd", "v", rows_per_range=SMALL).first()
    want = rows["usd"].rank().corr(rows["v"].rank())
    assert row["spearman"] == pytest.approx(want) and row["n"] == len(rows)


def test_spearman_of_millions_of_rows(spark):
    """The cube of the row count is beyond a long here."""
    n = 2_200_000
    frame = spark.range(n).select((F.col("id") % 100).cast("double").alias("usd"), (F.col("id") % 70).cast("double").alias("v"))
    at = pd.Series(np.arange(n))
    want = (at % 100).rank().corr((at % 70).rank())
    assert M.regression_metrics(frame, "usd", "v").first()["spearman"] == pytest.approx(want, abs=1e-9)
    by_key = M.regression_metrics(frame.withColumn("k", F.lit("a")), "usd", "v", ["k"]).first()
    assert by_key["spearman"] == pytest.approx(want, abs=1e-9)


def test_lift_bins_like_near_equal_split(df, rows):
    table = M.lift_table(df, "usd", "v", n_bins=7, rows_per_range=SMALL).orderBy("bin").collect()
    assert [r["n"] for r in table] == [len(x) for x in np.array_split(np.arange(len(rows)), 7)]
    assert all(a["mean_pred"] >= b["mean_pred"] for a, b in zip(table, table[1:]))


def test_band_capture_of_perfect_prediction(df):
    row = M.band_capture(df.withColumn("same", F.col("usd")), "usd", "same", rows_per_range=SMALL).first()
    assert row["top_capture_rate"] == 1.0 and row["bottom_capture_rate"] == 1.0


def test_percentile_and_band(spark):
    ref = spark.createDataFrame([(float(i),) for i in range(1, 11)], "score double")
    got = R.percentile_vs_reference(spark.createDataFrame([(1, 7.0), (2, 0.0), (3, None)], "id int, s double"), "s", ref, "score")
    by = {r["id"]: r for r in got.withColumn("band", R.quality_band(F.col("percentile"))).collect()}
    assert by[1]["percentile"] == 70.0 and by[1]["band"] == "good"
    assert by[2]["percentile"] == 0.0 and by[2]["band"] == "bad"
    assert by[3]["percentile"] is None and by[3]["band"] == "unknown"
    empty = R.percentile_vs_reference(spark.createDataFrame([(1, 0.4)], "id int, s double"), "s", ref.limit(0), "score").first()
    assert empty["percentile"] is None and empty["score_0_100"] == pytest.approx(40.0)


def test_delong_agrees_with_pairs_and_identity(df, rows):
    import math

    base = df.withColumn("q", F.col("p"))
    same = S.delong_test(base, "y", "p", "q", SMALL).first()
    assert same["delta"] == 0.0 and same["p_value"] == 1.0 and not same["significant"]
    other = df.withColumn("q", F.col("v"))
    got = S.delong_test(other, "y", "p", "q", SMALL).first()
    y = rows["y"].to_numpy()
    assert got["auc_base"] == pytest.approx(auc(y, rows["p"].to_numpy()), abs=1e-4)
    assert got["auc_treatment"] == pytest.approx(auc(y, rows["v"].to_numpy()), abs=1e-4)
    assert got["p_value"] == pytest.approx(math.erfc(abs(got["z"]) / math.sqrt(2)), abs=2e-4)


def test_normal_tail(spark):
    import math

    zs = spark.createDataFrame([(z / 4,) for z in range(0, 24)], "z double").select("z", S.normal_sf(F.col("z")).alias("p")).collect()
    assert max(abs(r["p"] - 0.5 * math.erfc(r["z"] / math.sqrt(2))) for r in zs) < 1e-7


def test_bootstrap_of_equal_models_is_not_significant(df):
    row = S.paired_bootstrap(df.withColumn("q", F.col("p")), S.weighted_brier("y"), "p", "q", n_boot=30).first()
    assert row["delta"] == 0.0 and not row["significant"] and row["p_value"] == 1.0


def test_bootstrap_sees_a_clear_gain(df):
    better = df.withColumn("q", F.col("y") * 0.8 + 0.1)
    for row in (
        S.paired_bootstrap(better, S.weighted_brier("y"), "p", "q", n_boot=30).first(),
        S.bootstrap_pr_auc(better, "p", "q", n_boot=20, rows_per_range=2000).first(),
    ):
        assert row["significant"]
    rec = S.bootstrap_dollar_recall(better.withColumn("loss", F.col("y") * F.col("usd")), "loss", "p", "q", n_boot=20).first()
    want = M.dollar_recall_at_k(better.withColumn("loss", F.col("y") * F.col("usd")), "loss", "p", 0.10).first()["recall"]
    assert rec["base"] == pytest.approx(want, abs=1e-4)


def test_case_studies(spark):
    rows = [(f"L{i}", float(i), 10) for i in range(9)] + [("small", 99.0, 1)]
    out = R.select_case_studies(spark.createDataFrame(rows, "LandLordID string, AdjustedScore double, TenantCount int"))
    got = {r["LandLordID"]: r["band"] for r in out.collect()}
    assert got == {"L8": "good", "L7": "good", "L0": "bad", "L1": "bad", "L4": "neutral"}


@pytest.mark.parametrize(("offset", "limit"), [(0, 5), (7, 30), (0, None), (890, 100), (895, None), (1000, 3), (0, 0)])
def test_slice_in_order(df, rows, offset, limit):
    got, total = O.slice_in_order(df.select("v", "id"), ["v", "id"], offset, limit)
    want = rows.sort_values(["v", "id"])["id"].to_numpy()[offset:][:limit]
    assert total == len(rows) and sorted(r["id"] for r in got.collect()) == sorted(want)


def test_slice_of_equal_rows(df):
    assert O.slice_in_order(df.select(F.lit(1).alias("x")), ["x"], 100, 250)[0].count() == 250


@pytest.mark.parametrize("n", [0, 1, 250, 900, 2000])
def test_first_by_hash(df, rows, n):
    key = F.md5(F.col("id").cast("string"))
    want = sorted(rows["id"], key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:n]
    assert sorted(r["id"] for r in O.first_by_hash(df, key, n, ties=["id"]).collect()) == sorted(want)
    per = {r["k"]: r["count"] for r in O.first_by_hash(df, key, n, ["k"], ["id"]).groupBy("k").count().collect()}
    assert per == {k: min(n, c) for k, c in rows["k"].value_counts().items() if n}
