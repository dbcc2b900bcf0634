"""Model fits, writers and streams: shapes and invariants."""

import datetime as dt

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ledgerspark.operators import billing as B
from ledgerspark.operators import models as ML
from ledgerspark.plans import churn as CP
from ledgerspark.sources import domain as D
from ledgerspark.sources import sinks as SK
from ledgerspark.streaming import streams as S


@pytest.fixture(scope="module")
def matrix(spark):
    return CP.churn_matrix(D.invoices(spark, "/root/testdata/sf0.01"), D.SNAPSHOTS, daily=True)


def test_dual_scores_and_decisions(spark, matrix):
    train, test = ML.temporal_split(matrix)
    assert train.select("snapshot_date").distinct().count() == 1 and test.first()["snapshot_date"] == D.SNAPSHOTS[-1]
    models = CP.fit_dual(train, 2, 2)
    out = CP.batch_score_dual(test, models)
    assert out.count() == test.count()
    row = out.agg(
        F.min("with_interval.churn_probability").alias("lo"), F.max("with_interval.churn_probability").alias("hi"),
        F.min("with_interval.expected_dollar_churn").alias("loss"), F.count("interval_reason").alias("texts"),
        F.count("comparison.narrative").alias("notes")).first()
    assert 0 <= row["lo"] <= row["hi"] <= 1 and row["loss"] >= 0 and row["texts"] == row["notes"] == test.count()
    ghosts = spark.createDataFrame([("nobody",)], "customerid string")
    assert CP.no_history_rows(ghosts, test).first()["reason"] == "no_history"


def test_baseline_contributions_add_up(matrix):
    import math

    feats = ["recency_days", "n_events", "gap_cv", "total_amount"]
    model = ML.fit_logistic_baseline(matrix, feats)
    scored = ML.logistic_contributions(model.predict(matrix, "p"), model).limit(20).collect()
    bias = model.bias
    for r in scored:
        z = bias + sum(d["contribution"] for d in r["drivers"])
        assert 1 / (1 + math.exp(-z)) == pytest.approx(r["p"], abs=1e-9)


def test_tree_contributions_add_up(matrix):
    ready = ML.as_double(matrix, ["recency_days", "n_events", "past_rev"]).withColumn("_t", F.col("y_loss"))
    for name in ("random_forest", "boosted_trees"):
        pipe = Pipeline(stages=[*ML.encoding(["recency_days", "n_events"], ["billing_interval"]).getStages(), ML.regressors(rounds=3)[name]]).fit(ready)
        feats = ["recency_days", "n_events", "billing_interval"]
        long = ML.tree_contributions(ready, pipe, feats, ["customerid", "snapshot_date"])
        total = long.groupBy("customerid", "snapshot_date").agg(F.sum("contribution").alias("c"))
        gap = pipe.transform(ready).join(total, ["customerid", "snapshot_date"]).withColumn("base", F.col("prediction") - F.col("c"))
        row = gap.agg(F.min("base").alias("lo"), F.max("base").alias("hi")).first()
        assert row["hi"] - row["lo"] == pytest.approx(0, abs=1e-6 * abs(row["hi"]))


def test_out_of_fold_invariants(spark):
    rows = [(f"L{i % 7}", f"C{i}", float(i % 3 == 0) if i % 11 else None, float(i % 5), float(i % 13)) for i in range(150)]
    base = spark.createDataFrame(rows, "LandLordID string, CompanyID string, CompanyIsActive double, a double, b double")
    out = ML.oof_residuals(base, n_splits=3).collect()
    assert len(out) == 150
    folds = {}
    for r in out:
        if r["CompanyIsActive"] is None:
            assert r["OOFFold"] == -1 and r["OOFPredictedProb"] is None
        else:
            assert 0 < r["OOFPredictedProb"] < 1 and r["OOFResidual"] == pytest.approx(r["CompanyIsActive"] - r["OOFPredictedProb"])
            folds.setdefault(r["LandLordID"], set()).add(r["OOFFold"])
    assert all(len(f) == 1 for f in folds.values())
    with pytest.raises(ValueError):
        ML.oof_residuals(base.withColumn("CompanyIsActive", F.lit(1.0)))
    assert ML.clamp_splits(5, 3, 10) == 3 and ML.clamp_splits(5, 1, 1) == 2


def test_unseen_text_gets_extra_index(spark):
    train = spark.createDataFrame([("x", 1.0), ("y", None), (None, 3.0)], "t string, v double")
    other = spark.createDataFrame([("z", None), ("x", 2.0)], "t string, v double")
    _, out, _ = ML.encode_features(train, other, ["v"], ["t"])
    got = [(r["t__i"], r["v__f"]) for r in out.collect()]
    assert got[0][0] == 3.0 and got[1] == (1.0, 2.0) and got[0][1] in (1.0, 3.0)


def test_results_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, (2,))], "id string, k int, nested struct<x:int>")
    root = str(tmp_path / "out")
    paths = SK.write_result(df, root, "r1", ["k"])
    assert spark.read.parquet(paths["parquet"]).select("nested.x").first()[0] == 2
    assert "nested" not in spark.read.option("header", True).csv(paths["csv"]).columns
    with pytest.raises(Exception):
        SK.write_result(df, root, "r1")
    SK.write_result(df, root, "r2")
    assert SK.latest_run(spark, root) == "r2"
    counts = SK.write_verdict_lists(
        spark.createDataFrame([("b", "Review"), ("a", "Review"), ("c", "No-Go")], "CompanyID string, recommendation string"), str(tmp_path / "v"))
    assert {r["recommendation"]: r["n"] for r in counts.collect()} == {"Review": 2, "No-Go": 1}
    assert [r[0] for r in spark.read.text(str(tmp_path / "v" / "recommendation=Review")).collect()] == ["a", "b"]


def day(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def test_stream_late_rows_update_then_drop(spark, tmp_path):
    src = tmp_path / "in"
    schema = "customerid string, date timestamp, amount double"
    put = lambda i, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"{i}"))
    go = lambda: S.run(S.same_day_events(
        spark.readStream.schema(schema).parquet(str(src / "*"))), str(tmp_path / "sink"), "update")
    put(0, [("a", day(0), 1.0), ("a", day(10), 5.0)])
    go()
    put(1, [("a", day(9), 2.0), ("a", day(0), 100.0)])
    out = {r["date"]: r["event_amount"] for r in S.latest(go(), ["customerid", "date"]).collect()}
    assert out == {day(0).date(): 1.0, day(10).date(): 5.0, day(9).date(): 2.0}


def test_gap_tracker_takes_late_days_and_equals_the_batch_result(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "sink")
    every = []

    def put(i, rows):
        every.extend(rows)
        spark.createDataFrame([(c, day(d).date()) for c, d in rows], "customerid string, d date").coalesce(1).write.parquet(str(src / f"{i}"))
        S.gap_tracker(spark.readStream.schema("customerid string, d date").parquet(str(src / "*")), sink).awaitTermination()
        now = S.latest(spark.read.parquet(sink + "/data"), ["customerid"])
        return {r["customerid"]: (r["billing_interval"], r["n_days"]) for r in now.collect()}

    assert put(0, [("a", 0)]) == {"a": ("insufficient_history", 1)}
    assert put(1, [("a", 30), ("a", 60), ("a", 60), ("b", 5)])["a"] == ("monthly", 3)
    assert put(2, [("a", 120)])["a"][1] == 4
    got = put(3, [("a", 90), ("a", 30), ("c", 1), ("b", 35), ("b", 65)])
    assert got["a"] == ("monthly", 5) and got["b"] == ("monthly", 3)
    events = B.same_day_events(spark.createDataFrame([(c, day(d).date(), 1.0) for c, d in set(every)], "customerid string, date date, amount double"))
    want = B.infer_intervals(events, [day(121).date()], daily=True)
    assert got == {r["customerid"]: (r["billing_interval"], r["n_events"]) for r in want.collect()}


def test_scores_come_from_the_whole_history(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "sink")
    schema = "customerid string, date timestamp, amount double"
    scorer = lambda rows: rows.groupBy("customerid").agg(F.sum("amount").alias("score"), F.count(F.lit(1)).alias("n"))

    def put(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"{i}"))
        S.score_files(spark.readStream.schema(schema).parquet(str(src / "*")), sink, scorer).awaitTermination()
        return {r["customerid"]: (r["score"], r["n"]) for r in S.latest(spark.read.parquet(sink + "/data"), ["customerid"]).collect()}

    assert put(0, [("a", day(5), 1.0), ("b", day(1), 7.0)]) == {"a": (1.0, 1), "b": (7.0, 1)}
    assert put(1, [("a", day(2), 2.0), ("c", day(3), 3.0)]) == {"a": (3.0, 2), "b": (7.0, 1), "c": (3.0, 1)}


def test_alerts_count_what_did_not_happen(spark):
    week = lambda k: dt.date(2025, 1, 6) + dt.timedelta(days=7 * k)
    rows = [(0, "Continue", 50), (0, "Review", 50), (1, "Review", 10), (2, "Continue", 50), (2, "Review", 50), (4, "Continue", 9)]
    counts = spark.createDataFrame([(week(k), v, n) for k, v, n in rows], "period date, recommendation string, n long")
    got = {((r["period"] - week(0)).days // 7, r["recommendation"]): (r["shift"], r["alert"]) for r in S.mix_alerts(counts).collect()}
    assert got[1, "Continue"] == (-50.0, True) and got[2, "Continue"] == (50.0, True) and got[1, "No-Go"] == (0.0, False)
    assert got[4, "Continue"] == (None, False) and len(got) == 12
    # A rule that fires one day in ten has a low baseline, so one more day of firing is an alert.
    quiet = [(dt.date(2025, 1, d), None, 90) for d in range(1, 31)]
    fired = [(dt.date(2025, 1, d), "r", 10 + d % 2) for d in (10, 20)] + [(dt.date(2025, 1, 30), "r", 60)]
    daily = spark.createDataFrame(quiet + fired, "day date, guardrail_rule string, n long")
    out = {r["day"].day: r for r in S.rule_alerts(daily, ["r"]).collect()}
    assert len(out) == 30 and out[5]["fired"] == 0 and out[30]["alert"] and out[30]["baseline"] < 0.01


def test_many_cities_do_not_break_the_trees(spark, tmp_path):
    rows = [(f"o{k}", float(k % 17), f"it's city {k % 230}", (k % 7) / 7.0) for k in range(690)]
    matrix = spark.createDataFrame(rows, "LandLordID string, Area double, OriginCity string, AdjustedScore double")
    done = ML.cv_regressors(matrix, ["Area"], ["OriginCity"], n_splits=2, models={"random_forest": ML.regressors(rounds=2)["random_forest"]})
    assert done.predictions.filter(F.col("pred").isNull()).count() == 0 and done.predictions.count() == 690
    model = done.models["random_forest"]
    model.write().save(str(tmp_path / "m"))
    ready = matrix.withColumn("_t", F.col("AdjustedScore"))
    assert type(model).load(str(tmp_path / "m")).transform(ready).count() == 690
    unseen = spark.createDataFrame([("x", 1.0, "nowhere", 0.0), ("y", None, None, 0.0)], matrix.schema).withColumn("_t", F.lit(0.0))
    assert model.transform(unseen.fillna({"OriginCity": "__missing__"})).filter(F.col("prediction").isNull()).count() == 0
