"""Invoices to decisions: two churn models (with and without interval features) on one feature pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.config import BillingConfig
from ledgerspark.functions import text as X
from ledgerspark.operators import billing as B
from ledgerspark.operators import decision as DE
from ledgerspark.operators import metrics as M
from ledgerspark.operators import models as ML
from ledgerspark.operators import shapley as SH
from ledgerspark.session import materialise

WITH_INTERVAL = B.FEATURE_SETS["core_gap_interval"]
WITHOUT_INTERVAL = B.FEATURE_SETS["core_gap"]


@dataclass
class Pair:
    frequency: ML.Frequency
    severity: ML.Severity


@dataclass
class DualModel:
    with_interval: Pair
    without_interval: Pair


def fit_pair(train: DataFrame, features: Sequence[str], max_iter: int, max_depth: int, seed: int) -> Pair:
    return Pair(
        ML.fit_frequency(train, features, max_iter=max_iter, max_depth=max_depth, seed=seed),
        ML.fit_severity(train, features, max_iter=max_iter, max_depth=max_depth, seed=seed),
    )


def fit_dual(train: DataFrame, max_iter: int = 20, max_depth: int = 5, seed: int = 42) -> DualModel:
    return DualModel(
        fit_pair(train, WITH_INTERVAL, max_iter, max_depth, seed),
        fit_pair(train, WITHOUT_INTERVAL, max_iter, max_depth, seed),
    )


def score_both(df: DataFrame, models: DualModel) -> DataFrame:
    a = ML.with_expected_loss(df, models.with_interval.frequency, models.with_interval.severity, "with_p", "with_loss")
    return ML.with_expected_loss(a, models.without_interval.frequency, models.without_interval.severity, "without_p", "without_loss")


def holdout_comparison(test: DataFrame, models: DualModel, id_col: str = "customerid") -> DataFrame:
    """Both models on the same test fold: curve metrics, dollar recall, expected-loss error, deltas."""
    scored = materialise(
        score_both(test, models).select(id_col, "y_churn", "y_loss", "with_p", "with_loss", "without_p", "without_loss"), "holdout")
    long = scored.select(id_col, "y_churn", "y_loss", F.inline(F.array(*[
        F.struct(F.lit(tag).alias("model"), F.col(f"{tag}_p").alias("p"), F.col(f"{tag}_loss").alias("e"))
        for tag in ("with", "without")
    ])))
    curves = M.curve_metrics(long, "y_churn", "p", ["model"])
    recall = M.dollar_recall_at_k(long, "y_loss", "e", 0.10, id_col, ["model"]).select("model", "recall")
    error = long.groupBy("model").agg(M.mae(F.col("y_loss"), F.col("e")).alias("expected_loss_mae"), F.count(F.lit(1)).alias("n"))
    table = curves.join(recall, "model").join(error, "model")
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    cols = ("pr_auc", "roc_auc", "recall", "expected_loss_mae")
    one = table.agg(F.max("n").alias("n_test"), *[pick(m, c).alias(f"{m}_{c}") for m in ("with", "without") for c in cols])
    return one.withColumns({f"delta_{c}": F.col(f"with_{c}") - F.col(f"without_{c}") for c in cols})


def explained_rows(scored: DataFrame, top_n: int, ids: Sequence[str]) -> DataFrame:
    """Rows to explain, of rows with with_p: the asked-for customers and the top_n of highest churn probability (ties by id)."""
    asked = scored.filter(F.col("customerid").isin(list(ids))) if ids else scored.limit(0)
    if top_n <= 0:
        return asked
    key = [F.col("with_p").desc(), F.col("customerid"), F.col("snapshot_date")]
    return asked.unionByName(scored.orderBy(*key).limit(top_n)).dropDuplicates(["customerid", "snapshot_date"])


def briefings(rows: DataFrame, freq: ML.Frequency, p: str, cfg: BillingConfig, out: str, k: int = 4) -> DataFrame:
    """(customerid, snapshot_date, out): Shapley drivers of the uncalibrated log-odds, the k strongest each way, with tier and text."""
    ready = ML.as_double(rows, freq.features)
    found = SH.shapley_drivers(ready, freq.pipeline, freq.features, ["customerid", "snapshot_date", p])
    top = found.withColumns({"s": SH.strongest(F.col("drivers"), k), "tier": DE.risk_tier_label(F.col(p), cfg.decision)})
    item = lambda d: F.struct(
        d["feature"].alias("feature"), X.by_name(d["feature"], X.CHURN_NAMES, d["feature"]).alias("label"),
        X.churn_value(d["feature"], d["value"]).alias("value"), F.round(d["contribution"], 4).alias("contribution"))
    return top.select("customerid", "snapshot_date", F.struct(
        "tier", DE.margin_label(F.col(p)).alias("confidence"), item(F.col("s.main")).alias("main"),
        F.transform("s.increasing", item).alias("increasing"), F.transform("s.decreasing", item).alias("decreasing"),
        X.explain_drivers(F.col("tier"), F.col("s.increasing"), F.col("s.decreasing"), F.lit(True)).alias("told"),
        F.col("base").alias("base"), F.aggregate("drivers", F.lit(0.0), lambda t, d: t + d["contribution"]).alias("total"),
    ).alias(out))


def batch_score_dual(
    features: DataFrame, models: DualModel, cfg: BillingConfig = BillingConfig(), customers: DataFrame | None = None,
    explain_top_n: int = 0, explain_ids: Sequence[str] = (),
) -> DataFrame:
    """Feature rows -> both decisions, texts and deltas, one row per customer and snapshot.

    Column expressions all the way; nothing is scored row by row. With customers given, those of them without any history
    are added as Review rows, their scores null. The explain_top_n customers of highest churn probability and those of
    explain_ids get a briefing with their drivers on either side; others have none (null).
    """
    c = F.col
    scored = score_both(features, models)
    if explain_top_n > 0 or explain_ids:
        scored = materialise(scored, "scored")
        picked = materialise(explained_rows(scored, explain_top_n, explain_ids), "explained")  # a bounded choice of the caller
        for tag, pair in (("with", models.with_interval), ("without", models.without_interval)):
            notes = briefings(picked, pair.frequency, f"{tag}_p", cfg, f"{tag}_briefing")
            scored = scored.join(materialise(notes, "briefings"), ["customerid", "snapshot_date"], "left")
    conf = c("interval_confidence")
    out = scored.withColumns({
        "w": DE.decide(c("with_p"), conf, cfg.decision), "o": DE.decide(c("without_p"), conf, cfg.decision),
    })
    none = F.array().cast("array<struct<feature:string,contribution:double,value:double>>")
    untold = X.explain_drivers(F.lit(""), none, none, F.lit(False))
    briefing = lambda tag: (
        [c(f"{tag}_briefing").alias("briefing"), F.coalesce(c(f"{tag}_briefing.told"), untold).alias("drivers_told")]
        if f"{tag}_briefing" in scored.columns else [])
    side = lambda tag, s: F.struct(
        *briefing(tag),
        c(f"{s}.recommendation").alias("recommendation"), c(f"{s}.reason").alias("reason"), c(f"{s}.detail").alias("detail"),
        c(f"{s}.auto_decided").alias("auto_decided"), F.bround(c(f"{tag}_p"), 4).alias("churn_probability"),
        F.bround(c(f"{tag}_loss"), 2).alias("expected_dollar_churn"),
        X.explain_decision(
            c(f"{s}.recommendation"), c(f"{s}.reason"), c(f"{s}.detail"), c(f"{tag}_p"), conf, c("billing_interval"),
            f"trained {tag.upper()} inferred-interval features").alias("decision_reason"),
    )
    agree = c("w.recommendation") == c("o.recommendation")
    scored = out.select(
        "customerid", "snapshot_date", c("billing_interval").alias("inferred_interval"), "interval_confidence",
        X.explain_interval(
            c("billing_interval"), conf, c("n_events"), c("n_gaps"), c("median_gap_days"), c("gap_cv"), c("dominant_base"),
            c("dominant_share"), c("n_distinct_bases"), c("recency_days")).alias("interval_reason"),
        c("w.recommendation").alias("recommendation"), c("w.reason").alias("reason"),
        side("with", "w")["decision_reason"].alias("decision_reason"),
        side("with", "w").alias("with_interval"), side("without", "o").alias("without_interval"),
        F.struct(
            agree.alias("recommendations_agree"),
            F.bround(c("with_p") - c("without_p"), 4).alias("churn_probability_delta"),
            F.bround(c("with_loss") - c("without_loss"), 2).alias("expected_dollar_churn_delta"),
            X.compare_decisions(c("w.recommendation"), c("o.recommendation"), c("with_p"), c("without_p")).alias("narrative"),
        ).alias("comparison"),
        "n_events", "median_gap_days",
    )
    if customers is None:
        return scored
    return scored.unionByName(no_history_rows(customers, features), allowMissingColumns=True)


def no_history_rows(customers: DataFrame, features: DataFrame) -> DataFrame:
    """Asked-for customers without any history before the snapshot: Review, no_history."""
    missing = customers.select("customerid").distinct().join(features.select("customerid").distinct(), "customerid", "left_anti")
    nothing = F.lit(None).cast("double")
    return missing.select(
        "customerid", F.lit("Review").alias("recommendation"), F.lit("no_history").alias("reason"),
        X.explain_decision(F.lit("Review"), F.lit("no_history"), F.lit(""), nothing, nothing, F.lit(None).cast("string")).alias("decision_reason"),
    )


def churn_matrix(invoices: DataFrame, snapshots: Sequence[dt.date], cfg: BillingConfig = BillingConfig(), daily: bool = False) -> DataFrame:
    """The labelled feature table, written once: every later fit and score reads it."""
    events = B.same_day_events(invoices)
    return materialise(B.build_churn_matrix(events, snapshots, cfg.interval, cfg.churn, daily), "features")
