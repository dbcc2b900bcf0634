"""Continue / Review / No-Go: decisions, threshold sweep, two-model comparison."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.config import DecisionConfig
from ledgerspark.functions.numeric import count_if, pct


def verdict(p: Column, confidence: Column, cont: Column, nogo: Column, min_conf: Column) -> Column:
    return (
        F.when(confidence < min_conf, F.lit("Review"))
        .when(p <= cont, F.lit("Continue"))
        .when(p >= nogo, F.lit("No-Go"))
        .otherwise(F.lit("Review"))
    )


def decide(p: Column, confidence: Column, cfg: DecisionConfig = DecisionConfig()) -> Column:
    """struct(recommendation, reason, detail, auto_decided) from churn risk and interval confidence."""
    cont, nogo, low = cfg.continue_max_risk, cfg.nogo_min_risk, cfg.min_interval_confidence
    unsure = confidence < low
    choice = verdict(p, confidence, F.lit(cont), F.lit(nogo), F.lit(low))
    reason = (
        F.when(unsure, F.lit("low_interval_confidence"))
        .when(p <= cont, F.lit("low_churn_risk"))
        .when(p >= nogo, F.lit("high_churn_risk"))
        .otherwise(F.lit("borderline_churn_risk"))
    )
    detail = F.when(
        unsure,
        F.format_string(
            f"interval_confidence %.2f < {low:.2f}; insufficient billing history to auto-decide "
            "(data-quality guardrail).", confidence),
    ).otherwise(F.format_string(f"churn_prob %.2f vs Continue<= {cont:.2f}, No-Go>= {nogo:.2f}.", p))
    return F.struct(
        choice.alias("recommendation"), reason.alias("reason"), detail.alias("detail"),
        (~unsure & (choice != "Review")).alias("auto_decided"),
    )


def risk_tier_label(p: Column, cfg: DecisionConfig = DecisionConfig()) -> Column:
    return (
        F.when(p >= cfg.nogo_min_risk, F.lit("High risk"))
        .when(p <= cfg.continue_max_risk, F.lit("Low risk"))
        .otherwise(F.lit("Medium risk"))
    )


def margin_label(p: Column) -> Column:
    d = F.abs(p - 0.5) * 2
    word = F.when(d >= 0.6, F.lit("High")).when(d >= 0.3, F.lit("Medium")).otherwise(F.lit("Low"))
    return F.format_string("%s (|p-0.5| margin %.2f)", word, d)


def recommendation_counts(df: DataFrame, verdict_col: str = "recommendation") -> DataFrame:
    return df.groupBy(verdict_col).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(
    df: DataFrame,
    prob: str = "churn_prob",
    confidence: str = "interval_confidence",
    cfg: DecisionConfig = DecisionConfig(),
    continue_grid: Sequence[float] = (0.20, 0.30, 0.40, 0.50),
    nogo_grid: Sequence[float] = (0.60, 0.70, 0.80),
    min_conf_grid: Sequence[float] = (0.30, 0.50, 0.70),
) -> DataFrame:
    """Verdict counts for every threshold triple with continue < no-go.

    Rows are first counted per (P class, confidence class), where the classes are cut exactly at the
    grid values; every grid point is then a sum over a few dozen cells. The rows are read once, and
    only the cells are handed to the grid points.
    """
    def cell(c: Column, cuts: Sequence[float]) -> Column:
        # 2 x index of the cut below, +1 when strictly above it: ordered, and exact at the cuts.
        out = F.lit(0)
        for cut in sorted(set(cuts)):
            out = out + F.when(c >= cut, 1).otherwise(0) + F.when(c > cut, 1).otherwise(0)
        return out

    p_cuts, c_cuts = sorted({*continue_grid, *nogo_grid}), sorted(set(min_conf_grid))
    cells = df.groupBy(
        cell(F.col(prob), p_cuts).alias("pc"), cell(F.col(confidence), c_cuts).alias("cc")
    ).agg(F.count(F.lit(1)).alias("k"))
    grid = [
        (c, g, m) for m, c, g in product(min_conf_grid, continue_grid, nogo_grid) if c < g
    ]
    points = F.array(*[
        F.struct(
            F.lit(float(cont)).alias("continue_max_risk"), F.lit(float(nogo)).alias("nogo_min_risk"),
            F.lit(float(low)).alias("min_interval_confidence"),
            F.lit(2 * p_cuts.index(cont) + 1).alias("_c"), F.lit(2 * p_cuts.index(nogo) + 1).alias("_g"),
            F.lit(2 * c_cuts.index(low) + 1).alias("_m"),
            F.lit(
                abs(cont - cfg.continue_max_risk) < 1e-9 and abs(nogo - cfg.nogo_min_risk) < 1e-9
                and abs(low - cfg.min_interval_confidence) < 1e-9
            ).alias("is_config_default"),
        )
        for cont, nogo, low in grid
    ])
    handed = cells.select("pc", "cc", "k", F.inline(points))
    sure = F.col("cc") >= F.col("_m")
    calm, risky = F.col("pc") <= F.col("_c"), F.col("pc") >= F.col("_g")
    names = ["continue_max_risk", "nogo_min_risk", "min_interval_confidence", "is_config_default"]
    counted = handed.groupBy(*names).agg(
        F.sum("k").alias("n"),
        F.coalesce(F.sum(F.when(sure & calm, F.col("k"))), F.lit(0)).alias("continue_n"),
        F.coalesce(F.sum(F.when(sure & risky & ~calm, F.col("k"))), F.lit(0)).alias("nogo_n"),
    ).withColumn("review_n", F.col("n") - F.col("continue_n") - F.col("nogo_n"))
    return counted.withColumns({
        f"{side}_pct": pct(F.col(f"{side}_n"), F.col("n")) for side in ("continue", "review", "nogo")
    })


def dual_model_summary(scored: DataFrame) -> DataFrame:
    """One row comparing the with- and without-interval decisions.

    Expects with_recommendation, without_recommendation, with_p, without_p, with_loss,
    interval_confidence.
    """
    n = F.count(F.lit(1))
    agree = count_if(F.col("with_recommendation") == F.col("without_recommendation"))
    mix = [
        count_if(F.col(f"{side}_recommendation") == v).alias(f"{side}_{v.lower().replace('-', '')}")
        for side in ("with", "without") for v in ("Continue", "Review", "No-Go")
    ]
    return scored.agg(
        n.alias("n_customers"),
        F.round(agree / F.greatest(n, F.lit(1)), 4).alias("agreement_rate"),
        (n - agree).alias("n_disagree"),
        *mix,
        F.round(F.avg("with_p"), 4).alias("mean_p_with"),
        F.round(F.avg("without_p"), 4).alias("mean_p_without"),
        F.round(F.avg(F.col("with_p") - F.col("without_p")), 4).alias("mean_p_delta"),
        F.round(F.sum("with_loss"), 2).alias("total_expected_loss"),
        F.round(F.avg("interval_confidence"), 4).alias("mean_interval_confidence"),
    )
