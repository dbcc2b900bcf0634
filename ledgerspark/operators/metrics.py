"""Evaluation metrics over scored rows. Exact, and free of single-task sorts.

Rank metrics work on the table of distinct scores (see ranking); sums stay plain aggregates. Each
function returns a small DataFrame, one row per key (or one row).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.ranking import (
    ROWS_PER_RANGE, average_ranks, exact_quantiles, global_positions, running_totals,
)


def _class_totals(
    df: DataFrame, y: str, score: str, keys: Sequence[str], weight: Column | None, rows_per_range: int
) -> DataFrame:
    """Distinct scores with positive and negative weight, running upward."""
    w = F.lit(1.0) if weight is None else weight
    pos = F.when(F.col(y) == 1, w).otherwise(F.lit(0.0))
    neg = F.when(F.col(y) == 1, F.lit(0.0)).otherwise(w)
    return running_totals(df, score, {"pos": pos, "neg": neg}, keys, rows_per_range=rows_per_range)


def roc_auc(
    df: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = (), weight: Column | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Rank AUC with averaged ties; null when only one class is present."""
    t = _class_totals(df, y, score, keys, weight, rows_per_range)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("tot_pos") * F.col("tot_neg"))).alias("roc_auc")
    )


def pr_auc(
    df: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = (), weight: Column | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Average precision over distinct thresholds; null when only one class is present."""
    t = _class_totals(df, y, score, keys, weight, rows_per_range)
    hit = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    seen = hit + F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    value = F.sum(F.col("pos") * F.try_divide(hit, seen)) / F.max("tot_pos")
    both = F.max(F.col("tot_pos") * F.col("tot_neg")) > 0
    return t.groupBy(*keys).agg(F.when(both, value).alias("pr_auc"))


def curve_metrics(
    df: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = (), weight: Column | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """ROC-AUC and PR-AUC from one running table."""
    t = _class_totals(df, y, score, keys, weight, rows_per_range)
    below = F.col("cum_neg") - F.col("neg") + F.col("neg") / 2
    hit = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    seen = hit + F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    size = F.max(F.col("tot_pos") * F.col("tot_neg"))
    return t.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * below), size).alias("roc_auc"),
        F.when(size > 0, F.sum(F.col("pos") * F.try_divide(hit, seen)) / F.max("tot_pos")).alias("pr_auc"),
    )


def brier(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(p - y))


def dollar_recall_at_k(
    df: DataFrame, dollars: str, score: str, k_frac: float, id_col: str = "id", keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Share of all dollars in the top ceil(k n) rows by score (at least one); null when there are none.

    Whole score groups above the cut are added up; only the group at the cut is ordered by md5(id).
    """
    placed = global_positions(
        df.select(*keys, id_col, score, dollars), score, id_col, keys=keys, rows_per_range=rows_per_range
    )
    top = F.col("position") <= F.greatest(F.lit(1), F.ceil(F.lit(k_frac) * F.col("n_rows")))
    total = F.sum(dollars)
    recall = F.when(total > 0, F.coalesce(F.sum(F.when(top, F.col(dollars))), F.lit(0.0)) / total)
    return placed.groupBy(*keys).agg(recall.alias("recall"), (recall * 100).alias("recall_pct"))


def calibration_bins(df: DataFrame, y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    """Mean prediction, observed rate and count in equal-width bins; empty bins are listed."""
    inner = [i / n_bins for i in range(1, n_bins)]
    at = sum((F.when(F.col(p) >= edge, 1).otherwise(0) for edge in inner), F.lit(0))
    bins = df.filter(F.col(p).isNotNull()).groupBy(at.alias("bin")).agg(
        F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate"),
        F.count(F.lit(1)).alias("count"),
    )
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(bins, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def regression_metrics(
    df: DataFrame, truth: str, pred: str, keys: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """MAE, RMSE, R2, Spearman and n over rows where both sides are known.

    Pairs are grouped before the two ranks are joined on, so repeated pairs cost one row.
    """
    t, p = F.col(truth), F.col(pred)
    known = df.filter(t.isNotNull() & p.isNotNull() & ~F.isnan(t.cast("double")) & ~F.isnan(p.cast("double")))
    n = F.count(F.lit(1))
    base = known.groupBy(*keys).agg(
        F.avg(F.abs(p - t)).alias("mae"),
        F.sqrt(F.avg((p - t) * (p - t))).alias("rmse"),
        F.when(n > 1, F.lit(1.0) - F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * n)).alias("r2"),
        n.alias("n"),
    )
    pairs = known.groupBy(*keys, truth, pred).agg(F.count(F.lit(1)).alias("w"))
    # Average ranks of n rows always have mean (n + 1) / 2. Taken off each rank, it keeps the sums small and exact for any n.
    centred = F.col("avg_rank") - (F.col("n_valid") + 1) / F.lit(2.0)
    rt = average_ranks(pairs, truth, keys, F.col("w"), rows_per_range).select(*keys, truth, centred.alias("_rt"))
    rp = average_ranks(pairs, pred, keys, F.col("w"), rows_per_range).select(*keys, pred, centred.alias("_rp"))
    ranked = pairs.join(rt, [*keys, truth]).join(rp, [*keys, pred])
    w, a, b = F.col("w"), F.col("_rt"), F.col("_rp")
    cov, va, vb = F.sum(w * a * b), F.sum(w * a * a), F.sum(w * b * b)
    rank_corr = ranked.groupBy(*keys).agg(
        F.when(F.sum(w) > 1, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb))).alias("spearman")
    )
    if keys:
        return base.join(rank_corr, list(keys), "left")
    return base.withColumn("spearman", rank_corr.scalar())


def lift_table(
    df: DataFrame, truth: str, pred: str, id_col: str = "id", n_bins: int = 10, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Near-equal bins by prediction, best first (larger bins first), with lift over the global mean."""
    known = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(id_col, truth, pred)
    placed = global_positions(known, pred, id_col, rows_per_range=rows_per_range)
    n, at = F.col("n_rows"), F.col("position") - 1
    bins = F.least(F.lit(n_bins), n)
    size, spare = F.floor(n / bins), n % bins
    edge = spare * (size + 1)
    number = F.when(at < edge, F.floor(at / (size + 1)) + 1).otherwise(F.floor((at - edge) / size) + spare + 1)
    overall = known.agg(F.avg(truth)).scalar()
    return placed.groupBy(number.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(pred).alias("mean_pred"), F.avg(truth).alias("mean_actual")
    ).withColumn("lift", F.when(F.abs(overall) > 1e-9, F.col("mean_actual") / overall))


def band_capture(
    df: DataFrame, truth: str, pred: str, top: float = 0.70, bottom: float = 0.30, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Share of the true top and bottom found by the predicted top and bottom, with counts."""
    known = df.filter(F.col(truth).isNotNull() & F.col(pred).isNotNull()).select(truth, pred)
    cut = {}
    for tag, c in (("t", truth), ("p", pred)):
        q = exact_quantiles(known, c, {"hi": top, "lo": bottom}, rows_per_range=rows_per_range)
        packed = q.select(F.struct("hi", "lo").alias("q")).scalar()
        cut[tag] = packed
    th, tl = F.col(truth) >= cut["t"]["hi"], F.col(truth) <= cut["t"]["lo"]
    ph, pl = F.col(pred) >= cut["p"]["hi"], F.col(pred) <= cut["p"]["lo"]
    count = lambda cond: F.count(F.when(cond, F.lit(1)))
    return known.agg(
        F.try_divide(count(th & ph), count(th)).alias("top_capture_rate"),
        F.try_divide(count(tl & pl), count(tl)).alias("bottom_capture_rate"),
        count(th).alias("n_true_top"), count(tl).alias("n_true_bottom"),
        count(ph).alias("n_pred_top"), count(pl).alias("n_pred_bottom"),
    )


def compare_models(folds: DataFrame) -> DataFrame:
    """(model_type, fold, mae, rmse, r2, spearman, n) -> mean and population std per model, best MAE first."""
    aggs = []
    for m in ("mae", "rmse", "r2", "spearman"):
        aggs += [F.round(F.avg(m), 5).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 5).alias(f"{m}_std")]
    return folds.groupBy("model_type").agg(
        *aggs, F.count(F.lit(1)).alias("n_folds"), F.sum("n").alias("n_rows")
    ).orderBy("mae_mean")


def suggest_model(comparison: DataFrame) -> DataFrame:
    """Winner per metric, the recommended model, the gap to the second, and a near-tie flag under 2 %."""
    name = F.col("model_type")
    order = F.array_sort(F.collect_list(F.struct("mae_mean", (-F.col("spearman_mean")).alias("s"), name.alias("model"), "mae_std")))
    one = comparison.agg(
        F.min_by(name, "mae_mean").alias("best_mae"), F.min_by(name, "rmse_mean").alias("best_rmse"),
        F.max_by(name, "r2_mean").alias("best_r2"), F.max_by(name, "spearman_mean").alias("best_spearman"),
        # One row per trained model: a handful.
        order.alias("o"),
    )
    first, second = F.col("o")[0], F.get(F.col("o"), F.lit(1))
    gap = F.when(first["mae_mean"] != 0, (second["mae_mean"] - first["mae_mean"]) / F.abs(first["mae_mean"]) * 100).otherwise(F.lit(0.0))
    near = F.coalesce(gap < 2.0, F.lit(False))
    reason = F.concat(
        F.format_string(
            "%s is recommended: best mae_mean=%.5f (±%.5f), spearman_mean=%.5f.",
            first["model"], first["mae_mean"], first["mae_std"], -first["s"]),
        F.when(near, F.format_string(" Near-tie with %s (mae_mean gap %.2f%%).", second["model"], gap)).otherwise(F.lit("")),
    )
    return one.select(
        first["model"].alias("best_model"), reason.alias("reason"), "best_mae", "best_rmse", "best_r2", "best_spearman",
        second["model"].alias("runner_up"), F.round(gap, 4).alias("gap_pct"), near.alias("near_tie"),
    )


def residual_summary(df: DataFrame, id_col: str, truth: str, pred: str) -> DataFrame:
    """id, truth, out-of-fold prediction, residual and absolute error, largest errors first."""
    return df.select(
        F.col(id_col), F.col(truth).alias("true_score"), F.col(pred).alias("oof_pred"),
        (F.col(pred) - F.col(truth)).alias("residual"), F.abs(F.col(pred) - F.col(truth)).alias("abs_error"),
    ).orderBy(F.col("abs_error").desc_nulls_last(), id_col)
