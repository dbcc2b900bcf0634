"""Invoices -> billing events -> interval diagnostics, features and churn labels.

Any number of snapshots is one pass: the gap to the previous event does not depend on the snapshot,
so gaps are found once per customer, and each row is then handed to the snapshots it lies before.
The window, the explode and the grouped aggregation all keep the hash partitioning on the customer.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.config import ChurnConfig, IntervalConfig
from ledgerspark.functions.numeric import clip, safe_div

CUSTOMER, DATE = "customerid", "date"

# Interval classes in one-hot order.
INTERVAL_CLASSES = (
    "insufficient_history", "one_time_candidate", "monthly", "quarterly",
    "semi_annual", "annual", "mixed", "irregular",
)
CORE_FEATURES = (
    "recency_days", "tenure_days", "n_events", "n_events_past12", "total_amount",
    "past12_amount", "prior12_amount", "mean_amount", "last_amount", "max_amount",
    "n_invoices_total", "revenue_trend", "amount_cv",
)
GAP_FEATURES = ("median_gap_days", "gap_cv", "n_gaps")
INTERVAL_FEATURES = ("interval_confidence", "dominant_share", "n_distinct_bases") + tuple(
    f"is_{c}" for c in INTERVAL_CLASSES
)
LABEL_COLUMNS = ("y_churn", "y_loss", "dollar_at_risk", "past_rev", "future_rev")
FEATURE_SETS = {
    "core": CORE_FEATURES,
    "core_interval": CORE_FEATURES + INTERVAL_FEATURES,
    "core_gap": CORE_FEATURES + GAP_FEATURES,
    "core_gap_interval": CORE_FEATURES + GAP_FEATURES + INTERVAL_FEATURES,
}


def feature_columns() -> tuple[str, ...]:
    return CORE_FEATURES + GAP_FEATURES + INTERVAL_FEATURES


def same_day_events(invoices: DataFrame) -> DataFrame:
    """One row per (customer, date). Partial sums on the map side keep a busy customer small."""
    return invoices.groupBy(CUSTOMER, DATE).agg(
        F.sum("amount").alias("event_amount"), F.count(F.lit(1)).alias("n_invoices")
    )


def historical_only(events: DataFrame, snapshot: dt.date) -> DataFrame:
    return events.filter(F.to_date(DATE) < F.lit(snapshot))


def hand_to_snapshots(events: DataFrame, snapshots: Sequence[dt.date]) -> DataFrame:
    """Each event once per later snapshot. Row-local: no join, and hash partitioning on the customer is kept."""
    later = F.filter(F.array(*[F.lit(s) for s in snapshots]), lambda s: F.to_date(DATE) < s)
    return events.withColumn("snapshot_date", F.explode(later))


def classify_gap(gap: Column, cfg: IntervalConfig = IntervalConfig()) -> Column:
    """Base whose nearest whole multiple has the least relative error within the tolerance, else null."""
    sign = 1 if cfg.prefer == "shortest" else -1
    options = []
    for name, days in cfg.bases:
        fitted = F.greatest(F.rint(gap / F.lit(float(days))), F.lit(1.0)) * days
        options.append(F.struct(
            (F.abs(gap - fitted) / fitted).alias("err"),
            F.lit(sign * days).alias("order"),
            F.lit(name).alias("name"),
        ))
    best = F.array_min(F.array(*options))
    return F.when(best["err"] <= cfg.match_tolerance, best["name"])


def _between(events: DataFrame, first: dt.date | None, end: dt.date) -> DataFrame:
    """Only the dates any snapshot can use. On the grouping key, so it reaches the scan."""
    day = F.to_date(DATE)
    events = events.filter(day < F.lit(end))
    return events if first is None else events.filter(day >= F.lit(first))


def customer_days(events: DataFrame, daily: bool = False) -> DataFrame:
    """Events folded to the calendar day: counts and mergeable amount moments.

    A customer then has at most one row per day, which bounds every per-customer window, whatever
    share of the events one customer holds. daily=True says the events are keyed by a DATE already,
    so there is nothing to fold and no extra shuffle.
    """
    amount = F.col("event_amount")
    if daily:
        return events.select(
            CUSTOMER,
            F.col(DATE).alias("d"),
            F.lit(1).cast("bigint").alias("k"),
            amount.alias("amount"),
            amount.alias("mean"),
            F.lit(0.0).alias("m2"),
            amount.alias("top"),
            amount.alias("latest"),
            F.col("n_invoices").alias("lines"),
        )
    return events.groupBy(CUSTOMER, F.to_date(DATE).alias("d")).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(amount).alias("amount"),
        F.avg(amount).alias("mean"),
        (F.var_pop(amount) * F.count(amount)).alias("m2"),
        F.max(amount).alias("top"),
        F.max_by(amount, F.col(DATE)).alias("latest"),
        F.sum("n_invoices").alias("lines"),
    )


def event_gaps(events: DataFrame, daily: bool = False) -> DataFrame:
    """(customer, event day, gap in days, times). Events sharing a day add gaps of zero."""
    w = Window.partitionBy(CUSTOMER).orderBy("d")
    stepped = customer_days(events, daily).select(
        CUSTOMER, F.col("d").alias("event_date"), "k", F.date_diff("d", F.lag("d").over(w)).alias("step")
    )
    one = F.struct(F.col("step").alias("gap_days"), F.lit(1).cast("bigint").alias("times"))
    zero = F.struct(F.lit(0).alias("gap_days"), (F.col("k") - 1).alias("times"))
    pieces = F.array_compact(
        F.array(F.when(F.col("step").isNotNull(), one), F.when(F.col("k") > 1, zero))
    )
    return stepped.select(CUSTOMER, "event_date", F.inline(pieces))


def core_sums(past: Column, recent: Column, prior: Column) -> dict[str, Column]:
    """Conditional revenue sums over day rows; an empty window is 0."""
    zero = F.lit(0.0)
    return {
        "total_amount": F.sum(F.when(past, F.col("amount"))),
        "max_amount": F.max(F.when(past, F.col("top"))),
        "last_amount": F.max_by(F.when(past, F.col("latest")), F.when(past, F.col("d"))),
        "n_invoices_total": F.sum(F.when(past, F.col("lines"))),
        "past12_amount": F.coalesce(F.sum(F.when(recent, F.col("amount"))), zero),
        "n_events_past12": F.coalesce(F.sum(F.when(recent, F.col("k"))), F.lit(0)),
        "prior12_amount": F.coalesce(F.sum(F.when(prior, F.col("amount"))), zero),
    }


def _windows(churn: ChurnConfig) -> tuple[Column, Column, Column, Column]:
    snap, d, width = F.col("snapshot_date"), F.col("d"), churn.outcome_window_days
    past = d < snap
    recent = past & (d >= F.date_sub(snap, width))
    prior = (d >= F.date_sub(snap, 2 * width)) & (d < F.date_sub(snap, width))
    future = (d >= snap) & (d < F.date_add(snap, width + churn.grace_days))
    return past, recent, prior, future


def _trend() -> Column:
    return F.when(F.col("prior12_amount") > 0, F.col("past12_amount") / F.col("prior12_amount"))


def core_features(
    events: DataFrame, snapshots: Sequence[dt.date], churn: ChurnConfig = ChurnConfig(), daily: bool = False
) -> DataFrame:
    """Revenue, frequency and trend features per (customer, snapshot), from earlier events only."""
    past, recent, prior, _ = _windows(churn)
    per = customer_days(_between(events, None, max(snapshots)), daily).withColumn(
        "snapshot_date", F.explode(F.array(*[F.lit(s) for s in snapshots]))
    ).filter(past)
    sums = core_sums(past, recent, prior)
    return (
        per.groupBy(CUSTOMER, "snapshot_date")
        .agg(
            *[c.alias(name) for name, c in sums.items()],
            (F.sum("amount") / F.sum("k")).alias("mean_amount"),
        )
        .withColumn("revenue_trend", _trend())
    )


def churn_labels(
    events: DataFrame, snapshots: Sequence[dt.date], churn: ChurnConfig = ChurnConfig(), daily: bool = False
) -> DataFrame:
    """Dollar-churn labels of customers with revenue in the year before the snapshot."""
    _, recent, _, future = _windows(churn)
    width = dt.timedelta(days=churn.outcome_window_days)
    used = _between(
        events, min(snapshots) - width, max(snapshots) + width + dt.timedelta(days=churn.grace_days))
    per = customer_days(used, daily).withColumn(
        "snapshot_date", F.explode(F.array(*[F.lit(s) for s in snapshots]))
    ).filter(recent | future)
    sums = per.groupBy(CUSTOMER, "snapshot_date").agg(
        F.coalesce(F.sum(F.when(recent, F.col("amount"))), F.lit(0.0)).alias("past_rev"),
        F.coalesce(F.sum(F.when(future, F.col("amount"))), F.lit(0.0)).alias("future_rev"),
    )
    return with_labels(sums, churn).select(CUSTOMER, "snapshot_date", *LABEL_COLUMNS)


def with_labels(sums: DataFrame, churn: ChurnConfig = ChurnConfig()) -> DataFrame:
    past, future = F.col("past_rev"), F.col("future_rev")
    return sums.filter(past > 0).withColumns({
        "y_loss": clip(past - future, 0.0),
        "y_churn": (future < F.lit(churn.drop_threshold) * past).cast("int"),
        "dollar_at_risk": past,
    })


def interval_features(
    events: DataFrame,
    snapshots: Sequence[dt.date],
    cfg: IntervalConfig = IntervalConfig(),
    churn: ChurnConfig = ChurnConfig(),
    daily: bool = False,
) -> DataFrame:
    """Interval diagnostics, core features and both revenue windows per (customer, snapshot).

    One window and one grouped aggregation over the customer's days. Rows exist for customers with
    history before the snapshot; later revenue only reaches future_rev, which feeds the labels.
    """
    w = Window.partitionBy(CUSTOMER).orderBy("d")
    ahead = dt.timedelta(days=churn.outcome_window_days + churn.grace_days)
    days = customer_days(_between(events, None, max(snapshots) + ahead), daily).withColumns({
        "step": F.date_diff("d", F.lag("d").over(w)).cast("double"),
        "pivot": F.first("mean").over(w),
    })
    days = days.withColumn("base", classify_gap(F.col("step"), cfg))
    snaps = F.array(*[F.lit(s) for s in snapshots])
    if daily:
        per = days.withColumn("snapshot_date", F.explode(snaps)).withColumns({
            "gap": F.col("step"), "times": F.lit(1).cast("bigint"), "main": F.lit(True),
        })
    else:
        # A day with several events also carries its zero gaps, as a second weighted row.
        def handed(s: Column) -> Column:
            row = lambda gap, times, main: F.struct(
                s.alias("snapshot_date"), gap.alias("gap"), times.alias("times"), F.lit(main).alias("main")
            )
            first = row(F.col("step"), F.lit(1).cast("bigint"), True)
            zeros = row(F.lit(0.0), F.col("k") - 1, False)
            return F.when(F.col("k") > 1, F.array(first, zeros)).otherwise(F.array(first))

        per = days.select("*", F.inline(F.flatten(F.transform(snaps, handed))))
    past, recent, prior, future = _windows(churn)
    main = F.col("main")
    per = per.filter(past | (main & future))
    past_main, recent, prior, future = past & main, recent & main, prior & main, future & main
    k = F.when(past_main, F.col("k"))
    n = F.sum(k)
    shift = F.col("mean") - F.col("pivot")
    moved = F.sum(k * shift)
    around = F.sum(F.when(past_main, F.col("m2") + F.col("k") * shift * shift))
    gap = F.when(past, F.col("gap"))
    times = F.when(past & F.col("gap").isNotNull(), F.col("times"))
    stats = per.withColumns({"_gap": gap, "_times": F.coalesce(times, F.lit(1))}).groupBy(
        CUSTOMER, "snapshot_date"
    ).agg(
        n.alias("n_events"),
        F.min(F.when(past_main, F.col("d"))).alias("first_date"),
        F.max(F.when(past_main, F.col("d"))).alias("last_date"),
        (F.max(F.when(past_main, F.col("pivot"))) + moved / n).alias("mean_amount"),
        F.greatest(around - moved * moved / n, F.lit(0.0)).alias("_amount_m2"),
        F.coalesce(F.sum(times), F.lit(0)).alias("n_gaps"),
        F.sum(F.col("_gap") * times).alias("_gap_sum"),
        F.sum(F.col("_gap") * F.col("_gap") * times).alias("_gap_sq"),
        F.expr("percentile(_gap, 0.5, _times)").alias("median_gap_days"),
        *[
            F.count(F.when(past_main & (F.col("base") == name), F.lit(1))).alias(f"_c_{name}")
            for name, _ in cfg.bases
        ],
        *[c.alias(name) for name, c in core_sums(past_main, recent, prior).items()],
        F.coalesce(F.sum(F.when(future, F.col("amount"))), F.lit(0.0)).alias("future_rev"),
    )
    counts = F.array(*[
        F.struct(F.col(f"_c_{name}").alias("c"), F.lit(-days_).alias("short"), F.lit(name).alias("name"))
        for name, days_ in cfg.bases
    ])
    best, hits = F.array_max(counts), sum((F.col(f"_c_{name}") for name, _ in cfg.bases), F.lit(0))
    gap_var = (F.col("_gap_sq") - F.col("_gap_sum") * F.col("_gap_sum") / F.col("n_gaps")) / (F.col("n_gaps") - 1)
    amount_std = F.when(F.col("n_events") > 1, F.sqrt(F.col("_amount_m2") / (F.col("n_events") - 1)))
    gap_std = F.when(F.col("n_gaps") > 1, F.sqrt(F.greatest(gap_var, F.lit(0.0))))
    out = (
        stats.filter(F.col("n_events") > 0)
        .withColumns({
            "days_since_last": F.date_diff("snapshot_date", "last_date"),
            "tenure_days": F.date_diff("last_date", "first_date"),
            "amount_cv": F.coalesce(safe_div(amount_std, F.col("mean_amount")), F.lit(0.0)),
            "gap_cv": F.when(F.col("n_gaps") > 1, safe_div(gap_std, F.col("_gap_sum") / F.col("n_gaps"))),
            "dominant_base": F.when(best["c"] > 0, best["name"]),
            "dominant_share": F.when(hits > 0, best["c"] / hits).otherwise(F.lit(0.0)),
            "n_distinct_bases": sum(
                ((F.col(f"_c_{name}") > 0).cast("bigint") for name, _ in cfg.bases), F.lit(0).cast("bigint")
            ),
            "revenue_trend": _trend(),
        })
        .drop("_amount_m2", "_gap_sum", "_gap_sq", *[f"_c_{name}" for name, _ in cfg.bases])
    )
    return interval_label_confidence(out, cfg)


def interval_label_confidence(stats: DataFrame, cfg: IntervalConfig = IntervalConfig()) -> DataFrame:
    """Interval class and confidence from the per-customer statistics."""
    zero = F.lit(0.0)
    silence = F.col("days_since_last").cast("double")
    horizon = float(cfg.one_time_horizon_days)
    share = F.coalesce(F.col("dominant_share"), zero)
    single = F.col("n_events") <= 1
    based = F.col("dominant_base").isNotNull()
    mixed = based & (F.col("n_distinct_bases") >= 2) & (share < cfg.mixed_dominant_share_max)
    regular = clip(F.lit(1.0) - F.coalesce(F.col("gap_cv"), zero) / cfg.max_gap_cv, 0.0, 1.0)
    blend = (
        F.lit(0.40) * (F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.coalesce(F.col("n_gaps"), zero)))
        + F.lit(0.30) * regular
        + F.lit(0.15) * clip(F.lit(1.0) - F.coalesce(F.col("amount_cv"), zero), 0.0, 1.0)
        + F.lit(0.15) * clip(F.coalesce(F.col("tenure_days"), zero) / 365.0, 0.0, 1.0)
    )
    matched = clip(blend * share, 0.0, 1.0)
    label = (
        F.when(single & (silence >= horizon), F.lit("one_time_candidate"))
        .when(single, F.lit("insufficient_history"))
        .when(mixed, F.lit("mixed"))
        .when(based, F.col("dominant_base"))
        .otherwise(F.lit("irregular"))
    )
    confidence = (
        F.when(single & (silence >= horizon), clip(silence / (2.0 * horizon), 0.5, 0.95))
        .when(single, clip(F.lit(0.5) * silence / horizon, 0.0, 0.5))
        .when(mixed, F.lit(0.7) * matched)
        .when(based, matched)
        .otherwise(clip(F.lit(0.3) * regular, 0.05, 0.4))
    )
    return stats.withColumns({
        "billing_interval": label, "interval_confidence": F.rint(confidence * 10000.0) / 10000.0,
    })


DIAGNOSTICS = (
    "billing_interval", "interval_confidence", "n_events", "n_gaps", "median_gap_days", "gap_cv",
    "amount_cv", "days_since_last", "tenure_days", "dominant_base", "dominant_share", "n_distinct_bases",
)


def infer_intervals(
    events: DataFrame, snapshots: Sequence[dt.date], cfg: IntervalConfig = IntervalConfig(), daily: bool = False
) -> DataFrame:
    """Billing interval, confidence and diagnostics per (customer, snapshot)."""
    full = interval_features(_between(events, None, max(snapshots)), snapshots, cfg, daily=daily)
    return full.select(CUSTOMER, "snapshot_date", *DIAGNOSTICS)


def one_hots(df: DataFrame) -> DataFrame:
    return df.withColumns({
        f"is_{c}": (F.col("billing_interval") == c).cast("int") for c in INTERVAL_CLASSES
    })


def build_churn_matrix(
    events: DataFrame,
    snapshots: Sequence[dt.date],
    cfg: IntervalConfig = IntervalConfig(),
    churn: ChurnConfig = ChurnConfig(),
    daily: bool = False,
) -> DataFrame:
    """Features and labels of the cohort (history and positive past revenue), all snapshots at once.

    Labels, core and interval features share the key, so they come from one aggregation, not joins.
    """
    full = interval_features(events, snapshots, cfg, churn, daily)
    labelled = with_labels(full.withColumn("past_rev", F.col("past12_amount")), churn)
    return one_hots(labelled.withColumn("recency_days", F.col("days_since_last"))).select(
        CUSTOMER, "snapshot_date", "billing_interval", *LABEL_COLUMNS, *feature_columns(),
        "dominant_base",
    )


def build_scoring_features(
    invoices: DataFrame,
    snapshots: Sequence[dt.date],
    cfg: IntervalConfig = IntervalConfig(),
    churn: ChurnConfig = ChurnConfig(),
    daily: bool = False,
) -> DataFrame:
    """The same features for raw invoices, without labels and without the cohort filter."""
    past = _between(invoices, None, max(snapshots))
    full = interval_features(same_day_events(past), snapshots, cfg, churn, daily)
    return one_hots(full.withColumn("recency_days", F.col("days_since_last"))).select(
        CUSTOMER, "snapshot_date", "billing_interval", *feature_columns(), "dominant_base",
    )


def stack_snapshots(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; columns missing from a frame become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def interval_summary(intervals: DataFrame) -> DataFrame:
    """Class counts and mean confidence per snapshot."""
    return intervals.groupBy("snapshot_date", "billing_interval").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("interval_confidence").alias("mean_confidence")
    )


def cohort_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("snapshot_date").agg(
        F.count(F.lit(1)).alias("cohort"),
        F.avg("y_churn").alias("churn_rate"),
        F.avg("y_loss").alias("mean_dollar_loss"),
        F.sum("dollar_at_risk").alias("total_dollars_at_risk"),
    )


def cadence_backtest(events: DataFrame, cfg: IntervalConfig = IntervalConfig(), daily: bool = False) -> DataFrame:
    """Hold out each customer's last event day and predict it as the day before plus the base period.

    Returns the mean and median absolute error in days per inferred class. The held-out day serves
    as the customer's own snapshot, so everything is one window over the customer's days.
    """
    days = customer_days(events, daily)
    w = Window.partitionBy(CUSTOMER).orderBy("d")
    stepped = days.withColumns({
        "step": F.date_diff("d", F.lag("d").over(w)).cast("double"),
        "is_last": F.lead("d").over(w).isNull(),
        "pivot": F.first("mean").over(w),
    }).withColumn("base", classify_gap(F.col("step"), cfg))
    kept = ~F.col("is_last")
    k = F.when(kept, F.col("k"))
    n, shift = F.sum(k), F.col("mean") - F.col("pivot")
    moved = F.sum(k * shift)
    step = F.when(kept, F.col("step"))
    stats = stepped.groupBy(CUSTOMER).agg(
        n.alias("n_events"),
        F.min(F.when(kept, F.col("d"))).alias("first_date"),
        F.max(F.when(kept, F.col("d"))).alias("last_date"),
        F.max("d").alias("held_out"),
        F.count(step).alias("n_gaps"),
        F.avg(step).alias("gap_mean"),
        F.stddev_samp(step).alias("gap_std"),
        (F.max("pivot") + moved / n).alias("amount_mean"),
        F.greatest(
            F.sum(F.when(kept, F.col("m2") + F.col("k") * shift * shift)) - moved * moved / n, F.lit(0.0)
        ).alias("amount_m2"),
        *[F.count(F.when(kept & (F.col("base") == name), F.lit(1))).alias(f"c_{name}") for name, _ in cfg.bases],
    ).filter(F.col("n_events") > 0)
    counts = F.array(*[
        F.struct(F.col(f"c_{name}").alias("c"), F.lit(-length).alias("short"), F.lit(name).alias("name"))
        for name, length in cfg.bases
    ])
    best, hits = F.array_max(counts), sum((F.col(f"c_{name}") for name, _ in cfg.bases), F.lit(0))
    std = F.when(F.col("n_events") > 1, F.sqrt(F.col("amount_m2") / (F.col("n_events") - 1)))
    ready = stats.withColumns({
        "days_since_last": F.date_diff("held_out", "last_date"),
        "tenure_days": F.date_diff("last_date", "first_date"),
        "amount_cv": F.coalesce(safe_div(std, F.col("amount_mean")), F.lit(0.0)),
        "gap_cv": safe_div(F.col("gap_std"), F.col("gap_mean")),
        "dominant_base": F.when(best["c"] > 0, best["name"]),
        "dominant_share": F.when(hits > 0, best["c"] / hits).otherwise(F.lit(0.0)),
        "n_distinct_bases": sum(
            ((F.col(f"c_{name}") > 0).cast("bigint") for name, _ in cfg.bases), F.lit(0).cast("bigint")
        ),
    })
    length = F.coalesce(*[F.when(F.col("dominant_base") == name, F.lit(days_)) for name, days_ in cfg.bases])
    missed = interval_label_confidence(ready, cfg).filter(F.col("dominant_base").isNotNull()).withColumn(
        "abs_error", F.abs(F.date_diff("held_out", F.date_add("last_date", length)))
    )
    # Errors are whole days: the grouped counts stay small and give an exact weighted median.
    return missed.groupBy("billing_interval").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("abs_error").alias("mean_abs_error"),
        F.percentile("abs_error", 0.5).alias("median_abs_error"),
    )
