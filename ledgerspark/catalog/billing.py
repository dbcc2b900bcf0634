"""Billing queries: invoices, events, intervals, features, labels, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.catalog.registry import query
from ledgerspark.functions.numeric import rounded
from ledgerspark.operators import billing as B
from ledgerspark.sources import domain as D
from ledgerspark.sources import invoices as I

INVOICES_SQL = """
invoices AS (SELECT CAST(o_custkey AS VARCHAR) AS customerid, CAST(o_custkey % 25 AS VARCHAR) AS accountid,
  o_totalprice AS amount, CAST(o_orderdate AS DATE) AS date FROM orders)"""

EVENTS_SQL = INVOICES_SQL + """,
events_d AS (SELECT customerid, date, sum(amount) AS event_amount, count(*) AS n_invoices
  FROM invoices GROUP BY customerid, date)"""

SNAPS_SQL = """
snaps AS (SELECT DATE '1999-06-01' AS snapshot_date UNION ALL SELECT DATE '2000-06-01')"""

BASES_SQL = """
bases(bname, days) AS (VALUES ('monthly', 30), ('quarterly', 91), ('semi_annual', 182), ('annual', 365))"""

GAPS_SQL = """
gaps AS (SELECT * FROM (SELECT customerid, date AS d,
    date_diff('day', lag(date) OVER (PARTITION BY customerid ORDER BY date), date) AS gap FROM events_d)
  WHERE gap IS NOT NULL),
gap_err AS (SELECT customerid, d, gap, bname, days,
    abs(gap - greatest(round_even(gap / days, 0), 1) * days) / (greatest(round_even(gap / days, 0), 1) * days) AS err
  FROM gaps, bases),
gap_best AS (SELECT customerid, d, gap, arg_min(bname, (err, days)) AS bname, min(err) AS err
  FROM gap_err GROUP BY customerid, d, gap),
gap_class AS (SELECT customerid, d, gap, CASE WHEN err <= 0.15 THEN bname END AS base FROM gap_best)"""

INTERVAL_SQL = f"""{EVENTS_SQL}, {SNAPS_SQL}, {BASES_SQL}, {GAPS_SQL},
ev AS (SELECT customerid, snapshot_date, count(*) AS n_events, min(date) AS first_date, max(date) AS last_date,
    avg(event_amount) AS mean_amount, stddev_samp(event_amount) AS amount_std, sum(event_amount) AS total_amount,
    max(event_amount) AS max_amount, arg_max(event_amount, date) AS last_amount, sum(n_invoices) AS n_invoices_total,
    coalesce(sum(event_amount) FILTER (WHERE date >= snapshot_date - 365), 0) AS past12_amount,
    count(*) FILTER (WHERE date >= snapshot_date - 365) AS n_events_past12,
    coalesce(sum(event_amount) FILTER (WHERE date >= snapshot_date - 730 AND date < snapshot_date - 365), 0) AS prior12_amount
  FROM events_d, snaps WHERE date < snapshot_date GROUP BY customerid, snapshot_date),
gp AS (SELECT customerid, snapshot_date, count(*) AS n_gaps, median(gap) AS median_gap_days,
    avg(gap) AS gap_mean, stddev_samp(gap) AS gap_std FROM gap_class, snaps WHERE d < snapshot_date GROUP BY ALL),
bc AS (SELECT customerid, snapshot_date, base, count(*) AS c FROM gap_class, snaps
  WHERE d < snapshot_date AND base IS NOT NULL GROUP BY ALL),
bd AS (SELECT customerid, snapshot_date, arg_max(base, (c, -days)) AS dominant_base, max(c) / sum(c) AS dominant_share,
    count(*) AS n_distinct_bases FROM bc JOIN bases ON base = bname GROUP BY ALL),
st AS (SELECT ev.*, coalesce(n_gaps, 0) AS n_gaps, median_gap_days, gap_std / gap_mean AS gap_cv,
    coalesce(amount_std / mean_amount, 0) AS amount_cv, date_diff('day', last_date, snapshot_date) AS days_since_last,
    date_diff('day', first_date, last_date) AS tenure_days, dominant_base, coalesce(dominant_share, 0) AS dominant_share,
    coalesce(n_distinct_bases, 0) AS n_distinct_bases,
    CASE WHEN prior12_amount > 0 THEN past12_amount / prior12_amount END AS revenue_trend
  FROM ev LEFT JOIN gp USING (customerid, snapshot_date) LEFT JOIN bd USING (customerid, snapshot_date)),
cf AS (SELECT *, least(greatest(1 - coalesce(gap_cv, 0) / 0.5, 0), 1) AS regular,
    least(greatest((0.40 * (1 - 1.0 / (1 + n_gaps)) + 0.30 * least(greatest(1 - coalesce(gap_cv, 0) / 0.5, 0), 1)
     + 0.15 * least(greatest(1 - amount_cv, 0), 1) + 0.15 * least(tenure_days / 365.0, 1)) * dominant_share, 0), 1) AS matched,
    n_events <= 1 AS single FROM st),
iv AS (SELECT *,
    CASE WHEN single AND days_since_last >= 400 THEN 'one_time_candidate' WHEN single THEN 'insufficient_history'
      WHEN dominant_base IS NOT NULL AND n_distinct_bases >= 2 AND dominant_share < 0.8 THEN 'mixed'
      WHEN dominant_base IS NOT NULL THEN dominant_base ELSE 'irregular' END AS billing_interval,
    CASE WHEN single AND days_since_last >= 400 THEN least(greatest(days_since_last / 800.0, 0.5), 0.95)
      WHEN single THEN least(greatest(0.5 * days_since_last / 400.0, 0), 0.5)
      WHEN dominant_base IS NOT NULL AND n_distinct_bases >= 2 AND dominant_share < 0.8 THEN 0.7 * matched
      WHEN dominant_base IS NOT NULL THEN matched ELSE least(greatest(0.3 * regular, 0.05), 0.4) END AS raw_confidence
  FROM cf)"""

LABEL_SQL = """
lb AS (SELECT customerid, snapshot_date,
    coalesce(sum(event_amount) FILTER (WHERE date >= snapshot_date - 365 AND date < snapshot_date), 0) AS past_rev,
    coalesce(sum(event_amount) FILTER (WHERE date >= snapshot_date AND date < snapshot_date + 395), 0) AS future_rev
  FROM events_d, snaps GROUP BY ALL)"""


def daily_events(spark, sf):
    return B.same_day_events(D.invoices(spark, sf))


@query("normalize_invoices", """
SELECT CAST(o_custkey AS VARCHAR) AS customerid, o_orderdate AS date, o_totalprice AS amount
FROM orders WHERE o_totalprice > 0 AND o_custkey IS NOT NULL AND o_orderdate IS NOT NULL""")
def normalize_invoices(spark, sf):
    return I.normalize_invoices(D.raw_invoices(spark, sf))


@query("cap_customers", f"""WITH {INVOICES_SQL},
ids AS (SELECT customerid FROM invoices GROUP BY customerid HAVING count(DISTINCT date) >= 2 ORDER BY customerid LIMIT 500)
SELECT customerid, accountid, amount, date FROM invoices WHERE customerid IN (SELECT customerid FROM ids)""")
def cap_customers(spark, sf):
    capped = I.cap_customers(D.invoices(spark, sf), max_customers=500, recurring_only=True)
    return capped.frame


@query("load_invoices", """WITH src AS (SELECT CAST(o_custkey AS VARCHAR) AS customerid, o_orderdate AS date, o_totalprice AS amount FROM orders),
kept AS (SELECT * FROM src WHERE customerid IS NOT NULL AND date IS NOT NULL AND amount > 0)
SELECT customerid, round(sum(amount), 2) AS amount, count(*) AS n_rows, min(date) AS first_date FROM kept GROUP BY customerid""")
def load_invoices(spark, sf):
    loaded = I.load_invoices(spark, f"{sf}/orders.parquet", aliases=I.ORDER_ALIASES)
    return loaded.frame.groupBy("customerid").agg(
        F.round(F.sum("amount"), 2).alias("amount"), F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date")
    )


@query("cap_rows", f"""WITH {INVOICES_SQL}
SELECT customerid, date, amount FROM invoices ORDER BY customerid, date, amount LIMIT 2000""")
def cap_rows(spark, sf):
    return I.cap_rows(D.invoices(spark, sf).select("customerid", "date", "amount"), 2000)


@query("same_day_events", f"""WITH {EVENTS_SQL}
SELECT customerid, date, round(event_amount, 2) AS event_amount, n_invoices FROM events_d""")
def same_day_events(spark, sf):
    return rounded(daily_events(spark, sf), 2, ["event_amount"])


@query("historical_only", f"""WITH {EVENTS_SQL}
SELECT customerid, date, round(event_amount, 2) AS event_amount, n_invoices FROM events_d WHERE date < DATE '2000-06-01'""")
def historical_only(spark, sf):
    return rounded(B.historical_only(daily_events(spark, sf), D.AS_OF), 2, ["event_amount"])


@query("event_gaps", f"""WITH {EVENTS_SQL}, {BASES_SQL}, {GAPS_SQL}
SELECT customerid, d AS event_date, CAST(gap AS INT) AS gap_days FROM gaps""")
def event_gaps(spark, sf):
    return B.event_gaps(daily_events(spark, sf), daily=True).drop("times")


@query("classify_gap", f"""WITH {EVENTS_SQL}, {BASES_SQL}, {GAPS_SQL}
SELECT coalesce(base, 'none') AS base, count(*) AS gaps, CAST(min(gap) AS INT) AS shortest, CAST(max(gap) AS INT) AS longest
FROM gap_class GROUP BY 1""")
def classify_gap(spark, sf):
    gaps = B.event_gaps(daily_events(spark, sf), daily=True)
    return (
        gaps.withColumn("base", F.coalesce(B.classify_gap(F.col("gap_days")), F.lit("none")))
        .groupBy("base")
        .agg(F.count(F.lit(1)).alias("gaps"), F.min("gap_days").alias("shortest"), F.max("gap_days").alias("longest"))
    )


@query("infer_intervals", f"""WITH {INTERVAL_SQL}
SELECT customerid, snapshot_date, billing_interval, round_even(raw_confidence, 4) AS interval_confidence, n_events,
  n_gaps, round(median_gap_days, 2) AS median_gap_days, round(gap_cv, 8) AS gap_cv, round(amount_cv, 6) AS amount_cv,
  CAST(days_since_last AS INT) AS days_since_last, CAST(tenure_days AS INT) AS tenure_days, dominant_base,
  round(dominant_share, 6) AS dominant_share, n_distinct_bases FROM iv""")
def infer_intervals(spark, sf):
    return infer_rounded(spark, sf)


def infer_rounded(spark, sf):

    out = B.infer_intervals(daily_events(spark, sf), D.SNAPSHOTS, daily=True)
    out = rounded(rounded(out, 8, ["gap_cv"]), 6, ["amount_cv", "dominant_share"])
    return rounded(rounded(out, 2, ["median_gap_days"]), 4, ["interval_confidence"])


@query("interval_label_confidence", f"""WITH {INTERVAL_SQL}
SELECT billing_interval, snapshot_date, count(*) AS customers, round(min(round_even(raw_confidence, 4)), 4) AS lowest,
  round(max(round_even(raw_confidence, 4)), 4) AS highest FROM iv GROUP BY ALL""")
def interval_label_confidence(spark, sf):
    out = B.infer_intervals(daily_events(spark, sf), D.SNAPSHOTS, daily=True)
    out = out.groupBy("billing_interval", "snapshot_date").agg(
        F.count(F.lit(1)).alias("customers"), F.min("interval_confidence").alias("lowest"),
        F.max("interval_confidence").alias("highest"),
    )
    return rounded(out, 4, ["lowest", "highest"])


@query("snapshot_join", f"""WITH {EVENTS_SQL},
snaps AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-01-01', INTERVAL 1 YEAR))::DATE AS snapshot_date)
SELECT snapshot_date, customerid, count(*) AS n_events, round(sum(event_amount), 2) AS total_amount, max(date) AS last_date
FROM events_d, snaps WHERE date < snapshot_date GROUP BY ALL""")
def snapshot_join(spark, sf):
    import datetime as dt

    snaps = [dt.date(y, 1, 1) for y in range(1996, 2002)]
    handed = B.hand_to_snapshots(daily_events(spark, sf), snaps)
    return handed.groupBy("snapshot_date", "customerid").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum("event_amount"), 2).alias("total_amount"),
        F.max("date").alias("last_date"),
    )


@query("core_features", f"""WITH {INTERVAL_SQL}
SELECT customerid, snapshot_date, round(total_amount, 2) AS total_amount, round(mean_amount, 6) AS mean_amount,
  round(max_amount, 2) AS max_amount, round(last_amount, 2) AS last_amount, CAST(n_invoices_total AS BIGINT) AS n_invoices_total,
  round(past12_amount, 2) AS past12_amount, n_events_past12, round(prior12_amount, 2) AS prior12_amount,
  round(revenue_trend, 6) AS revenue_trend FROM iv""")
def core_features(spark, sf):
    out = B.core_features(daily_events(spark, sf), D.SNAPSHOTS, daily=True)
    out = rounded(out, 2, ["total_amount", "max_amount", "last_amount", "past12_amount", "prior12_amount"])
    return rounded(out, 6, ["mean_amount", "revenue_trend"])


@query("churn_labels", f"""WITH {EVENTS_SQL}, {SNAPS_SQL}, {LABEL_SQL}
SELECT customerid, snapshot_date, CAST(round(future_rev, 2) < 0.5 * round(past_rev, 2) AS INT) AS y_churn,
  round(greatest(past_rev - future_rev, 0), 2) AS y_loss, round(past_rev, 2) AS dollar_at_risk,
  round(past_rev, 2) AS past_rev, round(future_rev, 2) AS future_rev FROM lb WHERE past_rev > 0""")
def churn_labels(spark, sf):
    out = B.churn_labels(daily_events(spark, sf), D.SNAPSHOTS, daily=True)
    return rounded(out, 2, ["y_loss", "dollar_at_risk", "past_rev", "future_rev"])


MATRIX_SQL = f"""{INTERVAL_SQL}, {LABEL_SQL},
mx AS (SELECT * FROM lb JOIN iv USING (customerid, snapshot_date) WHERE past_rev > 0)"""

FEATURE_SELECT = """CAST(days_since_last AS INT) AS recency_days, CAST(tenure_days AS INT) AS tenure_days, n_events,
  n_events_past12, round(total_amount, 2) AS total_amount, round(past12_amount, 2) AS past12_amount,
  round(mean_amount, 6) AS mean_amount, round(amount_cv, 6) AS amount_cv,
  round(median_gap_days, 2) AS median_gap_days, n_gaps, round_even(raw_confidence, 4) AS interval_confidence,
  round(dominant_share, 6) AS dominant_share, CAST(billing_interval = 'monthly' AS INT) AS is_monthly,
  CAST(billing_interval = 'mixed' AS INT) AS is_mixed, CAST(billing_interval = 'irregular' AS INT) AS is_irregular"""
FEATURE_SHOWN = (
    "recency_days", "tenure_days", "n_events", "n_events_past12", "total_amount", "past12_amount", "mean_amount",
    "amount_cv", "median_gap_days", "n_gaps", "interval_confidence", "dominant_share", "is_monthly", "is_mixed",
    "is_irregular",
)


def shown_features(df):
    df = rounded(df, 2, ["total_amount", "past12_amount", "median_gap_days"])
    return rounded(rounded(df, 4, ["interval_confidence"]), 6, ["amount_cv", "dominant_share", "mean_amount"])


@query("build_churn_matrix", f"""WITH {MATRIX_SQL}
SELECT customerid, snapshot_date, CAST(round(future_rev, 2) < 0.5 * round(past_rev, 2) AS INT) AS y_churn,
  round(greatest(past_rev - future_rev, 0), 2) AS y_loss, {FEATURE_SELECT} FROM mx""")
def build_churn_matrix(spark, sf):
    out = B.build_churn_matrix(daily_events(spark, sf), D.SNAPSHOTS, daily=True)
    out = out.select("customerid", "snapshot_date", "y_churn", F.round("y_loss", 2).alias("y_loss"), *FEATURE_SHOWN)
    return shown_features(out)


@query("build_scoring_features", f"""WITH {INTERVAL_SQL}
SELECT customerid, snapshot_date, {FEATURE_SELECT} FROM iv""")
def build_scoring_features(spark, sf):
    out = B.build_scoring_features(D.invoices(spark, sf), D.SNAPSHOTS, daily=True)
    return shown_features(out.select("customerid", "snapshot_date", *FEATURE_SHOWN))


@query("stack_snapshots", f"""WITH {INTERVAL_SQL}
SELECT customerid, snapshot_date, billing_interval, CASE WHEN snapshot_date = DATE '2000-06-01' THEN n_events END AS n_events FROM iv""")
def stack_snapshots(spark, sf):
    events = daily_events(spark, sf)
    parts = [B.infer_intervals(events, [s], daily=True) for s in D.SNAPSHOTS]
    slim = [
        parts[0].select("customerid", "snapshot_date", "billing_interval"),
        parts[1].select("customerid", "snapshot_date", "billing_interval", "n_events"),
    ]
    return B.stack_snapshots(slim)


@query("snapshot_interval_summary", f"""WITH {INTERVAL_SQL}
SELECT snapshot_date, billing_interval, count(*) AS customers, round(avg(round_even(raw_confidence, 4)), 6) AS mean_confidence
FROM iv GROUP BY ALL""")
def snapshot_interval_summary(spark, sf):
    return rounded(
        B.interval_summary(B.infer_intervals(daily_events(spark, sf), D.SNAPSHOTS, daily=True)), 6, ["mean_confidence"]
    )


@query("snapshot_cohort_summary", f"""WITH {EVENTS_SQL}, {SNAPS_SQL}, {LABEL_SQL}
SELECT snapshot_date, count(*) AS cohort, round(avg(CAST(future_rev < 0.5 * past_rev AS INT)), 6) AS churn_rate,
  round(avg(greatest(past_rev - future_rev, 0)), 4) AS mean_dollar_loss, round(sum(past_rev), 2) AS total_dollars_at_risk
FROM lb WHERE past_rev > 0 GROUP BY 1""")
def snapshot_cohort_summary(spark, sf):
    out = B.cohort_summary(B.build_churn_matrix(daily_events(spark, sf), D.SNAPSHOTS, daily=True))
    out = rounded(rounded(out, 6, ["churn_rate"]), 4, ["mean_dollar_loss"])
    return rounded(out, 2, ["total_dollars_at_risk"])


@query("cadence_backtest", f"""WITH {EVENTS_SQL}, {BASES_SQL}, {GAPS_SQL},
lst AS (SELECT customerid, max(date) AS held_out FROM events_d GROUP BY 1),
ev AS (SELECT customerid, held_out, count(*) AS n_events, min(date) AS first_date, max(date) AS last_date,
    coalesce(stddev_samp(event_amount) / avg(event_amount), 0) AS amount_cv
  FROM events_d JOIN lst USING (customerid) WHERE date < held_out GROUP BY ALL),
gp AS (SELECT customerid, count(*) AS n_gaps FROM gap_class JOIN lst USING (customerid) WHERE d < held_out GROUP BY 1),
bc AS (SELECT customerid, base, count(*) AS c FROM gap_class JOIN lst USING (customerid) WHERE d < held_out AND base IS NOT NULL GROUP BY ALL),
bd AS (SELECT customerid, arg_max(base, (c, -days)) AS dominant_base, arg_max(days, (c, -days)) AS days, max(c) / sum(c) AS share,
    count(*) AS kinds FROM bc JOIN bases ON base = bname GROUP BY 1),
er AS (SELECT CASE WHEN n_events <= 1 THEN 'single' WHEN kinds >= 2 AND share < 0.8 THEN 'mixed' ELSE dominant_base END AS billing_interval,
    abs(date_diff('day', last_date + CAST(days AS INT), held_out)) AS err FROM ev JOIN bd USING (customerid))
SELECT billing_interval, count(*) AS customers, round(avg(err), 4) AS mean_abs_error, round(median(err), 2) AS median_abs_error
FROM er GROUP BY 1""")
def cadence_backtest(spark, sf):
    out = B.cadence_backtest(daily_events(spark, sf), daily=True)
    return rounded(rounded(out, 4, ["mean_abs_error"]), 2, ["median_abs_error"])
