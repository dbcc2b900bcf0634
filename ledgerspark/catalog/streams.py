"""Streaming queries: each reads a given table as a file stream, runs to the end, and reads its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.catalog.billing import EVENTS_SQL, INTERVAL_SQL
from ledgerspark.catalog.evaluation import PSI_TAIL
from ledgerspark.catalog.registry import query
from ledgerspark.operators import billing as B
from ledgerspark.operators import decision as DE
from ledgerspark.operators import drift as DR
from ledgerspark.session import materialise, new_scratch
from ledgerspark.sources import domain as D
from ledgerspark.streaming import streams as S


def invoice_stream(spark, sf):
    return S.stream_table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("customerid"), F.col("o_orderdate").cast("timestamp").alias("date"),
        F.col("o_totalprice").alias("amount"))


def invoice_parts(spark, sf, parts=3):
    """The same rows over several micro-batches, customers split between them."""
    lines = D.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("customerid"), F.col("o_orderdate").cast("timestamp").alias("date"),
        F.col("o_totalprice").alias("amount"))
    return S.stream_in_parts(lines, parts)


@query("stream_same_day_events", f"""WITH {EVENTS_SQL} SELECT customerid, date, round(event_amount, 2) AS event_amount, n_invoices FROM events_d""")
def stream_same_day_events(spark, sf):
    out = S.run(S.same_day_events(invoice_stream(spark, sf)), new_scratch(spark, "daily"), "update")
    return S.latest(out, ["customerid", "date"]).withColumn("event_amount", F.round("event_amount", 2))


def stand_in_scorer(batch):
    """Batch features and decision with a deterministic stand-in probability."""
    feats = B.build_scoring_features(batch.withColumn("date", F.to_date("date")), [D.AS_OF], daily=True)
    p = F.pmod(F.col("customerid").cast("bigint") * 37 + F.col("n_events") * 11, F.lit(101)) / F.lit(100.0)
    return feats.select(
        "customerid", "billing_interval", DE.decide(p, F.col("interval_confidence"))["recommendation"].alias("recommendation"))


@query("stream_score_files", f"""WITH {INTERVAL_SQL}, k AS (SELECT customerid, billing_interval, round_even(raw_confidence, 4) AS conf,
  ((CAST(customerid AS BIGINT) * 37 + n_events * 11) % 101) / 100.0::DOUBLE AS p FROM iv WHERE snapshot_date = DATE '2000-06-01')
SELECT customerid, billing_interval, CASE WHEN conf < 0.5 THEN 'Review' WHEN p <= 0.45 THEN 'Continue' WHEN p >= 0.7 THEN 'No-Go' ELSE 'Review' END AS recommendation FROM k""")
def stream_score_files(spark, sf):
    path = new_scratch(spark, "scored")
    S.score_files(invoice_parts(spark, sf), path, stand_in_scorer).awaitTermination()
    return S.latest(spark.read.parquet(f"{path}/data"), ["customerid"])


def verdict_stream(df):
    kind = F.col("event_type")
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "purchase", "Continue").when(kind == "error", "No-Go").otherwise("Review").alias("recommendation"),
        F.when(kind == "error", F.when(F.col("value") > 50, "company_status_hard_stop").otherwise("extreme_budget_burn")).alias("guardrail_rule"))


@query("stream_verdict_mix", """WITH v AS (SELECT DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) * 7 AS INT) AS period,
  CASE event_type WHEN 'purchase' THEN 'Continue' WHEN 'error' THEN 'No-Go' ELSE 'Review' END AS recommendation FROM events),
g AS (SELECT period, k.recommendation, count(*) FILTER (WHERE v.recommendation = k.recommendation) AS n, count(*) AS total
  FROM v CROSS JOIN (VALUES ('Continue'), ('Review'), ('No-Go')) k(recommendation) GROUP BY ALL),
s AS (SELECT period, recommendation, n, n * 100.0 / total AS sh FROM g),
l AS (SELECT *, CASE WHEN period - lag(period) OVER w = 7 THEN sh - lag(sh) OVER w END AS shift FROM s WINDOW w AS (PARTITION BY recommendation ORDER BY period))
SELECT period, recommendation, n, round(sh, 6) AS share_pct, round(shift, 6) AS shift, coalesce(abs(shift) > 20, false) AS alert FROM l""")
def stream_verdict_mix(spark, sf):
    mix = S.verdict_mix(verdict_stream(S.stream_table(spark, sf, "events")))
    table = S.latest(S.run(mix, new_scratch(spark, "mix"), "update"), ["period", "recommendation", "guardrail_rule"])
    out = S.mix_alerts(table)
    return out.select(
        "period", "recommendation", "n", F.round("share_pct", 6).alias("share_pct"), F.round("shift", 6).alias("shift"), "alert")


@query("rule_alerts", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'error' AND value > 50) AS a,
  count(*) FILTER (WHERE event_type = 'error' AND NOT value > 50) AS b FROM events GROUP BY 1),
l AS (SELECT day, 'company_status_hard_stop' AS guardrail_rule, a AS fired, total FROM d UNION ALL SELECT day, 'extreme_budget_burn', b, total FROM d),
w AS (SELECT *, fired / total AS rate, avg(fired / total) OVER x AS base, stddev_samp(fired / total) OVER x AS sp FROM l
  WINDOW x AS (PARTITION BY guardrail_rule ORDER BY day RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT day, guardrail_rule, fired, total, round(rate, 6) AS rate, round(base, 6) AS baseline, coalesce(rate > base + 3 * sp, false) AS alert FROM w""")
def rule_alerts(spark, sf):
    rows = verdict_stream(D.table(spark, sf, "events")).withColumn("day", F.to_date("ts"))
    daily = rows.groupBy("day", "guardrail_rule").agg(F.count(F.lit(1)).alias("n"))
    out = S.rule_alerts(daily, ["company_status_hard_stop", "extreme_budget_burn"])
    return out.select(
        "day", "guardrail_rule", "fired", "total", F.round("rate", 6).alias("rate"), F.round("baseline", 6).alias("baseline"), "alert")


@query("stream_drift", f"""WITH ev AS (SELECT event_type AS feature, value, ts, (ts < TIMESTAMP '2024-01-16')::INT AS is_ref FROM events),
wk AS (SELECT DISTINCT DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) * 7 AS INT) AS period FROM ev WHERE is_ref = 0),
lg AS (SELECT period || '#' || feature AS feature, value, is_ref FROM ev, wk WHERE is_ref = 1 UNION ALL
  SELECT (DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) * 7 AS INT)) || '#' || feature, value, is_ref FROM ev WHERE is_ref = 0), {PSI_TAIL}
SELECT CAST(split_part(feature, '#', 1) AS DATE) AS period, split_part(feature, '#', 2) AS feature, round(v, 6) AS psi, v > 0.25 AS review FROM p""")
def stream_drift(spark, sf):
    cut = F.lit("2024-01-16").cast("timestamp")
    shape = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("feature"), "value")
    reference = shape(D.table(spark, sf, "events")).filter(F.col("ts") < cut)
    edges = materialise(DR.reference_edges(DR.known_values(reference)), "edges")
    stored = materialise(DR.bin_counts(reference, edges), "reference")
    live = shape(S.stream_table(spark, sf, "events")).filter(F.col("ts") >= cut)
    counts = S.run(live, new_scratch(spark, "drift"), "append", S.drift_counts(edges))
    out = S.weekly_drift(counts, edges, stored)
    return out.select("period", "feature", F.round("psi", 6).alias("psi"), "review")


@query("stream_gap_tracker", f"""WITH {INTERVAL_SQL}
SELECT customerid, n_events AS n_days, billing_interval FROM iv WHERE snapshot_date = DATE '2000-06-01'""")
def stream_gap_tracker(spark, sf):
    path = new_scratch(spark, "gaps")
    days = invoice_parts(spark, sf).select("customerid", F.to_date("date").alias("d"))
    S.gap_tracker(days, path, D.AS_OF).awaitTermination()
    return S.latest(spark.read.parquet(f"{path}/data"), ["customerid"]).select("customerid", "n_days", "billing_interval")


@query("dedupe_stream", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY ALL""")
def dedupe_stream(spark, sf):
    lines = S.stream_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("date"))
    kept = S.run(S.dedupe_stream(lines, ["l_orderkey", "l_linenumber"]), new_scratch(spark, "dedupe"))
    return kept.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
