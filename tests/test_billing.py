import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerspark.config import BillingConfig, IntervalConfig
from ledgerspark.operators import billing as B
from ledgerspark.sources import invoices as I

SNAP = dt.date(2026, 1, 1)
EVENT = "customerid string, date timestamp, event_amount double, n_invoices long"


def events(spark, dates, amounts=None, cust="a"):
    amounts = amounts or [100.0] * len(dates)
    rows = [(cust, dt.datetime(d.year, d.month, d.day), a, 1) for d, a in zip(dates, amounts)]
    return spark.createDataFrame(rows, EVENT)


def cadence(step, n, last=dt.date(2025, 12, 20)):
    return [last - dt.timedelta(days=step * i) for i in range(n)][::-1]


def infer(spark, dates, amounts=None, snap=SNAP):
    return B.infer_intervals(events(spark, dates, amounts), [snap]).first()


def test_same_day_lines_become_one_event(spark):
    rows = [("a", dt.datetime(2025, 1, 1), 100.0), ("a", dt.datetime(2025, 1, 1), 1.0), ("b", dt.datetime(2025, 1, 2), 5.0)]
    out = {r["customerid"]: r for r in B.same_day_events(spark.createDataFrame(rows, I.INVOICE_SCHEMA)).collect()}
    assert (out["a"]["event_amount"], out["a"]["n_invoices"]) == (101.0, 2)
    assert out["b"]["n_invoices"] == 1


@pytest.mark.parametrize("gap,base", [(30, "monthly"), (60, "monthly"), (91, "quarterly"), (365, "annual"), (45, None), (182, "quarterly"), (0, None)])
def test_gap_classes(spark, gap, base):
    assert spark.range(1).select(B.classify_gap(F.lit(gap)).alias("b")).first()["b"] == base


def test_longest_base_can_be_preferred(spark):
    cfg = IntervalConfig(prefer="longest")
    assert spark.range(1).select(B.classify_gap(F.lit(182), cfg).alias("b")).first()["b"] == "semi_annual"


@pytest.mark.parametrize("step,n,label", [(30, 18, "monthly"), (91, 8, "quarterly"), (365, 4, "annual")])
def test_regular_cadences(spark, step, n, label):
    row = infer(spark, cadence(step, n))
    assert row["billing_interval"] == label
    assert row["interval_confidence"] > 0.6
    assert row["n_gaps"] == n - 1 and row["median_gap_days"] == step


def test_skipped_month_stays_monthly(spark):
    dates = cadence(30, 10)
    del dates[4]
    assert infer(spark, dates)["billing_interval"] == "monthly"


def test_single_event_silence_decides(spark):
    assert infer(spark, [dt.date(2023, 1, 1)])["billing_interval"] == "one_time_candidate"
    row = infer(spark, [dt.date(2025, 12, 1)])
    assert row["billing_interval"] == "insufficient_history"
    assert row["interval_confidence"] == 0.0388  # 0.03875, half to even at the last digit


def test_irregular_and_mixed(spark):
    start = dt.date(2025, 1, 1)
    odd = [start]
    for g in (45, 20, 50, 15):
        odd.append(odd[-1] + dt.timedelta(days=g))
    assert infer(spark, odd, [10.0, 500.0, 3.0, 80.0, 7.0])["billing_interval"] == "irregular"
    both = [dt.date(2022, 1, 1)]
    for g in (30, 365, 30, 365, 30, 365):
        both.append(both[-1] + dt.timedelta(days=g))
    assert infer(spark, both)["billing_interval"] == "mixed"


def test_future_events_change_no_feature(spark):
    past = cadence(30, 12)
    later = past + [dt.date(2026, 2, 1), dt.date(2026, 3, 1)]
    a = B.interval_features(events(spark, past), [SNAP]).drop("future_rev").first()
    b = B.interval_features(events(spark, later), [SNAP]).drop("future_rev").first()
    assert a == b
    assert B.interval_features(events(spark, later), [SNAP]).first()["future_rev"] == 200.0


def test_labels(spark):
    snap = dt.date(2025, 1, 1)
    gone = events(spark, [dt.date(2024, m, 15) for m in range(1, 13)])
    row = B.churn_labels(gone, [snap]).first()
    assert (row["y_loss"], row["y_churn"], row["dollar_at_risk"]) == (1200.0, 1, 1200.0)
    kept = events(spark, [dt.date(2024, m, 15) for m in range(1, 13)] + [dt.date(2025, m, 15) for m in range(1, 13)])
    row = B.churn_labels(kept, [snap]).first()
    assert (row["y_loss"], row["y_churn"]) == (0.0, 0)
    only_later = events(spark, [dt.date(2025, 3, 1)])
    assert B.churn_labels(only_later, [snap]).count() == 0


def test_many_snapshots_equal_single_ones(spark, sf_dir):
    from ledgerspark.sources import domain as D

    ev = B.same_day_events(D.invoices(spark, sf_dir))
    snaps = [dt.date(1998, 1, 1), dt.date(2000, 6, 1)]
    both = B.infer_intervals(ev, snaps, daily=True)
    apart = B.stack_snapshots([B.infer_intervals(ev, [s], daily=True) for s in snaps])
    assert both.exceptAll(apart).isEmpty() and apart.exceptAll(both).isEmpty()


def test_daily_shortcut_equals_general_path(spark, sf_dir):
    from ledgerspark.sources import domain as D

    ev = B.same_day_events(D.invoices(spark, sf_dir))
    fast = B.infer_intervals(ev, [dt.date(2000, 6, 1)], daily=True)
    slow = B.infer_intervals(ev, [dt.date(2000, 6, 1)], daily=False)
    key = lambda df: {r["customerid"]: r for r in df.collect()}
    a, b = key(fast), key(slow)
    assert a.keys() == b.keys()
    for k in a:
        assert a[k]["billing_interval"] == b[k]["billing_interval"]
        assert a[k]["interval_confidence"] == pytest.approx(b[k]["interval_confidence"], abs=1e-4)


def test_several_events_on_a_day_add_zero_gaps(spark):
    rows = [("a", dt.datetime(2025, 1, 1, h), float(h + 1), 1) for h in range(3)] + [("a", dt.datetime(2025, 1, 31), 10.0, 1)]
    row = B.interval_features(spark.createDataFrame(rows, EVENT), [SNAP]).first()
    assert (row["n_events"], row["n_gaps"], row["median_gap_days"]) == (4, 3, 0.0)
    import statistics

    amounts = [1.0, 2.0, 3.0, 10.0]
    assert row["mean_amount"] == pytest.approx(4.0)
    assert row["amount_cv"] == pytest.approx(statistics.stdev(amounts) / 4.0)
    assert row["gap_cv"] == pytest.approx(statistics.stdev([0, 0, 30]) / 10.0)
    gaps = B.event_gaps(spark.createDataFrame(rows, EVENT)).groupBy("gap_days").agg(F.sum("times").alias("n")).collect()
    assert {r["gap_days"]: r["n"] for r in gaps} == {0: 2, 30: 1}


def test_gap_window_is_bounded_by_days(spark):
    """A customer with a third of all rows still has one row per day before the window."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("customerid"),
        F.timestamp_seconds(F.lit(1700000000) + (F.col("id") % 20) * 86400 + F.col("id")).alias("date"),
        F.lit(1.0).alias("event_amount"), F.lit(1).cast("bigint").alias("n_invoices"))
    days = B.customer_days(rows)
    assert days.filter("customerid = 'hot'").count() <= 21
    assert days.agg(F.sum("k")).first()[0] == 3000


def test_config_rejects_unordered_snapshots():
    with pytest.raises(ValueError):
        BillingConfig(snapshots=(dt.date(2025, 1, 1), dt.date(2024, 1, 1)))


def test_normalise_aliases_and_bad_rows(spark):
    rows = [("1", "2025-01-01", "10.5"), ("2", "bad", "3"), ("3", "2025-01-02", "-1"), (None, "2025-01-02", "1"), ("4", "2025-01-02", "x")]
    df = spark.createDataFrame(rows, "Customer_ID string, invoice_date string, invoice_amount string")
    out = I.normalize_invoices(df).collect()
    assert [(r["customerid"], r["amount"]) for r in out] == [("1", 10.5)]
    with pytest.raises(ValueError):
        I.normalize_invoices(df.filter("Customer_ID = '2'"))
    with pytest.raises(ValueError):
        I.resolve_columns(["a", "b"])


def test_caps(spark):
    rows = [(f"c{i:02d}", dt.datetime(2025, 1, 1 + j), 1.0) for i in range(20) for j in range(1 + i % 2)]
    df = spark.createDataFrame(rows, I.INVOICE_SCHEMA)
    capped = I.cap_customers(df, 5)
    assert capped.truncated and capped.frame.select("customerid").distinct().count() == 5
    recurring = I.cap_customers(df, 3, recurring_only=True)
    assert {r[0] for r in recurring.frame.select("customerid").distinct().collect()} == {"c01", "c03", "c05"}
    one = I.cap_customers(df, customer_id="c07")
    assert one.truncated and one.counts() == {"n_rows": 2, "n_customers": 1}
    assert not I.cap_customers(df.filter("customerid = 'c07'"), customer_id="c07").truncated
    for cap, cut in ((19, True), (20, False), (21, False)):
        capped = I.cap_customers(df, cap)
        assert capped.truncated is cut and capped.frame.select("customerid").distinct().count() == min(cap, 20)
    kept = sorted(tuple(r) for r in I.cap_rows(df, 4).collect())
    assert kept == sorted(rows)[:4] and I.cap_rows(df, 1000).count() == len(rows)
    assert I.cap_rows(df.unionByName(df), 7).count() == 7


def test_nothing_is_cut_unless_asked(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(6000).selectExpr("cast(id as string) customerid", "timestamp'2025-01-01' date", "1.0D amount").write.parquet(path)
    loaded = I.load_invoices(spark, path)
    assert loaded.counts() == {"n_rows": 6000, "n_customers": 6000} and not loaded.truncated
    assert I.load_invoices(spark, path, max_rows=10).truncated and not I.load_invoices(spark, path, max_rows=6000).truncated


def test_load_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("customerid,date,amount\n1,2025-01-01,5\n1,2025-02-01,6\n")
    (tmp_path / "b.tsv").write_text("customer\tbilling_date\tamt\n1\t2025-01-01\t5\n")
    assert I.load_invoices(spark, str(tmp_path / "a.csv")).counts()["n_rows"] == 2
    assert I.load_invoices(spark, str(tmp_path / "b.tsv")).counts()["n_rows"] == 1
    with pytest.raises(ValueError):
        I.load_invoices(spark, str(tmp_path / "c.xlsx"))
    assert I.invoices_from_records(spark, "z", [{"date": "2025-01-01", "amount": 3}]).count() == 1
