import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import text as X
from ledgerspark.operators import credit as C
from ledgerspark.operators import decision as DE
from ledgerspark.plans import credit as CP

COMPANY = (
    "CompanyID string, CompanyStatus string, PrimaryType string, YearFounded int, OriginCountry string, Rank double, "
    "SalesMain double, SalesOther double, MonthlyBudget double, Investments double, TodaysClients double, "
    "ReturningClients double, TotalActiveClients double, Clients7D double, Clients6M double, Clients12M double, "
    "Visitors7D double, Visitors6M double, Visitors12M double"
)
HEALTHY = ("h", "Active", "Retail", 2010, "FR", 4.5, 500.0, 93.0, 100.0, 50.0, 100.0, 47.0, 300.0, 10.0, 60.0, 100.0, 40.0, 900.0, 2000.0)
CLOSED = ("c", "Out of Business", *HEALTHY[2:])
BROKE = ("b", "Active", "Crypto", 2010, "FR", 2.0, 2.0, 1.0, 100.0, 50.0, *HEALTHY[10:])
EMPTY = ("e", *[None] * 18)
ODD = ("o", "Parked", "Space", 2050, None, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0, *HEALTHY[11:])


@pytest.fixture(scope="module")
def bundles(spark):
    df = spark.createDataFrame([HEALTHY, CLOSED, BROKE, EMPTY, ODD], COMPANY)
    return {r["CompanyID"]: r for r in C.metric_bundles(df, 2025).collect()}


def test_healthy_ratios(bundles):
    f, e, b = (bundles["h"][k] for k in ("financial_health", "client_engagement", "business_profile"))
    assert (f["revenue_estimate"], f["budget_utilisation_ratio"], f["sales_mix_ratio"]) == (593.0, 5.93, 0.8432)
    assert e["retention_rate"] == 0.47 and e["client_growth_rate_6m"] == 0.2
    assert e["client_growth_rate_12m"] == -0.1667 and e["visitor_trend_ratio"] == 1.04
    assert (b["status_flag"], b["business_type_risk_tier"], b["company_age_years"], b["rank_band"]) == ("active", "low", 15, "strong")
    assert not f["data_quality_issues"] and not e["data_quality_issues"] and not b["data_quality_issues"]


def test_all_missing(bundles):
    f, e, b = (bundles["e"][k] for k in ("financial_health", "client_engagement", "business_profile"))
    assert f["revenue_estimate"] is None and f["budget_utilisation_ratio"] is None
    assert f["data_quality_issues"] == ["missing: sales_main", "missing: sales_other", "missing: monthly_budget", "missing: investments"]
    assert all(e[k] is None for k in ("retention_rate", "active_client_ratio", "conversion_rate_7d")) and len(e["data_quality_issues"]) == 6
    assert (b["status_flag"], b["business_type_risk_tier"], b["rank_band"]) == ("unknown", "medium", "unknown")


def test_zero_and_unknown_values(bundles):
    f, e, b = (bundles["o"][k] for k in ("financial_health", "client_engagement", "business_profile"))
    assert f["budget_utilisation_ratio"] is None and "zero: total_revenue (sales_main + sales_other)" in f["data_quality_issues"]
    assert "zero: retention_rate denominator" in e["data_quality_issues"]
    assert b["company_age_years"] is None
    assert "unknown_status_value: 'Parked'" in b["data_quality_issues"]
    assert "invalid: year_founded (2050) is in the future" in b["data_quality_issues"]


def one(spark, status, util, kept, rec="Review", conf="low"):
    return spark.createDataFrame(
        [(rec, conf, "why", (status,), (util,), (kept,))],
        "recommendation string, confidence string, rationale string, business_profile struct<status_flag:string>, "
        "financial_health struct<budget_utilisation_ratio:double>, client_engagement struct<retention_rate:double>")


@pytest.mark.parametrize("status,util,kept,start,end", [
    ("active", 5.9, 0.47, "Review", "Continue"), ("active", 1.0, 0.15, "Review", "Continue"),
    ("active", 0.5, 0.20, "Review", "Review"), ("active", 0.10, 0.25, "No-Go", "Continue"),
    ("active", 0.05, 0.9, "Review", "Review"), ("closed", 5.0, 0.9, "Review", "Review"),
    ("active", None, 0.9, "Review", "Review"), ("active", 5.0, None, "Review", "Review"),
])
def test_promotion(spark, status, util, kept, start, end):
    row = C.promote_continue(one(spark, status, util, kept, start)).first()
    assert row["recommendation"] == end
    assert row["confidence"] == ("medium" if row["promoted"] else "low")


@pytest.mark.parametrize("status,util,rule", [
    ("active", 0.0999, "extreme_budget_burn"), ("active", 0.10, None), ("active", None, None),
    ("inactive", 5.0, "company_status_hard_stop"), ("closed", 0.01, "company_status_hard_stop"), ("unknown", 0.5, None),
])
def test_guardrails(spark, status, util, rule):
    row = C.guardrails(one(spark, status, util, 0.5, "Continue", "medium")).first()
    assert row["guardrail_rule"] == rule and row["guardrail_fired"] == (rule is not None)
    if rule:
        assert row["recommendation"] == "No-Go" and row["confidence"] == "high"
        assert row["rationale"].startswith(f"[GUARDRAIL OVERRIDE — {rule}]") and row["rationale"].endswith("\n\nwhy")
    else:
        assert row["recommendation"] == "Continue" and row["guardrail_reason"] == ""


def test_burn_text(spark):
    row = C.guardrails(one(spark, "active", 0.03, 0.5)).first()
    assert "Revenue covers only 3.0% of monthly budget (threshold: 10%)." in row["guardrail_reason"]


ANSWERS = {
    "pure": '{"recommendation": "Continue", "confidence": "high", "rationale": "fine"}',
    "prose": 'I think: {"recommendation": "No-Go", "confidence": "low", "rationale": "bad"} done',
    "nested": '{"recommendation": "Review", "confidence": "medium", "rationale": "x", "more": {"a": 1}}',
    "second": '{"a": 1} then {"recommendation": "Review", "confidence": "low", "rationale": "y"}',
    "literal": "{'recommendation': 'Continue', 'confidence': 'low', 'rationale': \"it's\"}",
    "tool": '[{"name": "compute_financial_health", "args": {}}]',
    "broken": "no verdict here {",
    "odd": '{"recommendation": "Maybe", "confidence": "sure"}',
    "none": None,
}


def test_parse_and_coerce(spark):
    df = spark.createDataFrame(list(ANSWERS.items()), "id string, answer string")
    got = {r["id"]: r for r in C.coerce_verdicts(C.parse_verdicts(df, "answer")).collect()}
    assert got["pure"]["verdict"]["rationale"] == "fine" and got["pure"]["error"] is None
    assert got["prose"]["recommendation"] == "No-Go" and got["prose"]["error"] is None
    assert got["nested"]["confidence"] == "medium" and got["second"]["recommendation"] == "Review"
    assert got["literal"]["rationale"] == "it's"
    assert got["tool"]["error"].startswith("Model returned tool-call JSON")
    for k in ("tool", "broken", "none"):
        assert (got[k]["recommendation"], got[k]["confidence"]) == ("No-Go", "low") and got[k]["error"]
    assert (got["odd"]["recommendation"], got["odd"]["confidence"], got["odd"]["rationale"]) == ("Review", "low", "No rationale provided.")


def test_tool_outputs_last_wins(spark):
    log = [
        ("c", 1, "tool", "compute_financial_health", "old", False), ("c", 2, "tool", "compute_financial_health", "new", False),
        ("c", 3, "assistant", None, "thinking", True), ("c", 4, "assistant", None, "verdict", False),
        ("c", 5, "assistant", None, '[{"name": "t", "arguments": {}}]', False), ("d", 1, "tool", "business_profile", "bp", False),
    ]
    df = spark.createDataFrame(log, "id string, seq int, role string, name string, content string, has_tool_calls boolean")
    got = {r["id"]: r for r in C.collect_tool_outputs(df).collect()}
    assert got["c"]["financial_health"] == "new" and got["c"]["final_text"] == "verdict"
    assert got["d"]["business_profile"] == "bp" and got["d"]["final_text"] is None


def test_assessment_plan(spark):
    df = spark.createDataFrame([HEALTHY, CLOSED, BROKE, EMPTY], COMPANY)
    got = {r["CompanyID"]: r["recommendation"] for r in CP.assess_companies(df, 2025).collect()}
    assert got == {"h": "Continue", "c": "No-Go", "b": "No-Go", "e": "Review"}
    answers = spark.createDataFrame([("h", "broken"), ("b", ANSWERS["pure"])], "CompanyID string, answer string")
    out = {r["CompanyID"]: r for r in CP.assess_companies(df, 2025, answers).collect()}
    assert out["h"]["recommendation"] == "No-Go" and out["h"]["error"] and not out["h"]["guardrail_fired"]
    assert out["b"]["guardrail_rule"] == "extreme_budget_burn"
    counts = {r["recommendation"]: (r["n"], r["pct"]) for r in C.verdict_summary(CP.assess_companies(df, 2025)).collect()}
    assert counts == {"Continue": (1, 25.0), "Review": (1, 25.0), "No-Go": (2, 50.0), "Error": (0, 0.0)}


@pytest.mark.parametrize("p,conf,want,auto", [
    (0.1, 0.9, "Continue", True), (0.45, 0.5, "Continue", True), (0.46, 0.9, "Review", False),
    (0.70, 0.9, "No-Go", True), (0.99, 0.49, "Review", False), (0.01, 0.1, "Review", False),
])
def test_decide(spark, p, conf, want, auto):
    row = spark.range(1).select(DE.decide(F.lit(p), F.lit(conf)).alias("d")).first()["d"]
    assert (row["recommendation"], row["auto_decided"]) == (want, auto)
    if conf < 0.5:
        assert row["reason"] == "low_interval_confidence" and f"{conf:.2f} < 0.50" in row["detail"]


def test_sweep_matches_row_by_row(spark):
    rows = [(p / 20, c / 10) for p in range(21) for c in range(11)]
    table = DE.threshold_sweep(spark.createDataFrame(rows, "churn_prob double, interval_confidence double")).collect()
    assert len(table) == 36
    for r in table:
        sure = [p for p, c in rows if c >= r["min_interval_confidence"]]
        assert r["continue_n"] == sum(p <= r["continue_max_risk"] for p in sure)
        assert r["nogo_n"] == sum(p >= r["nogo_min_risk"] for p in sure)
        assert r["continue_n"] + r["review_n"] + r["nogo_n"] == len(rows)


def test_labels(spark):
    row = spark.range(1).select(
        DE.risk_tier_label(F.lit(0.7)).alias("a"), DE.risk_tier_label(F.lit(0.45)).alias("b"), DE.margin_label(F.lit(0.9)).alias("c"),
        X.churn_value(F.lit("is_monthly"), F.lit(1.0)).alias("d"), X.churn_value(F.lit("n_events"), F.lit(12.0)).alias("e"),
        X.churn_value(F.lit("total_amount"), F.lit(1234.5)).alias("f"), X.churn_value(F.lit("gap_cv"), F.lit(None).cast("double")).alias("g"),
    ).first()
    assert tuple(row) == ("High risk", "Low risk", "High (|p-0.5| margin 0.80)", "yes", "12", "1,234.50", "n/a")


def interval_text(spark, **kw):
    base = dict(label="monthly", conf=0.78, n=12, gaps=11, med=30.0, cv=0.1, base="monthly", share=1.0, bases=1, rec=20) | kw
    cols = [F.lit(base[k]).cast(t) for k, t in (
        ("label", "string"), ("conf", "double"), ("n", "bigint"), ("gaps", "bigint"), ("med", "double"), ("cv", "double"),
        ("base", "string"), ("share", "double"), ("bases", "bigint"), ("rec", "int"))]
    return spark.range(1).select(X.explain_interval(*cols).alias("t")).first()["t"]


def test_interval_texts(spark):
    assert interval_text(spark) == (
        "We inferred **monthly billing (about every month)** because the typical gap between billing days is about 30 days, "
        "which matches monthly billing (about every month) across 11 observed cycle(s) (about 100% of gaps fit that pattern) "
        "and spacing looks very regular Confidence in this label is **78%**.")
    thin = interval_text(spark, label="insufficient_history", n=1, gaps=0, med=None, cv=None, base=None, share=0.0, conf=0.04)
    assert "only 1 billing day(s)" in thin and "(last invoice about 20 days before the snapshot)" in thin and thin.endswith("**4%**.")
    assert "typical gap ≈ unknown" in interval_text(spark, label="irregular", med=None, base=None)
    assert "strongest pattern is monthly (about 60% of matched gaps)" in interval_text(spark, label="mixed", share=0.6)


def test_decision_texts(spark):
    say = lambda rec, reason, p, conf: spark.range(1).select(X.explain_decision(
        F.lit(rec), F.lit(reason), F.lit(""), F.lit(p).cast("double"), F.lit(conf).cast("double"), F.lit("monthly")).alias("t")).first()["t"]
    assert "no usable invoice history" in say("Review", "no_history", None, None)
    assert "signal is too uncertain (confidence 20% for “monthly billing" in say("Review", "low_interval_confidence", 0.2, 0.2)
    assert "**12%** (low risk). That sits below the Continue threshold" in say("Continue", "low_churn_risk", 0.12, 0.9)
    assert "(high risk). That sits above the No-Go threshold" in say("No-Go", "high_churn_risk", 0.9, 0.9)
    pair = spark.range(1).select(
        X.compare_decisions(F.lit("Review"), F.lit("Review"), F.lit(0.61), F.lit(0.52)).alias("a"),
        X.compare_decisions(F.lit("Review"), F.lit("No-Go"), F.lit(0.5), F.lit(0.8)).alias("b")).first()
    assert "agree on **Review**" in pair["a"] and "+9.0% (with=61%, without=52%)" in pair["a"]
    assert "**disagree**" in pair["b"] and "Δ=-30.0%" in pair["b"]


def drivers(spark, rows):
    return spark.createDataFrame([(rows,)], "d array<struct<feature:string,contribution:double,value:string>>")


def test_driver_texts(spark):
    df = drivers(spark, [("PortfolioMeanClients", 0.06, "12"), ("Area", -0.0005, None), ("LandlordAge", -0.03, None), ("custom_x", 0.01, "3.14159")])
    from ledgerspark.operators.ranking import top_k_drivers

    t = df.select(top_k_drivers(F.col("d"), 5).alias("t")).select(
        F.transform("t.positive", X.enrich_driver).alias("ups"), F.transform("t.negative", X.enrich_driver).alias("downs"))
    row = t.first()
    assert [d["feature"] for d in row["ups"]] == ["PortfolioMeanClients", "custom_x"]
    assert [d["feature"] for d in row["downs"]] == ["LandlordAge", "Area"]
    assert row["ups"][0]["value_display"] == "12" and row["ups"][1]["label"] == "custom x"
    assert row["downs"][0]["value_missing"] and row["downs"][1]["negligible"]
    told = t.select(X.interpret_score(F.lit("bad"), F.lit("low"), F.lit(3), F.col("ups"), F.col("downs")).alias("i")).first()["i"]
    assert told["positive_signals"][0] == "Tenant client base strongly improved the score."
    assert told["negative_signals"] == ["Missing landlord age clearly reduced the score.", "Small tenant count (3) reduced confidence."]
    assert told["main_reason"].endswith("especially landlord age.")
    assert told["final_interpretation"].startswith("This landlord appears weak") and "only 3 matched tenant(s)" in told["final_interpretation"]


def test_churn_driver_sentence(spark):
    df = spark.createDataFrame(
        [([("recency_days", 0.4, 120.0)], [("is_monthly", -0.2, 1.0)])],
        "u array<struct<feature:string,contribution:double,value:double>>, v array<struct<feature:string,contribution:double,value:double>>")
    got = df.select(X.explain_drivers(F.lit("High risk"), F.col("u"), F.col("v"), F.lit(True)).alias("t")).first()["t"]
    assert got == (
        "Overall risk tier: **High risk**. The single biggest driver is **days since last invoice**, which is currently **raising** "
        "churn risk. Factors pushing risk up: days since last invoice (value 120). Factors pulling risk down: flag: monthly cadence (value yes).")
