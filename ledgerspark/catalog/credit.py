"""Credit triage and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.catalog.billing import INTERVAL_SQL, daily_events
from ledgerspark.catalog.portfolio import PERCENTILE_SQL, LANDLORD_FEATURE_SQL, shrunk
from ledgerspark.catalog.registry import query
from ledgerspark.config import DecisionConfig
from ledgerspark.functions import text as X
from ledgerspark.functions.lookups import RISK_TIERS, STATUS_FLAGS
from ledgerspark.operators import billing as B
from ledgerspark.operators import credit as C
from ledgerspark.operators import decision as DE
from ledgerspark.operators import portfolio as P
from ledgerspark.operators import ranking as R
from ledgerspark.session import materialise
from ledgerspark.sources import domain as D
from ledgerspark.sources import tables as S


def profiles(spark, sf):
    return S.rename_columns(D.companies(spark, sf))


def bundles(spark, sf):
    return C.metric_bundles(profiles(spark, sf), D.AS_OF_YEAR)


def _class_sql(column: str, classes: dict[str, tuple[str, ...]], default: str) -> str:
    quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    arms = " ".join(f"WHEN {column} IN ({quoted(values)}) THEN '{name}'" for name, values in classes.items())
    return f"CASE {arms} ELSE '{default}' END"


METRIC_SQL = f"""{D.COMPANIES_SQL},
rv AS (SELECT *, CASE WHEN SalesOfMainProduct IS NOT NULL OR SalesOfOtherProduct IS NOT NULL THEN coalesce(SalesOfMainProduct, 0) + coalesce(SalesOfOtherProduct, 0) END AS revenue FROM companies),
mt AS (SELECT CompanyID, revenue, SalesOfMainProduct, SalesOfOtherProduct, MonthlyBudget, Investments,
  CASE WHEN abs(MonthlyBudget) >= 1e-9 THEN revenue / MonthlyBudget END AS util, CASE WHEN abs(Investments) >= 1e-9 THEN revenue / Investments END AS per_inv,
  CASE WHEN abs(revenue) >= 1e-9 THEN SalesOfMainProduct / revenue END AS mix,
  CASE WHEN abs(TodaysClients) >= 1e-9 THEN ReturningClient / TodaysClients END AS retention, CASE WHEN abs(TodaysClients) >= 1e-9 THEN TotalActiveClients / TodaysClients END AS active_ratio,
  CASE WHEN abs(ClientsInTheLast12Months / 2) >= 1e-9 THEN (ClientsInTheLast6Months - ClientsInTheLast12Months / 2) / (ClientsInTheLast12Months / 2) END AS g6,
  CASE WHEN abs(ClientsInTheLast6Months * 2) >= 1e-9 THEN (ClientsInTheLast12Months - ClientsInTheLast6Months * 2) / (ClientsInTheLast6Months * 2) END AS g12,
  CASE WHEN abs(TotalClientsInTheLast7Days) >= 1e-9 THEN ClientsInTheLast7Days / TotalClientsInTheLast7Days END AS conv,
  CASE WHEN abs(TotalClientsInTheLast12Months) >= 1e-9 THEN TotalClientsInTheLast7Days * 52 / TotalClientsInTheLast12Months END AS trend,
  {_class_sql('CompanyStatus', STATUS_FLAGS, 'unknown')} AS status_flag, {_class_sql('PrimaryType', RISK_TIERS, 'medium')} AS tier,
  CASE WHEN 2020 - YearFounded >= 0 THEN 2020 - YearFounded END AS age, Rank, OriginCountry, CompanyStatus, PrimaryType, YearFounded,
  TodaysClients, ReturningClient, ClientsInTheLast6Months, ClientsInTheLast12Months, ClientsInTheLast7Days, TotalClientsInTheLast7Days, TotalClientsInTheLast12Months FROM rv)"""


@query("financial_health", f"""WITH {METRIC_SQL} SELECT CompanyID, round(revenue, 2) AS revenue_estimate, round_even(util, 4) AS budget_utilisation_ratio,
  round_even(per_inv, 4) AS revenue_per_investment, round_even(mix, 4) AS sales_mix_ratio,
  concat_ws('; ', CASE WHEN SalesOfMainProduct IS NULL THEN 'missing: sales_main' END, CASE WHEN SalesOfOtherProduct IS NULL THEN 'missing: sales_other' END,
    CASE WHEN MonthlyBudget IS NULL THEN 'missing: monthly_budget' WHEN abs(MonthlyBudget) < 1e-9 THEN 'zero: monthly_budget' END,
    CASE WHEN Investments IS NULL THEN 'missing: investments' WHEN abs(Investments) < 1e-9 THEN 'zero: investments' END,
    CASE WHEN abs(revenue) < 1e-9 THEN 'zero: total_revenue (sales_main + sales_other)' END) AS issues FROM mt""")
def financial_health(spark, sf):
    rev = F.col("financial_health.revenue_estimate")
    out = bundles(spark, sf)
    return out.select(
        "CompanyID", F.round(rev, 2).alias("revenue_estimate"),
        *[F.col(f"financial_health.{c}") for c in
          ("budget_utilisation_ratio", "revenue_per_investment", "sales_mix_ratio")],
        F.array_join("financial_health.data_quality_issues", "; ").alias("issues"))


@query("client_engagement", f"""WITH {METRIC_SQL} SELECT CompanyID, round_even(retention, 4) AS retention_rate, round_even(active_ratio, 4) AS active_client_ratio,
  round_even(g6, 4) AS client_growth_rate_6m, round_even(g12, 4) AS client_growth_rate_12m, round_even(conv, 4) AS conversion_rate_7d, round_even(trend, 4) AS visitor_trend_ratio,
  (CASE WHEN ReturningClient IS NULL THEN 1 WHEN TodaysClients IS NULL OR TodaysClients = 0 THEN 1 ELSE 0 END)
  + (CASE WHEN TodaysClients IS NULL OR TodaysClients = 0 THEN 1 ELSE 0 END) + (CASE WHEN g6 IS NULL THEN 1 ELSE 0 END) + (CASE WHEN g12 IS NULL THEN 1 ELSE 0 END)
  + (CASE WHEN conv IS NULL THEN 1 ELSE 0 END) + (CASE WHEN trend IS NULL THEN 1 ELSE 0 END) AS n_issues FROM mt""")
def client_engagement(spark, sf):
    e = "client_engagement"
    return bundles(spark, sf).select(
        "CompanyID", *[F.col(f"{e}.{c}") for c in (
            "retention_rate", "active_client_ratio", "client_growth_rate_6m", "client_growth_rate_12m",
            "conversion_rate_7d", "visitor_trend_ratio")],
        F.size(f"{e}.data_quality_issues").alias("n_issues"))


@query("normalise_status", f"WITH {METRIC_SQL} SELECT CompanyID, status_flag FROM mt")
def normalise_status(spark, sf):
    return profiles(spark, sf).select("CompanyID", C.normalise_status(F.col("CompanyStatus")).alias("status_flag"))


@query("risk_tier", f"WITH {METRIC_SQL} SELECT CompanyID, tier FROM mt")
def risk_tier(spark, sf):
    return profiles(spark, sf).select("CompanyID", C.risk_tier(F.col("PrimaryType")).alias("tier"))


@query("company_age", f"WITH {METRIC_SQL} SELECT CompanyID, CAST(age AS INT) AS age FROM mt")
def company_age(spark, sf):
    return profiles(spark, sf).select("CompanyID", C.company_age(F.col("YearFounded"), D.AS_OF_YEAR).alias("age"))


@query("rank_band", f"""WITH {METRIC_SQL} SELECT CompanyID, CASE WHEN Rank IS NULL THEN 'unknown' WHEN Rank > 4 THEN 'strong' WHEN Rank >= 3 THEN 'acceptable' ELSE 'weak' END AS band FROM mt""")
def rank_band(spark, sf):
    return profiles(spark, sf).select("CompanyID", C.rank_band(F.col("Rank")).alias("band"))


PROFILE_ISSUES = """concat_ws('; ', CASE WHEN CompanyStatus IS NULL OR trim(CompanyStatus) = '' THEN 'missing: company_status'
    WHEN status_flag = 'unknown' THEN 'unknown_status_value: ''' || CompanyStatus || '''' END,
    CASE WHEN PrimaryType IS NULL THEN 'missing: primary_type' WHEN PrimaryType = 'Space Tourism' THEN 'unknown_primary_type: ''Space Tourism'' (defaulted to medium)' END,
    CASE WHEN YearFounded IS NULL THEN 'missing: year_founded' WHEN YearFounded > 2020 THEN 'invalid: year_founded (' || YearFounded || ') is in the future' END,
    CASE WHEN OriginCountry IS NULL THEN 'missing: origin_country' END, CASE WHEN Rank IS NULL THEN 'missing: rank' END)"""


@query("business_profile", f"""WITH {METRIC_SQL} SELECT CompanyID, status_flag, tier AS business_type_risk_tier, CAST(age AS INT) AS company_age_years,
  CASE WHEN Rank IS NULL THEN 'unknown' WHEN Rank > 4 THEN 'strong' WHEN Rank >= 3 THEN 'acceptable' ELSE 'weak' END AS rank_band, OriginCountry AS country, {PROFILE_ISSUES} AS issues FROM mt""")
def business_profile(spark, sf):
    b = "business_profile"
    return bundles(spark, sf).select(
        "CompanyID", *[F.col(f"{b}.{c}") for c in (
            "status_flag", "business_type_risk_tier", "company_age_years", "rank_band", "country")],
        F.array_join(f"{b}.data_quality_issues", "; ").alias("issues"))


@query("data_quality_issues", f"""WITH {METRIC_SQL}, i AS (SELECT unnest(string_split({PROFILE_ISSUES}, '; ')) AS issue FROM mt)
SELECT issue, count(*) AS companies FROM i WHERE issue <> '' GROUP BY 1""")
def data_quality_issues(spark, sf):
    return bundles(spark, sf).select(F.explode("business_profile.data_quality_issues").alias("issue")).groupBy(
        "issue").agg(F.count(F.lit(1)).alias("companies"))


POLICY_SQL = f"""{METRIC_SQL}, rd AS (SELECT *, round_even(util, 4) AS u, round_even(retention, 4) AS kept FROM mt),
pv AS (SELECT *, CASE WHEN status_flag IN ('inactive','suspended','closed') OR coalesce(u < 0.10, false) THEN 'No-Go'
  WHEN status_flag = 'active' AND u >= 0.10 AND kept >= 0.15 THEN 'Continue' ELSE 'Review' END AS start FROM rd),
fin AS (SELECT *, CASE WHEN status_flag IN ('inactive','suspended','closed') THEN 'company_status_hard_stop' WHEN u < 0.10 THEN 'extreme_budget_burn' END AS rule FROM pv)"""


@query("guardrails", f"""WITH {POLICY_SQL} SELECT CompanyID, CASE WHEN rule IS NOT NULL THEN 'No-Go' ELSE start END AS recommendation, rule IS NOT NULL AS guardrail_fired, rule AS guardrail_rule FROM fin""")
def guardrails(spark, sf):
    out = C.guardrails(C.policy_verdict(bundles(spark, sf)))
    return out.select("CompanyID", "recommendation", "guardrail_fired", "guardrail_rule")


@query("promote_continue", f"""WITH {POLICY_SQL} SELECT CompanyID, CASE WHEN status_flag = 'active' AND u >= 0.10 AND ((u >= 1 AND kept >= 0.15) OR kept >= 0.25) THEN 'Continue' ELSE 'Review' END AS recommendation,
  coalesce(status_flag = 'active' AND u >= 0.10 AND ((u >= 1 AND kept >= 0.15) OR kept >= 0.25), false) AS promoted FROM pv""")
def promote_continue(spark, sf):
    start = bundles(spark, sf).withColumns({
        "recommendation": F.lit("Review"), "confidence": F.lit("low"), "rationale": F.lit("start")})
    return C.promote_continue(start).select("CompanyID", "recommendation", "promoted")


@query("assess_companies", f"""WITH {POLICY_SQL} SELECT CompanyID, CASE WHEN rule IS NOT NULL THEN 'No-Go' WHEN status_flag = 'active' AND u >= 0.10 AND ((u >= 1 AND kept >= 0.15) OR kept >= 0.25) THEN 'Continue' ELSE start END AS recommendation,
  rule IS NOT NULL AS guardrail_fired FROM fin""")
def assess_companies(spark, sf):
    out = assessed(spark, sf)
    return out.select("CompanyID", "recommendation", "guardrail_fired")


def assessed(spark, sf):
    return C.guardrails(C.promote_continue(C.policy_verdict(bundles(spark, sf))))


@query("verdict_summary", f"""WITH {POLICY_SQL}, a AS (SELECT CASE WHEN rule IS NOT NULL THEN 'No-Go' WHEN status_flag = 'active' AND u >= 0.10 AND ((u >= 1 AND kept >= 0.15) OR kept >= 0.25) THEN 'Continue' ELSE start END AS recommendation FROM fin),
v(position, recommendation) AS (VALUES (0, 'Continue'), (1, 'Review'), (2, 'No-Go'), (3, 'Error'))
SELECT position, v.recommendation, (SELECT count(*) FROM a WHERE a.recommendation = v.recommendation) AS n,
  round(100.0 * (SELECT count(*) FROM a WHERE a.recommendation = v.recommendation) / (SELECT count(*) FROM a), 1) AS pct FROM v""")
def verdict_summary(spark, sf):
    return C.verdict_summary(assessed(spark, sf))


def answer_texts(spark, sf):
    """Answer texts of every customer: clean JSON, JSON in prose, a literal, tool calls, and broken ones."""
    k = F.col("c_custkey")
    rec = F.when(k % 4 == 0, "Continue").when(k % 4 == 1, "No-Go").when(k % 4 == 2, "Review").otherwise("Maybe")
    conf = F.when(k % 5 == 0, "high").when(k % 5 == 1, "unsure").otherwise("medium")
    body = F.concat(
        F.lit('{"recommendation": "'), rec, F.lit('", "confidence": "'), conf, F.lit('", "rationale": "balance '),
        F.format_string("%.2f", "c_acctbal"), F.lit('"}'))
    literal = F.replace(body, F.lit('"'), F.lit("'"))
    text = (
        F.when(k % 13 == 0, F.concat(F.lit("no verdict for "), k))
        .when(k % 17 == 0, F.concat(F.lit('[{"name": "compute_financial_health", "args": {"id": '), k, F.lit("}}]")))
        .when(k % 3 == 1, F.concat(F.lit("My view {unfinished} is: "), body, F.lit(" as stated.")))
        .when(k % 11 == 0, literal)
        .otherwise(body)
    )
    return D.table(spark, sf, "customer").select(k.alias("id"), text.alias("answer"))


ANSWER_SQL = """
ans AS (SELECT c_custkey AS id, c_custkey % 13 = 0 OR c_custkey % 17 = 0 AS bad, c_custkey % 13 <> 0 AND c_custkey % 17 = 0 AS tool,
  CASE c_custkey % 4 WHEN 0 THEN 'Continue' WHEN 1 THEN 'No-Go' WHEN 2 THEN 'Review' ELSE 'Maybe' END AS rec,
  CASE c_custkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'unsure' ELSE 'medium' END AS conf, 'balance ' || printf('%.2f', c_acctbal) AS rationale FROM customer)"""


@query("parse_verdicts", f"""WITH {ANSWER_SQL} SELECT id, CASE WHEN NOT bad THEN rec END AS recommendation, CASE WHEN NOT bad THEN conf END AS confidence,
  CASE WHEN NOT bad THEN rationale END AS rationale, CASE WHEN tool THEN 'tool' WHEN bad THEN 'text' END AS error_kind FROM ans""")
def parse_verdicts(spark, sf):
    out = C.parse_verdicts(answer_texts(spark, sf), "answer")
    kind = F.when(F.col("parse_error").startswith("Model returned tool-call"), F.lit("tool")).when(
        F.col("parse_error").isNotNull(), F.lit("text"))
    return out.select("id", "verdict.recommendation", "verdict.confidence", "verdict.rationale", kind.alias("error_kind"))


@query("coerce_verdicts", f"""WITH {ANSWER_SQL} SELECT id, CASE WHEN bad THEN 'No-Go' WHEN rec = 'Maybe' THEN 'Review' ELSE rec END AS recommendation,
  CASE WHEN bad OR conf = 'unsure' THEN 'low' ELSE conf END AS confidence, bad AS failed FROM ans""")
def coerce_verdicts(spark, sf):
    out = C.coerce_verdicts(C.parse_verdicts(answer_texts(spark, sf), "answer"))
    return out.select("id", "recommendation", "confidence", F.col("error").isNotNull().alias("failed"))


def message_log(spark, sf):
    """One message per order: tool outputs, answers and tool requests of each customer."""
    o = F.col("o_orderkey")
    slot = F.pmod(o, F.lit(5))
    tool = F.when(slot == 0, "compute_financial_health").when(slot == 1, "assess_client_engagement").when(
        slot == 2, "check_business_profile")
    return D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), o.alias("seq"),
        F.when(slot <= 2, F.lit("tool")).otherwise(F.lit("assistant")).alias("role"),
        tool.alias("name"),
        F.when(slot <= 2, F.concat(F.lit('{"order": '), o, F.lit("}")))
        .when(slot == 3, F.concat(F.lit('[{"name": "x", "args": {"o": '), o, F.lit("}}]")))
        .otherwise(F.concat(F.lit('{"recommendation": "Review", "order": '), o, F.lit("}"))).alias("content"),
        F.lit(False).alias("has_tool_calls"),
    )


@query("collect_tool_outputs", """WITH m AS (SELECT o_custkey AS id, o_orderkey AS o, o_orderkey % 5 AS slot FROM orders)
SELECT id, '{"order": ' || max(o) FILTER (WHERE slot = 0) || '}' AS financial_health, '{"order": ' || max(o) FILTER (WHERE slot = 1) || '}' AS client_engagement,
  '{"order": ' || max(o) FILTER (WHERE slot = 2) || '}' AS business_profile, '{"recommendation": "Review", "order": ' || max(o) FILTER (WHERE slot = 4) || '}' AS final_text FROM m GROUP BY 1""")
def collect_tool_outputs(spark, sf):
    return C.collect_tool_outputs(message_log(spark, sf))


def risk_rows(spark, sf):
    """Customer-snapshot rows with a deterministic stand-in churn probability."""
    iv = B.infer_intervals(daily_events(spark, sf), D.SNAPSHOTS, daily=True)
    p = F.pmod(F.col("customerid").cast("bigint") * 37 + F.col("n_events") * 11, F.lit(101)) / F.lit(100.0)
    return iv.withColumns({"churn_prob": p, "without_prob": F.pmod(F.col("customerid").cast("bigint") * 53, F.lit(101)) / F.lit(100.0)})


RISK_SQL = f"""{INTERVAL_SQL},
rk AS (SELECT customerid, snapshot_date, billing_interval, round_even(raw_confidence, 4) AS conf, n_events, n_gaps, ((CAST(customerid AS BIGINT) * 37 + n_events * 11) % 101) / 100.0::DOUBLE AS p,
  ((CAST(customerid AS BIGINT) * 53) % 101) / 100.0::DOUBLE AS q FROM iv)"""


@query("decide", f"""WITH {RISK_SQL} SELECT customerid, snapshot_date, CASE WHEN conf < 0.5 THEN 'Review' WHEN p <= 0.45 THEN 'Continue' WHEN p >= 0.7 THEN 'No-Go' ELSE 'Review' END AS recommendation,
  CASE WHEN conf < 0.5 THEN 'low_interval_confidence' WHEN p <= 0.45 THEN 'low_churn_risk' WHEN p >= 0.7 THEN 'high_churn_risk' ELSE 'borderline_churn_risk' END AS reason,
  conf >= 0.5 AND (p <= 0.45 OR p >= 0.7) AS auto_decided FROM rk""")
def decide(spark, sf):
    out = risk_rows(spark, sf).withColumn("d", DE.decide(F.col("churn_prob"), F.col("interval_confidence")))
    return out.select("customerid", "snapshot_date", "d.recommendation", "d.reason", "d.auto_decided")


@query("risk_tier_label", f"""WITH {RISK_SQL} SELECT customerid, snapshot_date, CASE WHEN p >= 0.7 THEN 'High risk' WHEN p <= 0.45 THEN 'Low risk' ELSE 'Medium risk' END AS tier,
  CASE WHEN abs(p - 0.5) * 2 >= 0.6 THEN 'High' WHEN abs(p - 0.5) * 2 >= 0.3 THEN 'Medium' ELSE 'Low' END AS margin FROM rk""")
def risk_tier_label(spark, sf):
    return risk_rows(spark, sf).select(
        "customerid", "snapshot_date", DE.risk_tier_label(F.col("churn_prob")).alias("tier"),
        F.split(DE.margin_label(F.col("churn_prob")), " ")[0].alias("margin"))


@query("threshold_sweep", f"""WITH {RISK_SQL}, g AS (SELECT c::DOUBLE AS c, g::DOUBLE AS g, m::DOUBLE AS m FROM (VALUES (0.2),(0.3),(0.4),(0.5)) t(c), (VALUES (0.6),(0.7),(0.8)) u(g), (VALUES (0.3),(0.5),(0.7)) v(m) WHERE c < g),
s AS (SELECT c, g, m, count(*) AS n, count(*) FILTER (WHERE conf >= m AND p <= c) AS cn, count(*) FILTER (WHERE conf >= m AND p >= g) AS gn FROM g, rk GROUP BY ALL)
SELECT c AS continue_max_risk, g AS nogo_min_risk, m AS min_interval_confidence, n, cn AS continue_n, n - cn - gn AS review_n, gn AS nogo_n,
  round(100.0 * cn / n, 2) AS continue_pct, round(100.0 * (n - cn - gn) / n, 2) AS review_pct, round(100.0 * gn / n, 2) AS nogo_pct, c = 0.4 AND g = 0.7 AND m = 0.5 AS is_config_default FROM s""")
def threshold_sweep(spark, sf):
    return DE.threshold_sweep(risk_rows(spark, sf), cfg=DecisionConfig(continue_max_risk=0.40))


@query("dual_model_summary", f"""WITH {RISK_SQL}, d AS (SELECT *, CASE WHEN conf < 0.5 THEN 'Review' WHEN p <= 0.45 THEN 'Continue' WHEN p >= 0.7 THEN 'No-Go' ELSE 'Review' END AS w,
  CASE WHEN conf < 0.5 THEN 'Review' WHEN q <= 0.45 THEN 'Continue' WHEN q >= 0.7 THEN 'No-Go' ELSE 'Review' END AS o FROM rk)
SELECT count(*) AS n_customers, round(count(*) FILTER (WHERE w = o) / count(*), 4) AS agreement_rate, count(*) FILTER (WHERE w <> o) AS n_disagree,
  count(*) FILTER (WHERE w = 'Continue') AS with_continue, count(*) FILTER (WHERE w = 'Review') AS with_review, count(*) FILTER (WHERE w = 'No-Go') AS with_nogo,
  count(*) FILTER (WHERE o = 'Continue') AS without_continue, count(*) FILTER (WHERE o = 'Review') AS without_review, count(*) FILTER (WHERE o = 'No-Go') AS without_nogo,
  round(avg(p), 4) AS mean_p_with, round(avg(q), 4) AS mean_p_without, round(avg(p - q), 4) AS mean_p_delta, round(sum(p * n_events), 2) AS total_expected_loss,
  round(avg(conf), 4) AS mean_interval_confidence FROM d""")
def dual_model_summary(spark, sf):
    rows = risk_rows(spark, sf)
    rec = lambda c: DE.decide(F.col(c), F.col("interval_confidence"))["recommendation"]
    return DE.dual_model_summary(rows.select(
        rec("churn_prob").alias("with_recommendation"), rec("without_prob").alias("without_recommendation"),
        F.col("churn_prob").alias("with_p"), F.col("without_prob").alias("without_p"),
        (F.col("churn_prob") * F.col("n_events")).alias("with_loss"), "interval_confidence"))


@query("billing_case_studies", f"""WITH {RISK_SQL}, k AS (SELECT *, md5('0|' || customerid) AS h FROM rk WHERE snapshot_date = DATE '2000-06-01')
SELECT 'highest_risk' AS "case", (SELECT customerid FROM k ORDER BY p DESC, h DESC LIMIT 1) AS customerid UNION ALL
SELECT 'lowest_risk', (SELECT customerid FROM k ORDER BY p, h LIMIT 1) UNION ALL
SELECT 'recurring_review_case', (SELECT customerid FROM k WHERE n_events >= 2 ORDER BY abs(p - 0.5), h DESC LIMIT 1)""")
def billing_case_studies(spark, sf):
    rows = risk_rows(spark, sf).filter(F.col("snapshot_date") == F.lit(D.AS_OF))
    out = R.billing_case_studies(rows.select("customerid", "churn_prob", "n_events"))
    return out.select("case", "customerid")


@query("explain_interval", f"""WITH {RISK_SQL} SELECT r.customerid, r.snapshot_date,
  CASE WHEN billing_interval = 'insufficient_history' THEN 'because only ' || n_events || ' billing day(s)' WHEN billing_interval = 'irregular' THEN 'because the gaps between'
   WHEN billing_interval = 'one_time_candidate' THEN 'because there is essentially' WHEN billing_interval = 'mixed' THEN 'because invoice gaps cluster' ELSE 'because the typical gap' END AS opening,
  CASE WHEN billing_interval IN ('monthly','quarterly','annual') THEN 'across ' || n_gaps || ' observed cycle(s)' ELSE '' END AS cycles FROM rk r""")
def explain_interval(spark, sf):
    c = F.col
    text = X.explain_interval(
        c("billing_interval"), c("interval_confidence"), c("n_events"), c("n_gaps"), c("median_gap_days"), c("gap_cv"),
        c("dominant_base"), c("dominant_share"), c("n_distinct_bases"), c("days_since_last"))
    rows = risk_rows(spark, sf).withColumn("text", text)
    start = F.regexp_extract("text", r"(because only \d+ billing day\(s\)|because (?:the typical gap|the gaps between|there is essentially|invoice gaps cluster))", 1)
    return rows.select(
        "customerid", "snapshot_date", start.alias("opening"),
        F.regexp_extract("text", r"(across \d+ observed cycle\(s\))", 1).alias("cycles"))


def _phrase_sql(column: str) -> str:
    from ledgerspark.functions.lookups import INTERVAL_PHRASES

    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INTERVAL_PHRASES.items()) + " END"


WHOLE = "printf('%.0f%%', round_even({c} * 100, 0))"


@query("explain_decision", f"""WITH {RISK_SQL}, d AS (SELECT *, CASE WHEN conf < 0.5 THEN 'low' WHEN p <= 0.45 THEN 'Continue' WHEN p >= 0.7 THEN 'No-Go' ELSE 'Review' END AS k,
  {WHOLE.format(c='p')} AS pt, {WHOLE.format(c='conf')} AS ct, CASE WHEN p <= 0.3 THEN 'low' WHEN p < 0.7 THEN 'elevated' ELSE 'high' END AS risk FROM rk),
b AS (SELECT *, 'Using the model **with interval features**, predicted chance of dollar churn is **' || pt || '** (' || risk || ' risk)' AS base,
  'interval confidence (' || ct || ') is high enough to auto-decide, so the recommendation is ' AS sure FROM d)
SELECT customerid, snapshot_date, CASE k WHEN 'low' THEN 'We recommended **Review** (with interval features) because the billing-cycle signal is too uncertain (confidence ' || ct || ' for “' || {_phrase_sql('billing_interval')}
   || '”). Thin or ambiguous history is treated as a data-quality issue — we do not auto Continue or auto No-Go until the cycle is clearer.'
  WHEN 'Continue' THEN base || '. That sits below the Continue threshold, and ' || sure || '**Continue** — proceed with onboarding.'
  WHEN 'No-Go' THEN base || '. That sits above the No-Go threshold, and ' || sure || '**No-Go** — decline or escalate for credit risk.'
  ELSE base || '. That sits between the Continue and No-Go bands (or still needs analyst judgment), so the recommendation is **Review**.' END AS explanation FROM b""")
def explain_decision(spark, sf):
    rows = risk_rows(spark, sf).withColumn("d", DE.decide(F.col("churn_prob"), F.col("interval_confidence")))
    text = X.explain_decision(
        F.col("d.recommendation"), F.col("d.reason"), F.col("d.detail"), F.col("churn_prob"),
        F.col("interval_confidence"), F.col("billing_interval"))
    return rows.select("customerid", "snapshot_date", text.alias("explanation"))


@query("compare_decisions", f"""WITH {RISK_SQL}, d AS (SELECT *, CASE WHEN conf < 0.5 THEN 'Review' WHEN p <= 0.45 THEN 'Continue' WHEN p >= 0.7 THEN 'No-Go' ELSE 'Review' END AS w,
  CASE WHEN conf < 0.5 THEN 'Review' WHEN q <= 0.45 THEN 'Continue' WHEN q >= 0.7 THEN 'No-Go' ELSE 'Review' END AS o FROM rk)
SELECT customerid, snapshot_date, CASE WHEN w = o THEN 'Both models agree on **' || w || '**.' ELSE 'The models **disagree**: with interval → **' || w || '**, without interval → **' || o || '**.' END AS opening FROM d""")
def compare_decisions(spark, sf):
    rec = lambda c: DE.decide(F.col(c), F.col("interval_confidence"))["recommendation"]
    text = X.compare_decisions(rec("churn_prob"), rec("without_prob"), F.col("churn_prob"), F.col("without_prob"))
    return risk_rows(spark, sf).select(
        "customerid", "snapshot_date",
        F.regexp_extract(text, r"^(Both models agree on \*\*[^*]+\*\*\.|The models \*\*disagree\*\*: .*?without interval → \*\*[^*]+\*\*\.)", 1).alias("opening"))


def driver_rows(spark, sf):
    """Owner rows with contributions that are simple functions of the owner features."""
    feats = P.landlord_features(D.landlords(spark, sf), D.AS_OF_YEAR)
    drivers = F.array(
        F.struct(F.lit("LandlordAge").alias("feature"), (F.coalesce("LandlordAge", F.lit(0.0)) / 1000 - 0.15).alias("contribution"), F.col("LandlordAge").cast("string").alias("value")),
        F.struct(F.lit("Area").alias("feature"), (F.coalesce("Area", F.lit(0.0)) / 100000 - 0.05).alias("contribution"), F.col("Area").cast("string").alias("value")),
        F.struct(F.lit("TotalPopulationAround").alias("feature"), (F.col("TotalPopulationAround") / 100000 - 0.02).alias("contribution"), F.col("TotalPopulationAround").cast("string").alias("value")),
        F.struct(F.lit("PreferredIndustry").alias("feature"), F.when(F.col("PreferredIndustry").isNull(), -0.01).otherwise(0.003).alias("contribution"), F.col("PreferredIndustry").alias("value")),
    )
    return feats.withColumn("drivers", drivers)


DRIVER_SQL = f"""{LANDLORD_FEATURE_SQL},
dr AS (SELECT LandLordID, 'LandlordAge' AS feature, coalesce(LandlordAge, 0) / 1000 - 0.15 AS c FROM lf UNION ALL SELECT LandLordID, 'Area', coalesce(Area, 0) / 100000 - 0.05 FROM lf
  UNION ALL SELECT LandLordID, 'TotalPopulationAround', TotalPopulationAround / 100000 - 0.02 FROM lf UNION ALL SELECT LandLordID, 'PreferredIndustry', CASE WHEN PreferredIndustry IS NULL THEN -0.01 ELSE 0.003 END FROM lf)"""


@query("top_k_drivers", f"""WITH {DRIVER_SQL}, p AS (SELECT LandLordID, string_agg(feature, ',' ORDER BY c DESC, feature) AS positive FROM (SELECT *, row_number() OVER (PARTITION BY LandLordID ORDER BY c DESC, feature) AS k FROM dr WHERE c > 0) WHERE k <= 2 GROUP BY 1),
n AS (SELECT LandLordID, string_agg(feature, ',' ORDER BY c, feature) AS negative FROM (SELECT *, row_number() OVER (PARTITION BY LandLordID ORDER BY c, feature) AS k FROM dr WHERE c < 0) WHERE k <= 2 GROUP BY 1)
SELECT LandLordID, coalesce(positive, '') AS positive, coalesce(negative, '') AS negative FROM lf LEFT JOIN p USING (LandLordID) LEFT JOIN n USING (LandLordID)""")
def top_k_drivers(spark, sf):
    out = driver_rows(spark, sf).withColumn("t", R.top_k_drivers(F.col("drivers"), 2))
    names = lambda side: F.array_join(F.transform(F.col(f"t.{side}"), lambda d: d["feature"]), ",")
    return out.select("LandLordID", names("positive").alias("positive"), names("negative").alias("negative"))


@query("enrich_driver", f"""WITH {DRIVER_SQL} SELECT LandLordID, feature, CASE WHEN c > 0 THEN 'up' ELSE 'down' END AS direction, abs(c) < 0.001 AS negligible FROM dr""")
def enrich_driver(spark, sf):
    long = driver_rows(spark, sf).select("LandLordID", F.explode("drivers").alias("d"))
    return long.withColumn("e", X.enrich_driver(F.col("d"))).select("LandLordID", "e.feature", "e.direction", "e.negligible")


@query("explain_drivers", """SELECT c_custkey, 'Overall risk tier: **' || CASE WHEN c_custkey % 100 >= 70 THEN 'High risk' WHEN c_custkey % 100 <= 45 THEN 'Low risk' ELSE 'Medium risk' END
  || '**. The single biggest driver is **' || CASE WHEN c_custkey % 7 + 1 >= c_custkey % 5 + 1 THEN 'days since last invoice** , which is currently **raising' ELSE 'flag: monthly cadence** , which is currently **lowering' END
  || '** churn risk. Factors pushing risk up: days since last invoice (value ' || c_custkey || '). Factors pulling risk down: flag: monthly cadence (value yes).' AS told FROM customer""".replace("** ,", "**,"))
def explain_drivers(spark, sf):
    k = F.col("c_custkey")
    rows = D.table(spark, sf, "customer").select(
        k,
        F.array(F.struct(F.lit("recency_days").alias("feature"), ((F.pmod(k, F.lit(7)) + 1) / 10.0).alias("contribution"), k.cast("double").alias("value"))).alias("ups"),
        F.array(F.struct(F.lit("is_monthly").alias("feature"), (-(F.pmod(k, F.lit(5)) + 1) / 10.0).alias("contribution"), F.lit(1.0).alias("value"))).alias("downs"))
    tier = DE.risk_tier_label(F.pmod(k, F.lit(100)) / 100.0)
    return rows.select(k, X.explain_drivers(tier, F.col("ups"), F.col("downs"), F.lit(True)).alias("told"))


def banded(spark, sf):
    # Read as scores, as reference and for the case pick: written once.
    scores = materialise(shrunk(spark, sf), "scores")
    placed = R.percentile_vs_reference(scores, "AdjustedScore", scores, "AdjustedScore").select(
        "LandLordID", "TenantCount", "AdjustedScore", "percentile")
    rows = driver_rows(spark, sf).join(placed, "LandLordID")
    top = R.top_k_drivers(F.col("drivers"), 5)
    return rows.withColumn("t", top).withColumns({
        "band": R.quality_band(F.col("percentile")), "confidence": R.confidence_level(F.col("TenantCount")),
        "ups": F.transform("t.positive", X.enrich_driver), "downs": F.transform("t.negative", X.enrich_driver),
    })


@query("interpret_score", f"""WITH {PERCENTILE_SQL} SELECT LandLordID, CASE WHEN pct >= 70 THEN 'This landlord appears strong based on available tenant signals' WHEN pct <= 30 THEN 'This landlord appears weak based on available tenant signals'
  ELSE 'This landlord looks mid-range based on available tenant signals' END AS opening FROM pc""")
def interpret_score(spark, sf):
    rows = banded(spark, sf)
    told = X.interpret_score(F.col("band"), F.col("confidence"), F.col("TenantCount"), F.col("ups"), F.col("downs"))
    return rows.withColumn("i", told).select("LandLordID", F.split("i.final_interpretation", ", ")[0].alias("opening")).withColumn(
        "opening", F.rtrim(F.regexp_replace("opening", r"\.$", "")))


@query("case_studies")
def case_studies(spark, sf):
    rows = banded(spark, sf)
    rows = materialise(rows.select("LandLordID", "TenantCount", "AdjustedScore", "ups", "downs"), "cases")
    picked = R.select_case_studies(rows.select("LandLordID", "TenantCount", "AdjustedScore"))
    # At most n_good + n_bad + n_mid rows.
    cases = rows.drop("TenantCount", "AdjustedScore").join(picked, "LandLordID")
    text = X.case_narrative(
        F.col("LandLordID"), F.col("band"), F.col("AdjustedScore"), F.lit(None).cast("double"), F.col("TenantCount"),
        F.col("ups"), F.col("downs"))
    return cases.select("LandLordID", "band", F.round("AdjustedScore", 6).alias("AdjustedScore"), "TenantCount", text.alias("narrative"))
