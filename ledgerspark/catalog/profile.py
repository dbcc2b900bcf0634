"""Profiles of invoices, events and plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.catalog.billing import EVENTS_SQL, INVOICES_SQL, daily_events
from ledgerspark.catalog.portfolio import bridge, companies
from ledgerspark.catalog.registry import query
from ledgerspark.functions.numeric import rounded
from ledgerspark.operators import billing as B
from ledgerspark.operators import profile as P
from ledgerspark.operators import quality as Q
from ledgerspark.sources import domain as D


@query("identifier_report", """
SELECT count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderpriority) AS n_accounts,
  count(DISTINCT (o_custkey, o_orderpriority)) AS n_pairs,
  count(DISTINCT (o_custkey, o_orderpriority)) = count(DISTINCT o_custkey) AS customer_id_is_unique,
  CASE WHEN count(DISTINCT (o_custkey, o_orderpriority)) = count(DISTINCT o_custkey) THEN 'o_custkey' ELSE 'o_orderpriority,o_custkey' END AS key_columns
FROM orders""")
def identifier_report(spark, sf):
    return P.identifier_report(D.table(spark, sf, "orders"), "o_custkey", "o_orderpriority")


@query("quality_report", f"""WITH {INVOICES_SQL}
SELECT count(*) AS n_rows, avg(CASE WHEN customerid IS NULL THEN 1.0 ELSE 0 END) AS null_customer_rate,
  avg(CASE WHEN date IS NULL THEN 1.0 ELSE 0 END) AS null_date_rate, avg(CASE WHEN amount IS NULL THEN 1.0 ELSE 0 END) AS null_amount_rate,
  avg(CASE WHEN amount <= 0 THEN 1.0 ELSE 0 END) AS non_positive_amount_rate, min(date) AS date_min, max(date) AS date_max FROM invoices""")
def quality_report(spark, sf):
    return P.quality_report(D.invoices(spark, sf))


INVOICE_PROFILE_SQL = f"""WITH {INVOICES_SQL},
dc AS (SELECT customerid, date, count(*) AS n FROM invoices GROUP BY ALL),
pc AS (SELECT customerid, count(*) AS n FROM invoices GROUP BY ALL)
SELECT (SELECT count(*) FROM invoices) AS n_rows, 0.0 AS null_customer_rate, 0.0 AS null_date_rate, 0.0 AS null_amount_rate,
  0.0 AS non_positive_amount_rate, (SELECT min(date) FROM invoices) AS date_min, (SELECT max(date) FROM invoices) AS date_max,
  (SELECT min(amount) FROM invoices) AS amount_min, (SELECT round(avg(amount), 4) FROM invoices) AS amount_mean,
  (SELECT max(amount) FROM invoices) AS amount_max,
  (SELECT round(quantile_cont(amount, 0.5), 4) FROM invoices) AS amount_p50, (SELECT round(quantile_cont(amount, 0.75), 4) FROM invoices) AS amount_p75,
  (SELECT round(quantile_cont(amount, 0.95), 4) FROM invoices) AS amount_p95, (SELECT round(quantile_cont(amount, 0.99), 4) FROM invoices) AS amount_p99,
  (SELECT count(*) FROM dc) AS n_customer_days, (SELECT round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END), 6) FROM dc) AS multi_invoice_day_rate,
  (SELECT count(*) FROM dc WHERE n > 1) AS n_multi_invoice_days, (SELECT max(n) FROM dc) AS max_invoices_on_one_day,
  (SELECT count(*) FROM pc) AS n_customers, (SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 6) FROM pc) AS share_single_invoice,
  (SELECT round(avg(n), 6) FROM pc) AS invoices_mean, (SELECT max(n) FROM pc) AS invoices_max,
  (SELECT quantile_cont(n, 0.5) FROM pc) AS invoices_p50, (SELECT quantile_cont(n, 0.75) FROM pc) AS invoices_p75,
  (SELECT round(quantile_cont(n, 0.95), 4) FROM pc) AS invoices_p95"""


@query("profile_invoices", INVOICE_PROFILE_SQL)
def profile_invoices(spark, sf):
    out = P.profile_invoices(D.invoices(spark, sf), exact=True)
    out = rounded(out, 4, ["amount_mean", "amount_p50", "amount_p75", "amount_p95", "amount_p99", "invoices_p95"])
    return rounded(out, 6, ["multi_invoice_day_rate", "share_single_invoice", "invoices_mean"])


@query("profile_events", f"""WITH {EVENTS_SQL},
pc AS (SELECT customerid, count(*) AS n FROM events_d GROUP BY ALL),
gp AS (SELECT date_diff('day', lag(date) OVER (PARTITION BY customerid ORDER BY date), date) AS gap FROM events_d)
SELECT (SELECT count(*) FROM events_d) AS n_events, (SELECT round(avg(event_amount), 4) FROM events_d) AS event_amount_mean,
  (SELECT round(max(event_amount), 2) FROM events_d) AS event_amount_max, (SELECT round(avg(n_invoices), 6) FROM events_d) AS mean_invoices_per_event,
  (SELECT round(1 - count(*) / sum(n_invoices), 6) FROM events_d) AS same_day_collapse_ratio,
  (SELECT round(quantile_cont(event_amount, 0.5), 4) FROM events_d) AS event_amount_p50,
  (SELECT count(*) FROM pc) AS n_customers, (SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END), 6) FROM pc) AS share_single_event,
  (SELECT round(avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0 END), 6) FROM pc) AS share_recurring, (SELECT max(n) FROM pc) AS events_max,
  (SELECT quantile_cont(n, 0.5) FROM pc) AS events_p50, (SELECT quantile_cont(n, 0.75) FROM pc) AS events_p75,
  (SELECT round(quantile_cont(n, 0.95), 4) FROM pc) AS events_p95, (SELECT count(gap) FROM gp) AS n_gaps,
  (SELECT round(avg(gap), 4) FROM gp) AS gap_mean, (SELECT quantile_cont(gap, 0.25) FROM gp) AS gap_p25,
  (SELECT quantile_cont(gap, 0.5) FROM gp) AS gap_p50, (SELECT quantile_cont(gap, 0.75) FROM gp) AS gap_p75,
  (SELECT round(quantile_cont(gap, 0.9), 4) FROM gp) AS gap_p90""")
def profile_events(spark, sf):
    events = daily_events(spark, sf)
    out = P.profile_events(events, B.event_gaps(events, daily=True), exact=True)
    out = rounded(out, 4, ["event_amount_mean", "event_amount_p50", "events_p95", "gap_mean", "gap_p90"])
    out = rounded(out, 2, ["event_amount_max"])
    return rounded(out, 6, ["mean_invoices_per_event", "same_day_collapse_ratio", "share_single_event", "share_recurring"])


def _profile_sql(table: str, cols: dict[str, str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct, count(DISTINCT {c}) AS n_unique,
        coalesce((SELECT CAST({c} AS VARCHAR) FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), '') AS top_value
        FROM {table}"""
        for c, t in cols.items()
    ]
    return " UNION ALL ".join(parts)


@query("profile_columns", "WITH " + D.COMPANIES_SQL.strip() + " " + _profile_sql("companies", {
    "CompanyStatus": "string", "PrimaryType": "string", "YearFounded": "int", "OriginCountry": "string",
    "OriginCity": "string", "CompanyID": "string"}))
def profile_columns(spark, sf):
    return P.profile_columns(D.companies(spark, sf).select(
        "CompanyStatus", "PrimaryType", "YearFounded", "OriginCountry", "OriginCity", "CompanyID"))


def _summary_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skew, round(kurtosis({c}), 4) AS kurtosis,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75
        FROM {table}""" for c in cols)


@query("numeric_summary", _summary_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def numeric_summary(spark, sf):
    out = P.numeric_summary(
        D.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(out, 4, [c for c in out.columns if c not in ("column", "count")])


@query("category_summary", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS count,
    round(count(*) * 100.0 / (SELECT count(*) FROM lineitem), 2) AS pct FROM lineitem GROUP BY {c}
    ORDER BY count(*) DESC, {c} NULLS LAST LIMIT 10)""" for c in ("l_returnflag", "l_linestatus")))
def category_summary(spark, sf):
    return P.category_summary(D.table(spark, sf, "lineitem"))


@query("portfolio_size_stats", f"""WITH {D.TENANT_LISTS_SQL}, sz AS (SELECT LandLordID, count(*) AS n FROM bridge GROUP BY 1)
SELECT count(*) AS total_owners, CAST(sum(n) AS BIGINT) AS distinct_links, round(avg(n), 6) AS size_mean, round(stddev_samp(n), 6) AS size_std,
  min(n) AS size_min, max(n) AS size_max, count(*) FILTER (WHERE n = 1) AS single_member_owners,
  quantile_cont(n, 0.25) AS size_p25, quantile_cont(n, 0.5) AS size_p50, quantile_cont(n, 0.75) AS size_p75,
  (SELECT count(*) FROM bridge) AS total_links, (SELECT count(DISTINCT CompanyID) FROM bridge) AS unique_members FROM sz""")
def portfolio_size_stats(spark, sf):
    return rounded(P.portfolio_size_stats(bridge(spark, sf)), 6, ["size_mean", "size_std"])


@query("portfolio_size_buckets", f"""WITH {D.TENANT_LISTS_SQL}, sz AS (SELECT LandLordID, count(*) AS n FROM bridge GROUP BY 1),
b(position, bucket, low, high) AS (VALUES (0,'1',1,1),(1,'2',2,2),(2,'3',3,3),(3,'4',4,4),(4,'5-9',5,9),(5,'10-19',10,19),
  (6,'20-49',20,49),(7,'50-99',50,99),(8,'100+',100,1000000000))
SELECT position, bucket, (SELECT count(*) FROM sz WHERE n BETWEEN low AND high) AS owners FROM b""")
def portfolio_size_buckets(spark, sf):
    return P.size_buckets(bridge(spark, sf))


@query("largest_portfolios", f"""WITH {D.TENANT_LISTS_SQL}
SELECT LandLordID, count(*) AS n_companies FROM bridge GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def largest_portfolios(spark, sf):
    return P.largest_portfolios(bridge(spark, sf))


COMPANY_COLUMNS = (
    "CompanyID", "CompanyStatus", "PrimaryType", "YearFounded", "OriginCountry", "OriginCity", "Rank",
    "SalesOfMainProduct", "SalesOfOtherProduct", "MonthlyBudget", "Investments",
)


@query("null_rates", f"WITH {D.COMPANIES_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM companies"""
    for c in COMPANY_COLUMNS))
def null_rates(spark, sf):
    return P.null_rates(companies(spark, sf, clean=False).select(*COMPANY_COLUMNS))


@query("top_correlations", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 4) AS abs_corr FROM lineitem"
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"),
                 ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax"))))
def top_correlations(spark, sf):
    return P.top_correlations(
        D.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("table_shape", """SELECT 'orders' AS name, count(*) AS n_rows, 3 AS n_columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderdate, o_orderstatus FROM orders)) AS duplicate_rows FROM orders""")
def table_shape(spark, sf):
    return P.table_shape(D.table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderstatus"), "orders")


@query("id_integrity", """SELECT 'lineitem' AS name, 'l_orderkey' AS id_column, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_unique,
  count(*) - count(l_orderkey) AS n_null, count(*) - count(DISTINCT l_orderkey) AS n_duplicate FROM lineitem""")
def id_integrity(spark, sf):
    return P.id_integrity(D.table(spark, sf, "lineitem"), "l_orderkey", "lineitem")


@query("inspect_list_format", f"""WITH {D.TENANT_LISTS_SQL},
h AS (SELECT trim(AllCompanyID) AS raw FROM tenant_lists WHERE AllCompanyID IS NOT NULL ORDER BY md5('0|' || AllCompanyID), AllCompanyID LIMIT 200)
SELECT count(*) AS of_first_n, CAST(0 AS BIGINT) AS already_list,
  count(*) FILTER (WHERE raw LIKE '[%' AND contains(raw, '''') AND NOT contains(substr(raw, 1, 3), '"')) AS looks_like_python_list,
  count(*) FILTER (WHERE raw LIKE '[%' AND NOT (contains(raw, '''') AND NOT contains(substr(raw, 1, 3), '"'))) AS looks_like_json,
  count(*) FILTER (WHERE raw NOT LIKE '[%' AND contains(raw, ',')) AS looks_like_csv FROM h""")
def inspect_list_format(spark, sf):
    return P.inspect_list_format(D.tenant_lists(spark, sf))


@query("uniform_sample", """SELECT l_orderkey, count(*) AS lines FROM lineitem WHERE l_orderkey IN (
  SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 5000) GROUP BY 1""")
def uniform_sample(spark, sf):
    sample = P.uniform_sample(D.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5000)
    lines = D.table(spark, sf, "lineitem").select("l_orderkey")
    return lines.join(sample, lines.l_orderkey == sample.o_orderkey, "left_semi").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"))


@query("stratified_sample", """SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 40""")
def stratified_sample(spark, sf):
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return P.stratified_sample(orders, "o_orderkey", "o_orderpriority", 200)


@query("cut_impact", f"""WITH {D.COMPANIES_SQL},
u AS (SELECT *, CASE WHEN SalesOfMainProduct IS NOT NULL OR SalesOfOtherProduct IS NOT NULL THEN coalesce(SalesOfMainProduct,0) + coalesce(SalesOfOtherProduct,0) END AS rev FROM companies),
v AS (SELECT *, CASE WHEN abs(MonthlyBudget) >= 1e-9 THEN rev / MonthlyBudget END AS util FROM u),
c(cut, label) AS (VALUES (0.10, 'below_0.10'), (0.30, 'below_0.30'), (0.40, 'below_0.40'), (0.50, 'below_0.50'))
SELECT label AS metric, (SELECT count(*) FROM v WHERE MonthlyBudget > 0 AND util < cut) AS n,
  round(100.0 * (SELECT count(*) FROM v WHERE MonthlyBudget > 0 AND util < cut) / (SELECT count(*) FROM v WHERE MonthlyBudget > 0 AND util IS NOT NULL), 2) AS pct FROM c
UNION ALL SELECT 'missing_or_zero_budget', count(*) FILTER (WHERE MonthlyBudget IS NULL OR abs(MonthlyBudget) < 1e-9),
  round(100.0 * count(*) FILTER (WHERE MonthlyBudget IS NULL OR abs(MonthlyBudget) < 1e-9) / count(*), 2) FROM v
UNION ALL SELECT 'non_active', count(*) FILTER (WHERE CompanyStatus IN ('Out of Business','Not Making New Products','On Hold','Reducing Activity')),
  round(100.0 * count(*) FILTER (WHERE CompanyStatus IN ('Out of Business','Not Making New Products','On Hold','Reducing Activity')) / count(*), 2) FROM v""")
def cut_impact(spark, sf):
    from ledgerspark.sources.tables import rename_columns

    return P.cut_impact(rename_columns(D.companies(spark, sf)))


@query("retention_quantiles", f"""WITH {D.COMPANIES_SQL}, q AS (SELECT ReturningClient / TodaysClients AS v FROM companies WHERE TodaysClients > 0)
SELECT count(v) AS count, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.75), 4) AS p75,
  round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.95), 4) AS p95, round(avg(v), 4) AS mean FROM q""")
def retention_quantiles(spark, sf):
    base = D.companies(spark, sf).withColumn("v", P.retention(F.col("ReturningClient"), F.col("TodaysClients")))
    return P.quantile_row(base, "v")


@query("profile_report_invoices", f"""WITH p AS ({INVOICE_PROFILE_SQL}), u AS (UNPIVOT (SELECT CAST(COLUMNS(* EXCLUDE (date_min, date_max)) AS DOUBLE) FROM p) ON COLUMNS(*) INTO NAME metric VALUE value)
SELECT 'invoices' AS section, metric, value FROM u""")
def profile_report_invoices(spark, sf):
    return P.metric_rows(profile_invoices(spark, sf), "invoices", ("date_min", "date_max"))


@query("derive_findings_invoices")
def derive_findings_invoices(spark, sf):
    invoices = D.invoices(spark, sf)
    events = daily_events(spark, sf)
    found = Q.invoice_findings(
        P.profile_invoices(invoices), P.profile_events(events, B.event_gaps(events, daily=True)))
    return found.drop("detail")
