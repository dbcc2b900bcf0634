"""Data-quality checks and findings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerspark.catalog.portfolio import bridge, companies, landlords
from ledgerspark.catalog.registry import query
from ledgerspark.operators import billing as B
from ledgerspark.operators import portfolio as PF
from ledgerspark.operators import profile as P
from ledgerspark.operators import quality as Q
from ledgerspark.sources import domain as D
from ledgerspark.sources import tables as S

REFERENCE_DATE = dt.date(2020, 1, 1)


def raw_companies(spark, sf):
    return companies(spark, sf, clean=False)


def flat(findings):
    """Findings with the details as sorted key=value text."""
    pairs = F.array_sort(F.map_entries("detail"))
    detail = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return findings.withColumn("detail", detail)


FIELDS = '"check", severity, dataset, "column", message, detail'


def _rows(check: str, dataset: str, column: str | None, source: str, *findings: tuple[str, str, str, str]) -> str:
    """SELECTs of one check over a one-row source: (severity, message, detail, condition), all SQL expressions."""
    named = f"'{column}'" if column else "CAST(NULL AS VARCHAR)"
    return " UNION ALL ".join(
        f"""SELECT '{check}' AS "check", {sev} AS severity, '{dataset}' AS dataset, {named} AS "column", {msg} AS message, {detail} AS detail FROM ({source}) WHERE {cond}"""
        for sev, msg, detail, cond in findings)


def identifiers_sql(table: str, col: str, dataset: str) -> str:
    name = f"{dataset}.{col}"
    return _rows(
        "identifier_integrity", dataset, col,
        f"SELECT count(*) AS n, count(*) - count({col}) AS nulls, count(*) FILTER (WHERE trim(CAST({col} AS VARCHAR)) = '') AS blanks, count(DISTINCT {col}) AS uniq, "
        f"count(*) - count(DISTINCT {col}) - (CASE WHEN count(*) > count({col}) THEN 1 ELSE 0 END) AS dups FROM {table}",
        ("'CRITICAL'", f"'{name}: ' || nulls || ' null values'", "'null_count=' || nulls", "nulls > 0"),
        ("'CRITICAL'", f"'{name}: ' || blanks || ' blank/whitespace values'", "'blank_count=' || blanks", "blanks > 0"),
        ("'WARNING'", f"'{name}: ' || dups || ' duplicate values (' || uniq || ' unique out of ' || n || ' rows)'", "'duplicate_count=' || dups || ';unique_count=' || uniq", "dups > 0"),
        ("'INFO'", f"'{name}: all ' || n || ' values unique and non-null'", "''", "dups = 0"))


RELATIONSHIPS_SQL = """SELECT 'relationship_consistency' AS "check", 'WARNING' AS severity, 'LandLords' AS dataset, 'ActiveCompanies' AS "column",
  count(*) FILTER (WHERE off > 5) || ' landlords have ActiveCompanies count differing from parsed AllCompanyID count by >5' AS message,
  'material=' || count(*) FILTER (WHERE off > 5) || ';max_discrepancy=' || max(off) || ';sample_landlord_ids=' ||
  (SELECT string_agg(LandLordID, ',' ORDER BY LandLordID) FROM (SELECT LandLordID FROM rel WHERE off > 5 ORDER BY 1 LIMIT 5)) AS detail FROM rel"""
RELATED_SQL = """rel AS (SELECT LandLordID, abs(ActiveCompanies - coalesce(linked, 0)) AS off FROM landlords
  LEFT JOIN (SELECT LandLordID, count(*) AS linked FROM bridge GROUP BY 1) USING (LandLordID))"""


def dates_sql(table: str, dataset: str, columns: dict[str, str | None]) -> str:
    """columns: name -> SQL of the parsed date, or None where the table has no such column."""
    parts = []
    for c, parsed in columns.items():
        name = f"{dataset}.{c}"
        if parsed is None:
            parts.append(_rows("date_validity", dataset, c, "SELECT 1", ("'WARNING'", f"'{name}: column not found — skipping'", "''", "true")))
            continue
        odd = f"count(*) FILTER (WHERE {c} < 1800 OR {c} > 2020)" if c == "YearFounded" else "0"
        parts.append(_rows(
            "date_validity", dataset, c,
            f"SELECT count(*) FILTER (WHERE {c} IS NOT NULL AND {parsed} IS NULL) AS bad, count(*) FILTER (WHERE {parsed} > DATE '2020-01-01') AS fut, {odd} AS odd FROM {table}",
            ("'WARNING'", f"'{name}: ' || bad || ' values could not be parsed as dates'", "'parse_failures=' || bad", "bad > 0"),
            ("'WARNING'", f"'{name}: ' || fut || ' future dates (after 2020-01-01)'", "'future_count=' || fut", "fut > 0"),
            ("'WARNING'", f"'{name}: ' || odd || ' implausible year values (<1800 or >current year)'", "'bad_count=' || odd", "odd > 0"),
            ("'INFO'", f"'{name}: all non-null values parse correctly and are non-future'", "''", "bad = 0 AND fut = 0")))
    return " UNION ALL ".join(parts)


TEXT_DATE, EPOCH = "try_cast(LastUpdated AS DATE)", "CASE WHEN YearFounded IS NOT NULL THEN DATE '1970-01-01' END"
LANDLORD_DATES = {"LastUpdated": TEXT_DATE, "YearFounded": EPOCH}


def ranges_sql(table: str, dataset: str, columns, denominators) -> str:
    parts = [_rows(
        "range_check", dataset, c, f"SELECT count(*) FILTER (WHERE {c} < 0) AS neg, round(min(CAST({c} AS DOUBLE)), 4) AS lo FROM {table}",
        ("'WARNING'", f"'{dataset}.{c}: ' || neg || ' negative values'", "'min_value=' || lo || ';negative_count=' || neg", "neg > 0")) for c in columns]
    parts += [_rows(
        "denominator_guard", dataset, c, f"SELECT count(*) FILTER (WHERE {c} IS NULL OR {c} = 0) AS gap FROM {table}",
        ("'INFO'", f"'{dataset}.{c}: ' || gap || ' zero/null values — safe-division (epsilon) applied during feature engineering'", "'zero_null_count=' || gap", "gap > 0"))
        for c in denominators]
    return " UNION ALL ".join(parts)


def nesting_sql() -> str:
    return " UNION ALL ".join(_rows(
        "time_window_consistency", "Companies", a,
        f"SELECT *, coalesce(v / nullif(t, 0), 0) AS rate FROM (SELECT count(*) FILTER (WHERE {a} > {b}) AS v, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS t FROM companies)",
        ("CASE WHEN rate > 0.05 THEN 'WARNING' ELSE 'INFO' END", f"'{label}: ' || v || '/' || t || ' rows (' || printf('%.1f', rate * 100) || '%) have {a} > {b}'",
         "'total_valid=' || t || ';violation_pct=' || round(rate, 4) || ';violations=' || v", "true")) for a, b, label in Q.WINDOW_PAIRS)


def categories_sql(table: str, dataset: str, columns, rare: str) -> str:
    parts = []
    for c in columns:
        name, grouping = f"{dataset}.{c}", "consider grouping as ''Other''"
        seldom = f"SELECT v, k FROM (SELECT trim({c}) AS v, count(*) AS k FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) WHERE k / (SELECT count({c}) FROM {table}) < {rare}"
        parts.append(_rows(
            "category_quality", dataset, c,
            f"SELECT count(*) FILTER (WHERE trim({c}) = '') AS blank, count(DISTINCT {c}) AS a, count(DISTINCT lower(trim({c}))) AS b, (SELECT count(*) FROM ({seldom})) AS rare_n, "
            f"(SELECT string_agg(v, ',' ORDER BY k DESC, v) FROM ({seldom} ORDER BY k DESC, v LIMIT 5)) AS ex FROM {table}",
            ("'WARNING'", f"'{name}: ' || blank || ' blank/whitespace strings (should be NaN, not empty string)'", "'blank_count=' || blank", "blank > 0"),
            ("'WARNING'", f"'{name}: ' || (a - b) || ' extra unique values due to casing/whitespace (e.g. ''Active'' vs ''active'')'", "'normalised_unique=' || b || ';raw_unique=' || a", "a > b"),
            ("'INFO'", f"'{name}: ' || rare_n || ' rare categories (each <{float(rare):.0%} of non-null values) — {grouping}'", "'examples=' || ex || ';rare_category_count=' || rare_n", "rare_n > 0")))
    return " UNION ALL ".join(parts)


def snapshots_sql(table: str, col: str, dataset: str) -> str:
    return _rows(
        "snapshot_structure", dataset, col,
        f"SELECT count(*) FILTER (WHERE n > 1) AS dup, count(*) AS total FROM (SELECT {col}, count(*) AS n FROM {table} WHERE {col} IS NOT NULL GROUP BY 1)",
        ("'INFO'", f"'{dataset}: one row per {col} — cross-sectional dataset (no time series splits needed)'", "'total_entities=' || total", "dup = 0"),
        ("'WARNING'", f"'{dataset}: ' || dup || '/' || total || ' {col} values appear in multiple rows — dataset may have historical snapshots; use time-based splitting'",
         "'duplicate_id_count=' || dup || ';total_id_count=' || total", "dup > 0"))


COVERAGE_SQL = _rows(
    "bridge_coverage", "Bridge", "CompanyID",
    "SELECT *, coalesce(miss / nullif(tot, 0), 0) AS rate FROM (SELECT count(*) FILTER (WHERE c.CompanyID IS NULL) AS miss, count(*) AS tot, "
    "(SELECT string_agg(CompanyID, ',' ORDER BY CompanyID) FROM (SELECT DISTINCT CompanyID FROM bridge WHERE CompanyID NOT IN (SELECT CompanyID FROM companies) ORDER BY 1 LIMIT 5)) AS ids "
    "FROM (SELECT DISTINCT CompanyID FROM bridge) b LEFT JOIN (SELECT DISTINCT CompanyID FROM companies) c ON b.CompanyID = c.CompanyID)",
    ("CASE WHEN rate > 0.2 THEN 'CRITICAL' WHEN rate > 0.05 THEN 'WARNING' ELSE 'INFO' END",
     "miss || '/' || tot || ' unique CompanyIDs in bridge not found in Companies (' || printf('%.1f', rate * 100) || '% unmatched)'",
     "'missing_count=' || miss || ';missing_pct=' || round(rate, 4) || ';sample_missing=' || coalesce(ids, '') || ';total_bridge_ids=' || tot", "true"))


def missing_sql(table: str, dataset: str, columns) -> str:
    rates = " UNION ALL ".join(f"SELECT '{c}' AS c, 1 - count({c}) / count(*) AS rate FROM {table}" for c in columns)
    listed = lambda cond: f"string_agg(c || '=' || printf('%.1f', rate * 100) || '%', ',' ORDER BY rate DESC, c DESC) FILTER (WHERE {cond})"
    hi, md = "rate >= 0.5", "rate >= 0.2 AND rate < 0.5"
    return _rows(
        "missing_rates", dataset, None,
        f"SELECT count(*) FILTER (WHERE {hi}) AS hi, count(*) FILTER (WHERE {md}) AS md, {listed(hi)} AS his, {listed(md)} AS mds FROM ({rates})",
        ("'CRITICAL'", f"'{dataset}: ' || hi || ' columns with >=50% missing values'", "'columns=' || his", "hi > 0"),
        ("'WARNING'", f"'{dataset}: ' || md || ' columns with 20%–50% missing values'", "'columns=' || mds", "md > 0"),
        ("'INFO'", f"'{dataset}: all columns below 20% missing threshold'", "''", "hi = 0 AND md = 0"))


LANDLORD_COLUMNS = "LandLordID ActiveCompanies Area TotalPopulationAround PreferredIndustry OriginCity OriginCountry LastUpdated YearFounded".split()
COMPANY_COLUMNS = (
    "CompanyID CompanyStatus PrimaryType YearFounded OriginCountry OriginCity Rank SalesOfMainProduct SalesOfOtherProduct MonthlyBudget Investments "
    "TodaysClients ReturningClient TotalActiveClients ClientsInTheLast7Days ClientsInTheLast6Months ClientsInTheLast12Months "
    "TotalClientsInTheLast7Days TotalClientsInTheLast6Months TotalClientsInTheLast12Months"
).split()
BOTH_SQL = f"WITH {D.LANDLORDS_SQL}, {D.COMPANIES_SQL}, {D.TENANT_LISTS_SQL}, {RELATED_SQL}"


@query("check_identifiers", identifiers_sql("orders", "o_custkey", "orders"))
def check_identifiers(spark, sf):
    return flat(Q.check_identifiers(D.table(spark, sf, "orders"), "o_custkey", "orders"))


@query("check_relationships", f"{BOTH_SQL} {RELATIONSHIPS_SQL}")
def check_relationships(spark, sf):
    return flat(Q.check_relationships(landlords(spark, sf), bridge(spark, sf)))


@query("check_dates", f"WITH {D.LANDLORDS_SQL} " + dates_sql("landlords", "LandLords", {**LANDLORD_DATES, "Checked": None}))
def check_dates(spark, sf):
    return flat(Q.check_dates(landlords(spark, sf), ("LastUpdated", "YearFounded", "Checked"), "LandLords", REFERENCE_DATE))


@query("check_ranges", f"WITH {D.COMPANIES_SQL} " + ranges_sql("companies", "Companies", Q.NON_NEGATIVE["companies"], ["MonthlyBudget"]))
def check_ranges(spark, sf):
    return flat(Q.check_ranges(raw_companies(spark, sf), Q.NON_NEGATIVE["companies"], "Companies"))


@query("check_window_nesting", f"WITH {D.COMPANIES_SQL} " + nesting_sql())
def check_window_nesting(spark, sf):
    return flat(Q.check_window_nesting(raw_companies(spark, sf)))


@query("check_categories", f"WITH {D.COMPANIES_SQL} " + categories_sql("companies", "Companies", ("CompanyStatus", "OriginCity"), "0.10"))
def check_categories(spark, sf):
    return flat(Q.check_categories(raw_companies(spark, sf), ("CompanyStatus", "OriginCity"), "Companies", rare=0.10))


@query("check_snapshot_structure", snapshots_sql("lineitem", "l_orderkey", "lineitem"))
def check_snapshot_structure(spark, sf):
    return flat(Q.check_snapshot_structure(D.table(spark, sf, "lineitem"), "l_orderkey", "lineitem"))


@query("check_coverage", f"{BOTH_SQL} {COVERAGE_SQL}")
def check_coverage(spark, sf):
    return flat(Q.check_coverage(bridge(spark, sf), companies(spark, sf)))


@query("check_missing", f"WITH {D.COMPANIES_SQL} " + missing_sql("companies", "Companies", COMPANY_COLUMNS))
def check_missing(spark, sf):
    return flat(Q.check_missing(raw_companies(spark, sf), "Companies"))


@query("validate_all", f"{BOTH_SQL} " + " UNION ALL ".join(f"SELECT {FIELDS} FROM ({q})" for q in (
    identifiers_sql("landlords", "LandLordID", "LandLords"), identifiers_sql("companies", "CompanyID", "Companies"), RELATIONSHIPS_SQL,
    dates_sql("landlords", "LandLords", LANDLORD_DATES), dates_sql("companies", "Companies", {"YearFounded": EPOCH, "LastUpdated": None}),
    ranges_sql("landlords", "LandLords", Q.NON_NEGATIVE["landlords"], ["Area", "ActiveCompanies"]),
    ranges_sql("companies", "Companies", Q.NON_NEGATIVE["companies"], ["MonthlyBudget"]), nesting_sql(),
    categories_sql("landlords", "LandLords", Q.CATEGORICAL["landlords"], "0.01"), categories_sql("companies", "Companies", Q.CATEGORICAL["companies"], "0.01"),
    snapshots_sql("landlords", "LandLordID", "LandLords"), snapshots_sql("companies", "CompanyID", "Companies"), COVERAGE_SQL,
    missing_sql("landlords", "LandLords", LANDLORD_COLUMNS), missing_sql("companies", "Companies", COMPANY_COLUMNS))))
def validate_all(spark, sf):
    return flat(Q.validate_all(landlords(spark, sf), raw_companies(spark, sf), bridge(spark, sf), REFERENCE_DATE))


@query("derive_findings_portfolio")
def derive_findings_portfolio(spark, sf):
    owners, comp, links = landlords(spark, sf), companies(spark, sf), bridge(spark, sf)
    return flat(Q.portfolio_findings(owners, comp, PF.anti_coverage(links, comp), PF.claimed_vs_actual(owners, links)))


@query("derive_findings_companies", f"""WITH {D.COMPANIES_SQL}, u AS (SELECT *, CASE WHEN SalesOfMainProduct IS NOT NULL OR SalesOfOtherProduct IS NOT NULL THEN coalesce(SalesOfMainProduct,0) + coalesce(SalesOfOtherProduct,0) END AS rev FROM companies),
v AS (SELECT *, CASE WHEN abs(MonthlyBudget) >= 1e-9 THEN rev / MonthlyBudget END AS util FROM u), c(cut, label) AS (VALUES (0.10, 'below_0.10'), (0.30, 'below_0.30'), (0.40, 'below_0.40'), (0.50, 'below_0.50')),
m AS (SELECT label AS metric, (SELECT count(*) FROM v WHERE MonthlyBudget > 0 AND util < cut) AS n,
  100.0 * (SELECT count(*) FROM v WHERE MonthlyBudget > 0 AND util < cut) / (SELECT count(*) FROM v WHERE MonthlyBudget > 0 AND util IS NOT NULL) AS pct FROM c
UNION ALL SELECT 'missing_or_zero_budget', count(*) FILTER (WHERE MonthlyBudget IS NULL OR abs(MonthlyBudget) < 1e-9), 100.0 * count(*) FILTER (WHERE MonthlyBudget IS NULL OR abs(MonthlyBudget) < 1e-9) / count(*) FROM v
UNION ALL SELECT 'non_active', count(*) FILTER (WHERE CompanyStatus IN ('Out of Business','Not Making New Products','On Hold','Reducing Activity')),
  100.0 * count(*) FILTER (WHERE CompanyStatus IN ('Out of Business','Not Making New Products','On Hold','Reducing Activity')) / count(*) FROM v),
r AS ({" UNION ALL ".join(f"SELECT 1 - count({c}) / count(*) AS rate FROM companies" for c in COMPANY_COLUMNS)})
SELECT 'cut_impact' AS "check", 'INFO' AS severity, 'companies' AS dataset, CAST(NULL AS VARCHAR) AS "column", metric || ': ' || n || ' (' || printf('%.2f', round(pct, 2)) || '%)' AS message, 'n=' || n AS detail FROM m
UNION ALL SELECT 'missingness', 'WARNING', 'companies', NULL, count(*) || ' columns have >=40% null. Lower confidence and Review rates will be common.', '' FROM r WHERE rate >= 0.4 HAVING count(*) > 0""")
def derive_findings_companies(spark, sf):
    comp = S.rename_columns(D.companies(spark, sf))
    return flat(Q.company_findings(comp, P.cut_impact(comp)))


@query("profile_report_companies")
def profile_report_companies(spark, sf):
    """All company profile parts as (section, metric, value) rows."""
    comp = S.rename_columns(D.companies(spark, sf))
    parts = [
        P.null_rates(comp).select(F.lit("null_pct").alias("section"), F.col("column").alias("metric"), F.col("null_pct").alias("value")),
        P.cut_impact(comp).select(F.lit("cut_impact").alias("section"), "metric", F.col("pct").alias("value")),
        P.category_summary(comp, ["CompanyStatus", "PrimaryType"], 25).select(
            F.concat(F.lit("category:"), F.col("column")).alias("section"), F.coalesce("value", F.lit("(null)")).alias("metric"),
            F.col("count").cast("double").alias("value")),
        P.metric_rows(P.quantile_row(comp.withColumn("v", P.retention(F.col("ReturningClients"), F.col("TodaysClients"))), "v"), "retention"),
    ]
    return B.stack_snapshots(parts)


@query("profile_report_landlords")
def profile_report_landlords(spark, sf):
    """All owner profile parts as (section, metric, value) rows."""
    owners, comp, links = landlords(spark, sf), companies(spark, sf), bridge(spark, sf)
    sizes = P.portfolio_size_stats(links)
    numeric = P.numeric_summary(owners, ["Area", "ActiveCompanies", "TotalPopulationAround", "YearFounded"])
    parts = [
        P.metric_rows(P.table_shape(owners, "landlords"), "shape", ("name",)),
        P.metric_rows(P.id_integrity(owners, "LandLordID", "landlords"), "ids", ("name", "id_column")),
        P.metric_rows(P.inspect_list_format(D.tenant_lists(spark, sf)), "list_format"),
        P.metric_rows(sizes, "portfolio_size"),
        P.size_buckets(links).select(F.lit("size_bucket").alias("section"), F.col("bucket").alias("metric"), F.col("owners").cast("double").alias("value")),
        P.metric_rows(PF.anti_coverage(links, comp), "coverage"),
        P.metric_rows(PF.claimed_vs_actual(owners, links), "claims"),
        numeric.select(F.lit("mean").alias("section"), F.col("column").alias("metric"), F.col("mean").alias("value")),
        P.top_correlations(owners, ["Area", "ActiveCompanies", "TotalPopulationAround", "YearFounded"]).select(
            F.lit("abs_corr").alias("section"), F.concat_ws("~", "a", "b").alias("metric"), F.col("abs_corr").alias("value")),
    ]
    return B.stack_snapshots(parts)


@query("observe_quality", """SELECT count(*) AS n_rows, avg(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0 END) AS null_customer_rate, avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0 END) AS null_date_rate,
  avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0 END) AS null_amount_rate, avg(CASE WHEN o_totalprice <= 0 THEN 1.0 ELSE 0 END) AS non_positive_amount_rate,
  CAST(min(o_orderdate) AS VARCHAR) AS date_min, CAST(max(o_orderdate) AS VARCHAR) AS date_max, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS states FROM orders""")
def observe_quality(spark, sf):
    """Quality numbers ride along with the aggregation that reads the table."""
    seen, numbers = P.observe_quality(D.table(spark, sf, "orders"), customer="o_custkey", date="o_orderdate", amount="o_totalprice")
    states = len(seen.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).collect())
    row = {k: str(v) if k.startswith("date") else v for k, v in numbers.get.items()}
    return spark.createDataFrame(
        [(*row.values(), states)], ", ".join(f"{k} {'string' if k.startswith('date') else 'bigint' if k == 'n_rows' else 'double'}" for k in row) + ", states bigint")
