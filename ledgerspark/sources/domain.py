"""Maps the generic star-schema tables to the domain tables the operators take.

Every mapping is row-local or a plain grouped aggregation, so it grows with the given tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = dt.date(2000, 6, 1)
SNAPSHOTS = (dt.date(1999, 6, 1), dt.date(2000, 6, 1))
AS_OF_YEAR = 2020


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines under upload-style column names."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("Customer_ID"),
        F.pmod(F.col("o_custkey"), F.lit(25)).cast("string").alias("accountid"),
        F.col("o_totalprice").alias("invoice_amount"),
        F.col("o_orderdate").alias("invoice_date"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("customerid"),
        F.pmod(F.col("o_custkey"), F.lit(25)).cast("string").alias("accountid"),
        F.col("o_totalprice").alias("amount"),
        F.to_date("o_orderdate").alias("date"),
    )


def _pick(key: Column, *values: str | None) -> Column:
    """One of the values by key modulo their number."""
    slot = F.pmod(key, F.lit(len(values)))
    out = None
    for i, v in enumerate(values):
        out = F.when(slot == i, F.lit(v)) if out is None else out.when(slot == i, F.lit(v))
    return out


def pick_sql(key: str, *values: str | None) -> str:
    body = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
        for i, v in enumerate(values)
    )
    return f"CASE {key} % {len(values)} {body} END"


STATUSES = (
    "Actively Seeking New Employees", "Will Consider New Projects", "Out of Business", "active",
    "Not Making New Products", "None", " ", None, "Actively Seeking New Employees", "Parked",
    "On Hold", "Reducing Activity", "Will Consider New Projects",
)
KINDS = ("Retail", "Alcohol", "crypto", "Furniture", "Space Tourism", None, "Food")
CITIES = ("Oslo", "Lima", " lima", "Pune", "Kyiv", "", None, "Accra")
INDUSTRIES = ("Retail", "Food ", "nan", None, "Tech", "", "None")

# Window lengths (days) behind the "7 days", "6 months" and "12 months" counters of the test mapping.
WINDOW_DAYS = {"7": 60, "6": 365, "12": 730}


def companies(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> DataFrame:
    """Company table with raw column names: customers with counters over their orders."""
    k = F.col("c_custkey")
    d = F.to_date("o_orderdate")
    seen = d < F.lit(as_of)
    within = {n: seen & (d >= F.date_sub(F.lit(as_of), days)) for n, days in WINDOW_DAYS.items()}
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    count = lambda cond: F.count(F.when(cond, F.lit(1)))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *[count(cond).alias(f"c{n}") for n, cond in within.items()],
        *[count(cond & urgent).alias(f"u{n}") for n, cond in within.items()],
        count(seen).alias("todays"),
        count(seen & (F.col("o_orderstatus") == "F")).alias("returning"),
        count(seen & F.col("o_orderstatus").isin("F", "P")).alias("active"),
        F.sum(F.when(within["12"] & (F.col("o_orderstatus") == "F"), F.col("o_totalprice"))).alias("main"),
        F.sum(F.when(within["12"] & (F.col("o_orderstatus") == "O"), F.col("o_totalprice"))).alias("other"),
    )
    joined = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    whole = lambda c: F.col(c).cast("double")
    return joined.select(
        F.concat(F.lit("C"), k).alias("CompanyID"),
        _pick(k, *STATUSES).alias("CompanyStatus"),
        _pick(k, *KINDS).alias("PrimaryType"),
        F.when(F.pmod(k, F.lit(31)) != 0, (F.lit(1950) + F.pmod(k, F.lit(75))).cast("int")).alias("YearFounded"),
        F.when(F.pmod(k, F.lit(19)) != 0, F.concat(F.lit("N"), F.col("c_nationkey"))).alias("OriginCountry"),
        _pick(k, *CITIES).alias("OriginCity"),
        F.when(F.pmod(k, F.lit(23)) != 0, F.lit(1.0) + F.pmod(k, F.lit(45)) / F.lit(10.0)).alias("Rank"),
        F.col("main").alias("SalesOfMainProduct"),
        F.col("other").alias("SalesOfOtherProduct"),
        F.when(F.pmod(k, F.lit(37)) == 0, F.lit(0.0))
        .when(F.pmod(k, F.lit(11)) != 0, F.col("c_acctbal") * 100.0)
        .alias("Monthly budget"),
        F.when(F.pmod(k, F.lit(17)) == 0, F.lit(0.0))
        .when(F.pmod(k, F.lit(13)) != 0, F.col("c_acctbal") * 10.0)
        .alias("Investments"),
        whole("todays").alias("TodaysClients"),
        whole("returning").alias("ReturningClient"),
        whole("active").alias("TotalActiveClients"),
        whole("c7").alias("ClientsInTheLast7Days"),
        whole("c6").alias("ClientsInTheLast6Months"),
        whole("c12").alias("ClientsInTheLast12Months"),
        (whole("u7") * 2 + F.pmod(k, F.lit(3))).alias("TotalClientsInTheLast7Days"),
        (whole("c6") * 3 - whole("u6") + F.pmod(k, F.lit(4))).alias("TotalClientsInTheLast6Months"),
        (whole("c12") * 3 - whole("u12") + F.pmod(k, F.lit(7))).alias("TotalClientsInTheLast12Months"),
    )


_W = {n: f"o_orderdate >= DATE '{AS_OF - dt.timedelta(days=days)}'" for n, days in WINDOW_DAYS.items()}

COMPANIES_SQL = f"""
company_orders AS (
  SELECT o_custkey,
    count(*) FILTER (WHERE {_W['7']}) AS c7, count(*) FILTER (WHERE {_W['6']}) AS c6,
    count(*) FILTER (WHERE {_W['12']}) AS c12,
    count(*) FILTER (WHERE {_W['7']} AND o_orderpriority IN ('1-URGENT','2-HIGH')) AS u7,
    count(*) FILTER (WHERE {_W['6']} AND o_orderpriority IN ('1-URGENT','2-HIGH')) AS u6,
    count(*) FILTER (WHERE {_W['12']} AND o_orderpriority IN ('1-URGENT','2-HIGH')) AS u12,
    count(*) AS todays, count(*) FILTER (WHERE o_orderstatus = 'F') AS returning_n,
    count(*) FILTER (WHERE o_orderstatus IN ('F','P')) AS active_n,
    sum(o_totalprice) FILTER (WHERE {_W['12']} AND o_orderstatus = 'F') AS main,
    sum(o_totalprice) FILTER (WHERE {_W['12']} AND o_orderstatus = 'O') AS other
  FROM (SELECT * FROM orders WHERE o_orderdate < DATE '{AS_OF}') GROUP BY o_custkey),
order_customers AS (SELECT DISTINCT o_custkey FROM orders),
companies AS (
  SELECT 'C' || c_custkey AS CompanyID,
    {pick_sql('c_custkey', *STATUSES)} AS CompanyStatus,
    {pick_sql('c_custkey', *KINDS)} AS PrimaryType,
    CASE WHEN c_custkey % 31 <> 0 THEN CAST(1950 + c_custkey % 75 AS INT) END AS YearFounded,
    CASE WHEN c_custkey % 19 <> 0 THEN 'N' || c_nationkey END AS OriginCountry,
    {pick_sql('c_custkey', *CITIES)} AS OriginCity,
    CASE WHEN c_custkey % 23 <> 0 THEN 1.0::DOUBLE + (c_custkey % 45) / 10.0::DOUBLE END AS Rank,
    main AS SalesOfMainProduct, other AS SalesOfOtherProduct,
    CASE WHEN c_custkey % 37 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 11 <> 0 THEN c_acctbal * 100.0::DOUBLE END AS MonthlyBudget,
    CASE WHEN c_custkey % 17 = 0 THEN 0.0::DOUBLE WHEN c_custkey % 13 <> 0 THEN c_acctbal * 10.0::DOUBLE END AS Investments,
    CASE WHEN oc.o_custkey IS NOT NULL THEN coalesce(todays,0)::DOUBLE END AS TodaysClients,
    CASE WHEN oc.o_custkey IS NOT NULL THEN coalesce(returning_n,0)::DOUBLE END AS ReturningClient,
    CASE WHEN oc.o_custkey IS NOT NULL THEN coalesce(active_n,0)::DOUBLE END AS TotalActiveClients,
    CASE WHEN oc.o_custkey IS NOT NULL THEN coalesce(c7,0)::DOUBLE END AS ClientsInTheLast7Days,
    CASE WHEN oc.o_custkey IS NOT NULL THEN coalesce(c6,0)::DOUBLE END AS ClientsInTheLast6Months,
    CASE WHEN oc.o_custkey IS NOT NULL THEN coalesce(c12,0)::DOUBLE END AS ClientsInTheLast12Months,
    CASE WHEN oc.o_custkey IS NOT NULL THEN (coalesce(u7,0) * 2 + c_custkey % 3)::DOUBLE END AS TotalClientsInTheLast7Days,
    CASE WHEN oc.o_custkey IS NOT NULL THEN (coalesce(c6,0) * 3 - coalesce(u6,0) + c_custkey % 4)::DOUBLE END AS TotalClientsInTheLast6Months,
    CASE WHEN oc.o_custkey IS NOT NULL THEN (coalesce(c12,0) * 3 - coalesce(u12,0) + c_custkey % 7)::DOUBLE END AS TotalClientsInTheLast12Months
  FROM customer LEFT JOIN company_orders co ON co.o_custkey = c_custkey
  LEFT JOIN order_customers oc ON oc.o_custkey = c_custkey)"""


def landlords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner attributes, one row per supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("L"), k).alias("LandLordID"),
        (F.lit(145) + F.pmod(k, F.lit(8))).cast("int").alias("ActiveCompanies"),
        F.when(F.pmod(k, F.lit(9)) != 4, F.col("s_acctbal")).alias("Area"),
        F.pmod(k * 37, F.lit(5000)).alias("TotalPopulationAround"),
        _pick(k, *INDUSTRIES).alias("PreferredIndustry"),
        _pick(k, *CITIES).alias("LandlordOriginCity"),
        F.when(F.pmod(k, F.lit(12)) != 0, F.concat(F.lit("N"), F.col("s_nationkey"))).alias("LandlordOriginCountry"),
        F.when(F.pmod(k, F.lit(17)) == 3, F.lit("not a date"))
        .when(F.pmod(k, F.lit(29)) == 5, F.lit("2031-01-05"))
        .when(F.pmod(k, F.lit(13)) != 1, F.concat(F.lit("2019-03-"), F.lpad((F.lit(1) + F.pmod(k, F.lit(28))).cast("string"), 2, "0")))
        .alias("LastUpdated"),
        F.when(F.pmod(k, F.lit(14)) != 2, (F.lit(1700) + F.pmod(k * 13, F.lit(330))).cast("int")).alias("YearFounded"),
    )


LANDLORDS_SQL = f"""
landlords AS (
  SELECT 'L' || s_suppkey AS LandLordID, CAST(145 + s_suppkey % 8 AS INT) AS ActiveCompanies,
    CASE WHEN s_suppkey % 9 <> 4 THEN s_acctbal END AS Area,
    (s_suppkey * 37) % 5000 AS TotalPopulationAround,
    {pick_sql('s_suppkey', *INDUSTRIES)} AS PreferredIndustry,
    {pick_sql('s_suppkey', *CITIES)} AS OriginCity,
    CASE WHEN s_suppkey % 12 <> 0 THEN 'N' || s_nationkey END AS OriginCountry,
    CASE WHEN s_suppkey % 17 = 3 THEN 'not a date' WHEN s_suppkey % 29 = 5 THEN '2031-01-05'
         WHEN s_suppkey % 13 <> 1 THEN '2019-03-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') END AS LastUpdated,
    CASE WHEN s_suppkey % 14 <> 2 THEN CAST(1700 + (s_suppkey * 13) % 330 AS INT) END AS YearFounded
  FROM supplier)"""


def tenant_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id-list cells in rotating text formats, several cells per owner: one per order."""
    o = F.col("o_orderkey")
    one = F.concat(F.lit("C"), F.col("o_custkey"))
    two = F.when(F.pmod(o, F.lit(10)) == 7, F.concat(F.lit("X"), F.floor(o / 10).cast("bigint"))).otherwise(
        F.concat(F.lit("C"), F.col("o_custkey") + F.pmod(o, F.lit(4)))
    )
    slot = F.pmod(o, F.lit(6))
    cell = (
        F.when(slot == 0, F.concat(F.lit('["'), one, F.lit('", "'), two, F.lit('"]')))
        .when(slot == 1, F.concat(F.lit("['"), one, F.lit("', '"), two, F.lit("']")))
        .when(slot == 2, F.concat(one, F.lit(", "), two))
        .when(slot == 3, F.concat(F.lit(" "), one, F.lit(" ")))
        .when(slot == 4, F.when(F.pmod(o, F.lit(5)) == 0, F.lit("nan")).otherwise(F.concat(F.lit("'"), two, F.lit("'"))))
        .otherwise(F.when(F.pmod(o, F.lit(7)) != 0, F.concat(F.lit('["'), one, F.lit('", ""]'))))
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("L"), F.floor(o / 150).cast("bigint")).alias("LandLordID"), cell.alias("AllCompanyID")
    )


TENANT_LISTS_SQL = """
tenant_cells AS (
  SELECT 'L' || (o_orderkey // 150) AS LandLordID, o_orderkey % 6 AS slot, o_orderkey AS o,
    'C' || o_custkey AS one,
    CASE WHEN o_orderkey % 10 = 7 THEN 'X' || (o_orderkey // 10) ELSE 'C' || (o_custkey + o_orderkey % 4) END AS two
  FROM orders),
tenant_lists AS (
  SELECT LandLordID, o, CASE slot WHEN 0 THEN '["' || one || '", "' || two || '"]'
    WHEN 1 THEN '[''' || one || ''', ''' || two || ''']' WHEN 2 THEN one || ', ' || two
    WHEN 3 THEN ' ' || one || ' '
    WHEN 4 THEN CASE WHEN o % 5 = 0 THEN 'nan' ELSE '''' || two || '''' END
    ELSE CASE WHEN o % 7 <> 0 THEN '["' || one || '", ""]' END END AS AllCompanyID FROM tenant_cells),
tenant_ids AS (
  SELECT LandLordID, o, unnest(string_split(regexp_replace(AllCompanyID, '[\\[\\]''" ]', '', 'g'), ',')) AS CompanyID
  FROM tenant_lists WHERE AllCompanyID IS NOT NULL AND AllCompanyID <> 'nan'),
bridge AS (SELECT DISTINCT LandLordID, CompanyID FROM tenant_ids WHERE CompanyID <> '')"""


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and two model scores per order, in whole ten-thousandths so that ties are exact."""
    o, price = F.col("o_orderkey"), F.col("o_totalprice")
    y = (F.col("o_orderstatus") == "F").cast("int")
    step = F.least(F.floor(price / 5000), F.lit(99)).cast("bigint")
    jitter = F.pmod(o * 7919, F.lit(1000))
    return table(spark, sf_dir, "orders").select(
        o.alias("id"),
        y.alias("y"),
        (step / F.lit(100.0)).alias("p_base"),
        ((step * 60 + y * 1500 + jitter * 2) / F.lit(10000.0)).alias("p_treat"),
        price.alias("dollars"),
        (price * 0.9 + jitter * 100.0).alias("pred"),
        F.pmod(o, F.lit(5)).cast("int").alias("fold"),
        F.pmod(F.col("o_custkey"), F.lit(97)).alias("grp"),
    )


SCORED_SQL = """
scored AS (
  SELECT o_orderkey AS id, CAST(o_orderstatus = 'F' AS INT) AS y,
    least(floor(o_totalprice / 5000), 99) / 100.0::DOUBLE AS p_base,
    (least(floor(o_totalprice / 5000), 99) * 60 + CAST(o_orderstatus = 'F' AS INT) * 1500 + ((o_orderkey * 7919) % 1000) * 2)::DOUBLE / 10000.0::DOUBLE AS p_treat,
    o_totalprice AS dollars, o_totalprice * 0.9::DOUBLE + ((o_orderkey * 7919) % 1000) * 100.0::DOUBLE AS pred,
    CAST(o_orderkey % 5 AS INT) AS fold, o_custkey % 97 AS grp
  FROM orders)"""
