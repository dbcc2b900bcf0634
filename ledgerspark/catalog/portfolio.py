"""Owner / member queries: lists, bridge, joins, targets, features, scores, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark.catalog.registry import query
from ledgerspark.config import TargetConfig
from ledgerspark.functions.idlists import parse_id_list
from ledgerspark.functions.numeric import rounded
from ledgerspark.operators import portfolio as P
from ledgerspark.operators import ranking as R
from ledgerspark.operators import targets as T
from ledgerspark.session import materialise
from ledgerspark.sources import domain as D
from ledgerspark.sources import tables as S


def bridge(spark, sf):
    return P.explode_bridge(D.tenant_lists(spark, sf))


def companies(spark, sf, clean=True):
    df = S.rename_columns(D.companies(spark, sf), S.BUDGET_RENAME)
    return S.clean_strings(df, S.COMPANY_TEXTS) if clean else df


def landlords(spark, sf):
    return S.rename_columns(D.landlords(spark, sf), S.LANDLORD_RENAMES)


def model_base(spark, sf):
    return P.build_model_base(bridge(spark, sf), companies(spark, sf))


def scored_base(spark, sf):
    """Model base with targets, and a deterministic stand-in residual per link."""
    # Written once: the targets read the companies three times, and each time they are counted from all orders.
    comp = materialise(companies(spark, sf), "companies")
    base = P.build_model_base(bridge(spark, sf), T.build_targets(comp, with_rank=False), check=False)
    return base.withColumn("OOFResidual", F.col("CompanyIsActive") - F.lit(0.5) + (F.col("Rank") - 3.0) / 20.0)


#: What the owner features and scores read of the base.
PORTFOLIO_COLUMNS = ("LandLordID", "CompanyID", "CompanyIsActive", "MonthlyBudget", "SalesOfMainProduct", "ReturningClient",
                     "TotalActiveClients", "SuccessScore", "OOFResidual")


def stored_base(spark, sf):
    """Scored base for the features and the scores of owners, joined and written once."""
    return materialise(scored_base(spark, sf).select(*PORTFOLIO_COLUMNS), "base")


CLEAN_SQL = f"""{D.COMPANIES_SQL},
comp AS (SELECT * REPLACE (nullif(trim(CompanyStatus), '') AS CompanyStatus, nullif(trim(PrimaryType), '') AS PrimaryType,
  nullif(trim(OriginCity), '') AS OriginCity, nullif(trim(OriginCountry), '') AS OriginCountry) FROM companies)"""

BASE_SQL = f"""{CLEAN_SQL}, {D.TENANT_LISTS_SQL}, base AS (SELECT b.LandLordID, b.CompanyID, comp.* EXCLUDE (CompanyID)
  FROM bridge b LEFT JOIN comp ON comp.CompanyID = b.CompanyID)"""

ACTIVE_SQL = """CASE WHEN lower(trim(CompanyStatus)) IN ('none','other','acquired/merged','acquired/merged (operating subsidiary)') THEN NULL
  WHEN lower(trim(CompanyStatus)) IN ('actively seeking new employees','will consider new projects') THEN 1.0::DOUBLE
  WHEN lower(trim(CompanyStatus)) IN ('out of business','not making new products','reducing activity') THEN 0.0::DOUBLE END"""

COMPONENT_SQL = """
comps AS (SELECT CompanyID,
    least(greatest(SalesOfMainProduct / (MonthlyBudget + 1e-6), 0), 10) AS sales_efficiency,
    least(greatest(ReturningClient / (TotalActiveClients + 1e-6), 0), 10) AS retention,
    least(greatest(ClientsInTheLast6Months / (TotalClientsInTheLast6Months + 1e-6), 0), 10) AS conversion,
    least(greatest(greatest(ClientsInTheLast12Months - ClientsInTheLast6Months, 0) / (TotalClientsInTheLast12Months + 1e-6), 0), 10) AS momentum,
    greatest(TotalActiveClients, 0) AS active_clients FROM comp),
fixed AS (SELECT c.CompanyID, CASE WHEN SalesOfMainProduct IS NOT NULL AND MonthlyBudget IS NOT NULL THEN sales_efficiency END AS sales_efficiency,
    CASE WHEN TotalActiveClients IS NOT NULL THEN retention END AS retention, CASE WHEN TotalActiveClients IS NOT NULL THEN conversion END AS conversion,
    CASE WHEN TotalActiveClients IS NOT NULL THEN momentum END AS momentum, CASE WHEN TotalActiveClients IS NOT NULL THEN active_clients END AS active_clients
  FROM comps JOIN comp c USING (CompanyID)),
long AS (UNPIVOT fixed ON sales_efficiency, retention, conversion, momentum, active_clients INTO NAME component VALUE raw),
ranked AS (SELECT CompanyID, component, (rank() OVER (PARTITION BY component ORDER BY raw) + (count(*) OVER (PARTITION BY component, raw) - 1) / 2.0 - 1)
    / (count(*) OVER (PARTITION BY component) - 1) AS share FROM long)"""


def score_sql(weights, name: str) -> str:
    case = " ".join(f"WHEN '{n}' THEN {w}" for n, w in zip(T.COMPONENTS, weights))
    return f"sum(share * CASE component {case} END) / sum(CASE component {case} END) AS {name}"


DEFAULT_WEIGHTS = [w for _, w in TargetConfig().weights]
TARGET_SQL = f"""{COMPONENT_SQL},
score AS (SELECT CompanyID, {score_sql(DEFAULT_WEIGHTS, 'SuccessScore')} FROM ranked GROUP BY 1),
targets AS (SELECT comp.*, {ACTIVE_SQL} AS CompanyIsActive, SuccessScore,
    CASE WHEN SuccessScore IS NULL THEN 1 + (SELECT count(DISTINCT round(SuccessScore, 12)) FROM score)
      ELSE dense_rank() OVER (ORDER BY round(SuccessScore, 12) DESC NULLS LAST) END AS SuccessScoreRank FROM comp LEFT JOIN score USING (CompanyID))"""


@query("rename_columns", f"""WITH {D.COMPANIES_SQL}
SELECT CompanyID, SalesOfMainProduct AS SalesMain, MonthlyBudget, ReturningClient AS ReturningClients, ClientsInTheLast7Days AS Clients7D,
  TotalClientsInTheLast12Months AS Visitors12M FROM companies""")
def rename_columns(spark, sf):
    return S.rename_columns(D.companies(spark, sf)).select(
        "CompanyID", "SalesMain", "MonthlyBudget", "ReturningClients", "Clients7D", "Visitors12M")


@query("clean_strings", f"WITH {CLEAN_SQL} SELECT CompanyID, CompanyStatus, PrimaryType, OriginCity, OriginCountry FROM comp")
def clean_strings(spark, sf):
    return companies(spark, sf).select("CompanyID", "CompanyStatus", "PrimaryType", "OriginCity", "OriginCountry")


@query("read_table", """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def read_table(spark, sf):
    return S.read_table(spark, f"{sf}/orders.parquet").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("load_entities", f"WITH {CLEAN_SQL} SELECT CompanyID, CompanyStatus, OriginCity, MonthlyBudget FROM comp")
def load_entities(spark, sf):
    """Write the company table once to the shared folder, then load it as a file."""
    from ledgerspark.session import new_scratch

    path = new_scratch(spark, "companies") + ".parquet"
    D.companies(spark, sf).write.parquet(path)
    return S.load_companies(spark, path).select("CompanyID", "CompanyStatus", "OriginCity", "MonthlyBudget")


@query("lookup_entity", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = (SELECT max(o_custkey) FROM orders)")
def lookup_entity(spark, sf):
    last = D.table(spark, sf, "orders").agg(F.max("o_custkey")).first()[0]
    return S.lookup_entity(D.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey", str(last))


@query("list_ids", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")
def list_ids(spark, sf):
    return S.list_ids(D.table(spark, sf, "customer"), "c_custkey")


@query("page_ids", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer ORDER BY 1 LIMIT 50 OFFSET 25")
def page_ids(spark, sf):
    return S.page_ids(D.table(spark, sf, "customer"), "c_custkey", 25, 50)


@query("parse_id_list", f"""WITH {D.TENANT_LISTS_SQL},
g AS (SELECT o, list(CompanyID) FILTER (WHERE CompanyID <> '') AS ids FROM tenant_ids GROUP BY o)
SELECT t.LandLordID, t.AllCompanyID, coalesce(array_to_string(ids, '|'), '') AS ids, coalesce(len(ids), 0) AS n
FROM tenant_lists t LEFT JOIN g USING (o)""")
def parse_ids(spark, sf):
    cells = D.tenant_lists(spark, sf).withColumn("_ids", parse_id_list(F.col("AllCompanyID")))
    return cells.select(
        "LandLordID", "AllCompanyID", F.array_join("_ids", "|").alias("ids"), F.size("_ids").cast("bigint").alias("n"))


@query("explode_bridge", f"WITH {D.TENANT_LISTS_SQL} SELECT * FROM bridge")
def explode_bridge(spark, sf):
    return bridge(spark, sf)


@query("distinct_rows", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def distinct_rows(spark, sf):
    return D.table(spark, sf, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("build_model_base", f"""WITH {BASE_SQL}
SELECT LandLordID, CompanyID, CompanyStatus, MonthlyBudget, round(SalesOfMainProduct, 2) AS SalesOfMainProduct, TotalActiveClients FROM base""")
def build_model_base(spark, sf):
    return model_base(spark, sf).select(
        "LandLordID", "CompanyID", "CompanyStatus", "MonthlyBudget",
        F.round("SalesOfMainProduct", 2).alias("SalesOfMainProduct"), "TotalActiveClients")


@query("unmatched_members", f"""WITH {BASE_SQL} SELECT count(DISTINCT CompanyID) AS n_unmatched FROM bridge
WHERE CompanyID NOT IN (SELECT CompanyID FROM comp)""")
def unmatched_members(spark, sf):
    return P.unmatched_members(bridge(spark, sf), companies(spark, sf))


@query("binary_target", f"WITH {CLEAN_SQL} SELECT CompanyID, {ACTIVE_SQL} AS CompanyIsActive FROM comp")
def binary_target(spark, sf):
    return T.binary_target(companies(spark, sf)).select("CompanyID", "CompanyIsActive")


@query("success_components", f"WITH {CLEAN_SQL}, {COMPONENT_SQL} SELECT CompanyID, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in T.COMPONENTS) + " FROM fixed")
def success_components(spark, sf):
    df = companies(spark, sf)
    parts = T.success_components(df)
    return df.select("CompanyID", *[F.round(parts[c], 6).alias(c) for c in T.COMPONENTS])


@query("rank_normalize", """SELECT o_orderkey, round((rank() OVER (ORDER BY floor(o_totalprice / 100)) + (count(*) OVER (PARTITION BY floor(o_totalprice / 100)) - 1) / 2.0 - 1)
  / (count(*) OVER () - 1), 8) AS share FROM orders""")
def rank_normalize(spark, sf):
    orders = D.table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100).cast("double").alias("v"))
    return R.rank_normalize(orders, "v", "share").select("o_orderkey", F.round("share", 8).alias("share"))


@query("dense_rank_desc", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, dense_rank() OVER (ORDER BY l_extendedprice DESC) AS place FROM lineitem""")
def dense_rank_desc(spark, sf):
    lines = D.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return R.dense_rank_desc(lines, "l_extendedprice", "place").drop("l_extendedprice")


@query("composite_score", f"WITH {CLEAN_SQL}, {TARGET_SQL} SELECT CompanyID, round(SuccessScore, 6) AS SuccessScore FROM targets")
def composite_score(spark, sf):
    return rounded(T.composite_score(companies(spark, sf)), 6, ["SuccessScore"])


@query("build_targets", f"""WITH {CLEAN_SQL}, {TARGET_SQL}
SELECT CompanyID, CompanyIsActive, round(SuccessScore, 6) AS SuccessScore, SuccessScoreRank FROM targets""")
def build_targets(spark, sf):
    out = T.build_targets(companies(spark, sf))
    return rounded(out.select("CompanyID", "CompanyIsActive", "SuccessScore", "SuccessScoreRank"), 6, ["SuccessScore"])


def _sensitivity_sql() -> str:
    from ledgerspark.config import WEIGHT_SETS

    names = list(WEIGHT_SETS)
    scores = ", ".join(
        f"round({score_sql(w, 'x').rsplit(' AS ', 1)[0]}, 12) AS \"{n}\"" for n, w in WEIGHT_SETS.items())
    ranks = ", ".join(
        f'rank() OVER (ORDER BY "{n}") + (count(*) OVER (PARTITION BY "{n}") - 1) / 2.0 AS "{n}"' for n in names)
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 4) AS spearman FROM rk"
        for i, a in enumerate(names) for b in names[i + 1:])
    return f"WITH {CLEAN_SQL}, {COMPONENT_SQL}, sc AS (SELECT CompanyID, {scores} FROM ranked GROUP BY 1), rk AS (SELECT {ranks} FROM sc) {pairs}"


@query("weight_sensitivity", _sensitivity_sql())
def weight_sensitivity(spark, sf):
    return T.weight_sensitivity(companies(spark, sf))


@query("attach_targets", f"""WITH {BASE_SQL}, {TARGET_SQL}
SELECT b.LandLordID, b.CompanyID, CompanyIsActive, round(SuccessScore, 6) AS SuccessScore FROM bridge b LEFT JOIN targets USING (CompanyID)""")
def attach_targets(spark, sf):
    out = P.attach_targets(
        model_base(spark, sf).withColumn("SuccessScore", F.lit(-1.0)), T.build_targets(companies(spark, sf)))
    return rounded(out.select("LandLordID", "CompanyID", "CompanyIsActive", "SuccessScore"), 6, ["SuccessScore"])


LANDLORD_FEATURE_SQL = f"""{D.LANDLORDS_SQL},
lf AS (SELECT LandLordID, CASE WHEN 2020 - YearFounded BETWEEN 0 AND 300 THEN (2020 - YearFounded)::DOUBLE END AS LandlordAge,
    CASE WHEN Area IS NOT NULL THEN greatest(Area, 0) END AS Area, TotalPopulationAround::DOUBLE AS TotalPopulationAround,
    ActiveCompanies::DOUBLE AS ActiveCompanies,
    CASE WHEN trim(PreferredIndustry) NOT IN ('', 'nan', 'None', 'NaN') THEN trim(PreferredIndustry) END AS PreferredIndustry,
    nullif(trim(OriginCity), '') AS OriginCity, nullif(trim(OriginCountry), '') AS OriginCountry FROM landlords)"""


@query("landlord_features", f"""WITH {LANDLORD_FEATURE_SQL}
SELECT *, round(TotalPopulationAround / (abs(Area) + 1e-6), 4) AS PopulationDensity, round(Area / (ActiveCompanies + 1e-6), 6) AS AreaPerCompany,
  round(TotalPopulationAround / (ActiveCompanies + 1e-6), 6) AS PopulationPerCompany FROM lf""")
def landlord_features(spark, sf):
    out = P.landlord_features(D.landlords(spark, sf), D.AS_OF_YEAR)
    return rounded(rounded(out, 4, ["PopulationDensity"]), 6, ["AreaPerCompany", "PopulationPerCompany"])


PORTFOLIO_SQL = f"""{BASE_SQL}, {TARGET_SQL},
full_base AS (SELECT b.LandLordID, b.CompanyID, t.* EXCLUDE (CompanyID) FROM bridge b LEFT JOIN targets t USING (CompanyID)),
pf AS (SELECT LandLordID, count(*) AS PortfolioSize, avg(CompanyIsActive) AS PortfolioActiveRate, avg(MonthlyBudget) AS PortfolioMeanBudget,
    stddev_samp(MonthlyBudget) AS PortfolioStdBudget, avg(SalesOfMainProduct) AS PortfolioMeanSales, avg(TotalActiveClients) AS PortfolioMeanClients,
    avg(ReturningClient / (abs(TotalActiveClients) + 1e-6)) AS PortfolioMeanRetention, avg(SuccessScore) AS PortfolioMeanSuccessScore,
    stddev_samp(SuccessScore) AS PortfolioStdSuccessScore FROM full_base GROUP BY 1)"""
PORTFOLIO_SHOWN = """PortfolioSize, round(PortfolioActiveRate, 6) AS PortfolioActiveRate, round(PortfolioMeanBudget, 6) AS PortfolioMeanBudget,
  round(PortfolioStdBudget, 4) AS PortfolioStdBudget, round(PortfolioMeanSales, 6) AS PortfolioMeanSales, round(PortfolioMeanClients, 6) AS PortfolioMeanClients,
  round(PortfolioMeanRetention, 6) AS PortfolioMeanRetention, round(PortfolioMeanSuccessScore, 6) AS PortfolioMeanSuccessScore,
  round(PortfolioStdSuccessScore, 6) AS PortfolioStdSuccessScore"""


def shown_portfolio(df):
    df = rounded(df, 4, ["PortfolioStdBudget"])
    return rounded(df, 6, [
        "PortfolioMeanBudget", "PortfolioMeanSales", "PortfolioActiveRate", "PortfolioMeanClients", "PortfolioMeanRetention", "PortfolioMeanSuccessScore",
        "PortfolioStdSuccessScore"])


@query("portfolio_features", f"WITH {PORTFOLIO_SQL} SELECT LandLordID, {PORTFOLIO_SHOWN} FROM pf")
def portfolio_features(spark, sf):
    return shown_portfolio(P.portfolio_features(scored_base(spark, sf)))


RESIDUAL_SQL = f"""{PORTFOLIO_SQL},
res AS (SELECT LandLordID, CompanyIsActive - 0.5 + (Rank - 3.0) / 20.0 AS res FROM full_base),
shrunk AS (SELECT LandLordID, count(*) AS TenantCount, avg(res) AS RawAdjustedScore,
    count(*) / (count(*) + 10.0) * avg(res) + 10.0 / (count(*) + 10.0) * (SELECT avg(res) FROM res) AS AdjustedScore
  FROM res WHERE res IS NOT NULL GROUP BY 1)"""


@query("entity_shrunk_score", f"""WITH {RESIDUAL_SQL}
SELECT LandLordID, TenantCount, round(RawAdjustedScore, 10) AS RawAdjustedScore, round(AdjustedScore, 10) AS AdjustedScore FROM shrunk""")
def entity_shrunk_score(spark, sf):
    return rounded(P.entity_shrunk_score(scored_base(spark, sf)), 10, ["RawAdjustedScore", "AdjustedScore"])


@query("build_landlord_matrix", f"""WITH {RESIDUAL_SQL}, {LANDLORD_FEATURE_SQL}
SELECT LandLordID, LandlordAge, PreferredIndustry, OriginCity, {PORTFOLIO_SHOWN}, TenantCount, round(AdjustedScore, 6) AS AdjustedScore
FROM lf LEFT JOIN pf USING (LandLordID) JOIN shrunk USING (LandLordID)""")
def build_landlord_matrix(spark, sf):
    base = stored_base(spark, sf)
    out = P.build_landlord_matrix(D.landlords(spark, sf), base, P.entity_shrunk_score(base), D.AS_OF_YEAR)
    cols = [c for c in out.columns if c.startswith("Portfolio")]
    return rounded(
        shown_portfolio(out).select(
            "LandLordID", "LandlordAge", "PreferredIndustry", "OriginCity", *cols, "TenantCount", "AdjustedScore"),
        6, ["AdjustedScore"])


@query("build_scoring_matrix", f"""WITH {PORTFOLIO_SQL}, {LANDLORD_FEATURE_SQL}
SELECT LandLordID, LandlordAge, {PORTFOLIO_SHOWN}, PortfolioSize AS TenantCount FROM lf LEFT JOIN pf USING (LandLordID)""")
def build_scoring_matrix(spark, sf):
    comp = materialise(companies(spark, sf), "companies")
    out = P.build_scoring_matrix(D.landlords(spark, sf), bridge(spark, sf), comp, T.build_targets(comp, with_rank=False), D.AS_OF_YEAR)
    cols = [c for c in out.columns if c.startswith("Portfolio")]
    return shown_portfolio(out).select("LandLordID", "LandlordAge", *cols, "TenantCount")


@query("route_scoring_input", f"""WITH {PORTFOLIO_SQL}, {LANDLORD_FEATURE_SQL}
SELECT LandLordID, LandlordAge, PortfolioSize, round(PortfolioMeanClients, 6) AS PortfolioMeanClients, PortfolioSize AS TenantCount,
  'landlord_ids' AS input_kind FROM lf LEFT JOIN pf USING (LandLordID) WHERE Area > 0""")
def route_scoring_input(spark, sf):
    owners = D.landlords(spark, sf)
    ids = owners.filter(F.col("Area") > 0).select("LandLordID")
    comp = companies(spark, sf)
    kind, out = P.route_scoring_input(
        ids, owners, D.tenant_lists(spark, sf), comp, T.build_targets(comp, with_rank=False), D.AS_OF_YEAR)
    return rounded(
        out.select("LandLordID", "LandlordAge", "PortfolioSize", "PortfolioMeanClients", "TenantCount"),
        6, ["PortfolioMeanClients"]).withColumn("input_kind", F.lit(kind))


@query("anti_coverage", f"""WITH {BASE_SQL}, b AS (SELECT DISTINCT CompanyID FROM bridge), c AS (SELECT DISTINCT CompanyID FROM comp)
SELECT (SELECT count(*) FROM c) AS companies_in_table, (SELECT count(*) FROM b) AS companies_in_bridge,
  (SELECT count(*) FROM b JOIN c USING (CompanyID)) AS overlap, (SELECT count(*) FROM b ANTI JOIN c USING (CompanyID)) AS bridge_not_in_companies,
  (SELECT count(*) FROM c ANTI JOIN b USING (CompanyID)) AS companies_not_in_bridge, CAST(0 AS BIGINT) AS malformed_bridge_ids,
  round((SELECT count(*) FROM b JOIN c USING (CompanyID)) * 100.0 / (SELECT count(*) FROM b), 2) AS match_rate_bridge_pct,
  round((SELECT count(*) FROM b JOIN c USING (CompanyID)) * 100.0 / (SELECT count(*) FROM c), 2) AS coverage_rate_companies_pct""")
def anti_coverage(spark, sf):
    return P.anti_coverage(bridge(spark, sf), companies(spark, sf))


@query("semi_filter_ids", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_filter_ids(spark, sf):
    ids = D.table(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return S.semi_filter_ids(D.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@query("claimed_vs_actual", f"""WITH {D.LANDLORDS_SQL}, {D.TENANT_LISTS_SQL},
s AS (SELECT LandLordID, count(*) AS linked FROM bridge GROUP BY 1),
j AS (SELECT ActiveCompanies AS claimed, linked, abs(ActiveCompanies - linked) AS gap FROM landlords LEFT JOIN s USING (LandLordID))
SELECT round(avg(CASE WHEN gap = 0 THEN 1.0 ELSE 0 END) * 100, 2) AS exact_match_pct, round(avg(CASE WHEN gap <= 1 THEN 1.0 ELSE 0 END) * 100, 2) AS within_1_pct,
  round(avg(claimed), 4) AS mean_claimed, round(avg(linked), 4) AS mean_linked, median(gap) AS median_gap FROM j""")
def claimed_vs_actual(spark, sf):
    return rounded(P.claimed_vs_actual(landlords(spark, sf), bridge(spark, sf)), 4, ["mean_claimed", "mean_linked"])


@query("id_set_algebra", f"""WITH {BASE_SQL}, b AS (SELECT DISTINCT CompanyID FROM bridge), c AS (SELECT DISTINCT CompanyID FROM comp)
SELECT coalesce(b.CompanyID, c.CompanyID) AS CompanyID, CASE WHEN b.CompanyID IS NULL THEN 'right_only' WHEN c.CompanyID IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM b FULL JOIN c ON b.CompanyID = c.CompanyID""")
def id_set_algebra(spark, sf):
    return P.id_set_algebra(bridge(spark, sf), companies(spark, sf), "CompanyID")


@query("prepare_model_frame", f"""WITH {LANDLORD_FEATURE_SQL} SELECT LandLordID, Area, LandlordAge, coalesce(PreferredIndustry, '__missing__') AS PreferredIndustry,
  coalesce(OriginCity, '__missing__') AS OriginCity FROM lf""")
def prepare_model_frame(spark, sf):
    out = P.landlord_features(D.landlords(spark, sf), D.AS_OF_YEAR)
    return P.prepare_model_frame(out, ["Area", "LandlordAge"], ["PreferredIndustry", "OriginCity"], ["LandLordID"])


PERCENTILE_SQL = f"""{RESIDUAL_SQL},
pc AS (SELECT s.LandLordID, s.TenantCount, s.AdjustedScore,
  100.0 * (SELECT count(*) FROM shrunk r WHERE round(r.AdjustedScore, 9) <= round(s.AdjustedScore, 9)) / (SELECT count(*) FROM shrunk) AS pct FROM shrunk s)"""


def shrunk(spark, sf):
    return P.entity_shrunk_score(scored_base(spark, sf)).withColumn("AdjustedScore", F.round("AdjustedScore", 9))


@query("percentile_vs_reference", f"""WITH {PERCENTILE_SQL} SELECT LandLordID, round(pct, 6) AS percentile, round(pct, 6) AS score_0_100 FROM pc""")
def percentile_vs_reference(spark, sf):
    scores = materialise(shrunk(spark, sf), "scores")
    out = R.percentile_vs_reference(scores, "AdjustedScore", scores, "AdjustedScore")
    return rounded(out.select("LandLordID", "percentile", "score_0_100"), 6, ["percentile", "score_0_100"])


@query("quality_band", f"""WITH {PERCENTILE_SQL} SELECT LandLordID, CASE WHEN pct >= 70 THEN 'good' WHEN pct <= 30 THEN 'bad' ELSE 'neutral' END AS band,
  CASE WHEN TenantCount >= 10 THEN 'high' WHEN TenantCount >= 5 THEN 'medium' ELSE 'low' END AS confidence FROM pc""")
def quality_band(spark, sf):
    scores = materialise(shrunk(spark, sf), "scores")
    out = R.percentile_vs_reference(scores, "AdjustedScore", scores, "AdjustedScore")
    return out.select(
        "LandLordID", R.quality_band(F.col("percentile")).alias("band"),
        R.confidence_level(F.col("TenantCount")).alias("confidence"))


@query("select_case_studies", f"""WITH {RESIDUAL_SQL},
e AS (SELECT LandLordID, TenantCount, round(AdjustedScore, 9) AS s, row_number() OVER (ORDER BY round(AdjustedScore, 9) DESC, md5(LandLordID)) AS pos, count(*) OVER () AS n
  FROM shrunk WHERE TenantCount >= 5)
SELECT LandLordID, TenantCount, CASE WHEN pos <= 2 THEN 'good' WHEN pos > n - 2 THEN 'bad' ELSE 'neutral' END AS band FROM e
WHERE pos <= 2 OR pos > n - 2 OR pos = n // 2 + 1""")
def select_case_studies(spark, sf):
    return R.select_case_studies(materialise(shrunk(spark, sf), "scores")).select("LandLordID", "TenantCount", "band")
