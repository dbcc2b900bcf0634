import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.config import TargetConfig
from ledgerspark.functions.idlists import parse_id_list
from ledgerspark.operators import drift as DR
from ledgerspark.operators import portfolio as P
from ledgerspark.operators import profile as PR
from ledgerspark.operators import quality as Q
from ledgerspark.operators import targets as T
from ledgerspark.sources import tables as S

CELLS = {
    None: [], "": [], " nan ": [], "[]": [], "None": [], '["C1", " C2 "]': ["C1", "C2"], "['C1','C2']": ["C1", "C2"],
    "C1, C2 ,C3": ["C1", "C2", "C3"], "'C9'": ["C9"], "C7": ["C7"], "[1, 2]": ["1", "2"], '["C1", ""]': ["C1"], "[C1,C2": ["C1", "C2"],
}


def test_id_list_formats(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, c string")
    got = {r["i"]: r["x"] for r in df.select("i", parse_id_list(F.col("c")).alias("x")).collect()}
    assert [got[i] for i in range(len(CELLS))] == list(CELLS.values())


def test_id_list_modes(spark):
    row = spark.range(1).select(
        parse_id_list(F.lit("a,b"), "csv").alias("csv"), parse_id_list(F.lit("a,b"), "json").alias("json"),
        parse_id_list(F.lit("['a']"), "list").alias("list"), parse_id_list(F.array(F.lit(" a"), F.lit(None), F.lit("")), is_array=True).alias("arr")).first()
    assert tuple(row) == (["a", "b"], ["a,b"], ["a"], ["a"])
    with pytest.raises(ValueError):
        parse_id_list(F.lit("x"), "xml")


@pytest.fixture(scope="module")
def small(spark):
    owners = spark.createDataFrame([("L1", "['C1','C2']"), ("L1", "C2"), ("L2", "C3,C9"), ("L3", None)], "LandLordID string, AllCompanyID string")
    comp = spark.createDataFrame(
        [("C1", "Actively Seeking New Employees", 100.0, 50.0, 10.0, 4.0), ("C2", "Out of Business", 300.0, 10.0, 20.0, 5.0), ("C3", "None", None, None, 0.0, 0.0)],
        "CompanyID string, CompanyStatus string, MonthlyBudget double, SalesOfMainProduct double, TotalActiveClients double, ReturningClient double")
    return P.explode_bridge(owners), comp


def test_bridge_and_base(small, spark):
    bridge, comp = small
    assert {tuple(r) for r in bridge.collect()} == {("L1", "C1"), ("L1", "C2"), ("L2", "C3"), ("L2", "C9")}
    base = P.build_model_base(bridge, comp)
    assert base.count() == 4 and P.unmatched_members(bridge, comp).first()[0] == 1
    with pytest.raises(ValueError):
        P.build_model_base(bridge, comp.unionByName(comp))
    with pytest.raises(ValueError):
        P.explode_bridge(spark.createDataFrame([("L1",)], "LandLordID string"))


def test_portfolio_aggregates(small):
    bridge, comp = small
    base = P.build_model_base(bridge, T.binary_target(comp))
    got = {r["LandLordID"]: r for r in P.portfolio_features(base).collect()}
    assert got["L1"]["PortfolioActiveRate"] == 0.5 and got["L1"]["PortfolioMeanBudget"] == 200.0
    assert got["L1"]["PortfolioStdBudget"] == pytest.approx(np.std([100, 300], ddof=1))
    assert got["L1"]["PortfolioMeanRetention"] == pytest.approx((0.4 + 0.25) / 2, abs=1e-6)
    assert got["L2"]["PortfolioSize"] == 2 and got["L2"]["PortfolioMeanBudget"] is None
    assert got["L1"]["PortfolioMeanSuccessScore"] is None


def test_landlord_ratios(spark):
    df = spark.createDataFrame(
        [("L1", 2000, 1000.0, 20000.0, 10, " Retail "), ("L2", None, -5.0, None, 0, "nan"), ("L3", 1600, 1.0, 1.0, 1, "")],
        "LandLordID string, YearFounded int, Area double, TotalPopulationAround double, ActiveCompanies int, PreferredIndustry string")
    got = {r["LandLordID"]: r for r in P.landlord_features(df, 2025).collect()}
    a = got["L1"]
    assert a["LandlordAge"] == 25 and a["PopulationDensity"] == pytest.approx(20, abs=1e-4) and a["AreaPerCompany"] == pytest.approx(100, abs=1e-4)
    assert a["PreferredIndustry"] == "Retail" and a["OriginCity"] is None
    assert got["L2"]["Area"] == 0.0 and got["L2"]["PopulationDensity"] is None and got["L2"]["PreferredIndustry"] is None
    assert got["L3"]["LandlordAge"] is None and got["L3"]["PreferredIndustry"] is None


def test_shrinkage(spark):
    rows = spark.createDataFrame([("A", 1.0)] * 2 + [("B", -1.0)] * 8 + [("B", None)], "LandLordID string, OOFResidual double")
    score = lambda m: {r["LandLordID"]: r for r in P.entity_shrunk_score(rows, m=m).collect()}
    assert score(0)["A"]["AdjustedScore"] == 1.0
    assert score(10)["A"]["AdjustedScore"] == pytest.approx(2 / 12 * 1.0 + 10 / 12 * -0.6)
    assert score(1e9)["B"]["AdjustedScore"] == pytest.approx(-0.6, abs=1e-6) and score(10)["B"]["TenantCount"] == 8


def test_binary_target_modes(spark):
    df = spark.createDataFrame([(" ACTIVE ",), ("closed",), ("other",), (None,), ("None",)], "CompanyStatus string")
    get = lambda cfg: [r[0] for r in T.binary_target(df, cfg=cfg).select("CompanyIsActive").collect()]
    assert get(TargetConfig(positive=("active",), negative=None, exclude=())) == [1.0, 0.0, 0.0, 0.0, 0.0]
    assert get(TargetConfig(positive=("active",), negative=("closed",), exclude=())) == [1.0, 0.0, None, None, None]
    assert get(TargetConfig(positive=("active",), negative=None, exclude=("other",)))[2] is None
    with pytest.raises(ValueError):
        T.binary_target(df.withColumnRenamed("CompanyStatus", "x"))


def test_composite_uses_available_weight(spark):
    df = spark.createDataFrame(
        [("a", 10.0, 1.0, None), ("b", 20.0, 1.0, 3.0), ("c", None, None, 9.0), ("d", None, None, None)],
        "CompanyID string, SalesOfMainProduct double, MonthlyBudget double, TotalActiveClients double")
    got = {r["CompanyID"]: r for r in T.composite_score(df, return_components=True).collect()}
    assert got["b"]["share_sales_efficiency"] == 1.0 and got["a"]["share_sales_efficiency"] == 0.0
    assert got["a"]["SuccessScore"] == 0.0
    assert got["c"]["SuccessScore"] == 1.0 and got["d"]["SuccessScore"] is None
    assert got["b"]["SuccessScore"] == pytest.approx((0.30 * 1.0 + 0.15 * 0.0) / 0.45)
    ranks = {r["CompanyID"]: r["SuccessScoreRank"] for r in T.build_targets(df.withColumn("CompanyStatus", F.lit("x"))).collect()}
    assert ranks == {"c": 1, "b": 2, "a": 3, "d": 4}


def test_kinds():
    assert S.detect_input_kind(["LandLordID"]) == "landlord_ids"
    assert S.detect_input_kind(["LandLordID", "AllCompanyID"]) == "raw_landlords"
    assert S.detect_input_kind(["LandlordAge", "PopulationDensity", "PortfolioMeanClients"]) == "feature_matrix"
    assert S.detect_input_kind(["foo"]) == "unknown"


def test_table_helpers(spark):
    df = spark.createDataFrame([("b", " x "), ("a", "")], "CompanyID string, CompanyStatus string")
    assert [r[0] for r in S.list_ids(df, "CompanyID").collect()] == ["a", "b"]
    assert [r[0] for r in S.clean_strings(df, ["CompanyStatus", "absent"]).orderBy("CompanyID").select("CompanyStatus").collect()] == [None, "x"]
    assert S.lookup_entity(df, "CompanyID", "a").count() == 1
    for bad in (lambda: S.lookup_entity(df, "CompanyID", "z"), lambda: S.page_ids(df, "CompanyID", ids=["a", "zz"])):
        with pytest.raises(KeyError):
            bad()
    assert S.page_ids(df, "CompanyID", 1, 5).count() == 1
    assert S.ensure_columns(df, ["n1"], ["CompanyStatus", "t1"]).columns == ["CompanyID", "CompanyStatus", "n1", "t1"]
    with pytest.raises(ValueError):
        S.require_columns(df, ["nope"])
    assert S.missing_columns(df, S.COMPANY_COLUMNS)[0] == "PrimaryType"


def severities(df):
    return sorted((r["check"], r["severity"]) for r in df.collect())


def test_checks_clean_and_dirty(spark):
    ids = spark.createDataFrame([("a",), ("a",), (None,), (" ",)], "id string")
    assert severities(Q.check_identifiers(ids, "id", "t")) == [
        ("identifier_integrity", "CRITICAL"), ("identifier_integrity", "CRITICAL"), ("identifier_integrity", "WARNING")]
    assert severities(Q.check_identifiers(spark.createDataFrame([("a",), ("b",)], "id string"), "id", "t")) == [("identifier_integrity", "INFO")]
    dates = spark.createDataFrame([("2020-01-01", 1990), ("junk", 1500), ("2999-01-01", None)], "LastUpdated string, YearFounded int")
    got = Q.check_dates(dates, ("LastUpdated", "YearFounded", "Gone"), "t", dt.date(2025, 1, 1)).collect()
    assert {(r["column"], r["severity"]) for r in got} == {("LastUpdated", "WARNING"), ("YearFounded", "WARNING"), ("YearFounded", "INFO"), ("Gone", "WARNING")}
    nums = spark.createDataFrame([(-1.0, 0.0), (5.0, 2.0)], "Area double, MonthlyBudget double")
    assert severities(Q.check_ranges(nums, ("Area",), "t")) == [("denominator_guard", "INFO"), ("range_check", "WARNING")]
    nest = spark.createDataFrame([(9.0, 1.0)] + [(1.0, 9.0)] * 9, "ClientsInTheLast7Days double, ClientsInTheLast6Months double")
    assert severities(Q.check_window_nesting(nest)) == [("time_window_consistency", "WARNING")]
    cats = spark.createDataFrame([("A",), ("a ",), (" ",)] + [("B",)] * 297, "PrimaryType string")
    assert severities(Q.check_categories(cats, ("PrimaryType",), "t")) == [("category_quality", "INFO"), ("category_quality", "WARNING"), ("category_quality", "WARNING")]
    assert severities(Q.check_snapshot_structure(ids, "id", "t")) == [("snapshot_structure", "WARNING")]
    sparse = spark.createDataFrame([(None, 1, 1), (None, None, 1), (1, 1, 1)], "a int, b int, c int")
    assert severities(Q.check_missing(sparse, "t")) == [("missing_rates", "CRITICAL"), ("missing_rates", "WARNING")]


def test_coverage_relationship_and_gate(spark, small):
    bridge, comp = small
    assert severities(Q.check_coverage(bridge, comp)) == [("bridge_coverage", "CRITICAL")]
    owners = spark.createDataFrame([("L1", 2), ("L2", 40)], "LandLordID string, ActiveCompanies int")
    row = Q.check_relationships(owners, bridge).first()
    assert row["severity"] == "WARNING" and row["detail"]["max_discrepancy"] == "38"
    assert Q.check_relationships(owners.drop("ActiveCompanies"), bridge).first()["severity"] == "WARNING"
    assert Q.has_critical(Q.check_coverage(bridge, comp))
    with pytest.raises(ValueError):
        Q.validate_all(owners, comp, bridge, dt.date(2025, 1, 1), strict=True)


def test_profiles(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "x"), (None, None), (4.0, "y")], "v double, t string")
    prof = {r["column"]: r for r in PR.profile_columns(df).collect()}
    assert (prof["v"]["non_null"], prof["v"]["null_pct"], prof["t"]["top_value"], prof["t"]["n_unique"]) == (3, 25.0, "x", 2)
    num = PR.numeric_summary(df).first()
    import pandas as pd

    s = pd.Series([1.0, 2.0, 4.0])
    assert num["skew"] == pytest.approx(s.skew()) and num["q25"] == pytest.approx(s.quantile(0.25)) and num["kurtosis"] is None
    cats = [(r["value"], r["count"], r["pct"]) for r in PR.category_summary(df).collect()]
    assert (None, 1, 25.0) in cats and ("x", 2, 50.0) in cats
    ident = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", None)], "customerid string, accountid string")
    rep = PR.identifier_report(ident).first()
    assert (rep["n_customers"], rep["n_accounts"], rep["n_pairs"], rep["customer_id_is_unique"]) == (2, 2, 3, False)
    with pytest.raises(ValueError):
        PR.require_unique_customers(ident)
    assert PR.identifier_report(ident.select("customerid")).first()["n_pairs"] == 2
    seen, obs = PR.observe_quality(spark.createDataFrame([("c", dt.date(2025, 1, 1), -1.0)], "customerid string, date date, amount double"))
    seen.count()
    assert obs.get["non_positive_amount_rate"] == 1.0


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4).alias("s"))
    a, b = (PR.uniform_sample(df, "id", 50).select("id").collect() for _ in range(2))
    assert a == b and len(a) == 50
    forced = spark.createDataFrame([(7,), (8,)], "id long")
    ids = {r["id"] for r in PR.uniform_sample(df, "id", 50, forced=forced).collect()}
    assert {7, 8} <= ids and len(ids) == 50
    strata = PR.stratified_sample(df, "id", "s", 20).groupBy("s").count().collect()
    assert {r["count"] for r in strata} == {5}


def test_psi(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=3000)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    value = lambda ref, act: DR.psi(ref, act, "v", rows_per_range=700).first()["psi"]
    ref = frame(base)
    assert value(ref, ref) < 0.01
    assert value(ref, frame(rng.normal(3, 1, 2000))) > 0.25
    assert value(frame([5.0] * 10), frame([5.0] * 4)) == 0.0
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    act = rng.normal(0.3, 1.2, 1500)
    r, a = (np.clip(np.histogram(x, edges)[0] / len(x), 1e-6, None) for x in (base, act))
    assert value(ref, frame(act)) == pytest.approx(float(np.sum((a - r) * np.log(a / r))), rel=1e-6)
    rep = DR.drift_report(ref, frame(act), ["v", "absent"])
    assert rep.count() == 1 and DR.drift_action(rep).first()["action"] in ("none", "retrain")
