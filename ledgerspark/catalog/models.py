"""Model queries. Fits are checked for shape and invariants; the table steps around them have SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ledgerspark.catalog.billing import INTERVAL_SQL, MATRIX_SQL
from ledgerspark.catalog.portfolio import LANDLORD_FEATURE_SQL, PORTFOLIO_SQL, RESIDUAL_SQL, scored_base, stored_base
from ledgerspark.catalog.registry import query
from ledgerspark.operators import billing as B
from ledgerspark.operators import metrics as M
from ledgerspark.operators import models as ML
from ledgerspark.operators import portfolio as P
from ledgerspark.operators import profile as PR
from ledgerspark.operators import shapley as SH
from ledgerspark.plans import churn as CP
from ledgerspark.plans import scoring as SP
from ledgerspark.session import materialise, new_scratch
from ledgerspark.sources import domain as D
from ledgerspark.sources import sinks as SK

ROUNDS, DEPTH = 20, 5


def matrix(spark, sf):
    return CP.churn_matrix(D.invoices(spark, sf), D.SNAPSHOTS, daily=True)


# A fit can't be stated in SQL, so these queries return every scored row with what must hold for it; the twins state the same
# rows. Quality on held-out data is a matter of the tests.
TEST_SQL = f"""WITH {MATRIX_SQL}, test AS (SELECT *, CAST(round(future_rev, 2) < 0.5 * round(past_rev, 2) AS INT) AS y_churn
  FROM mx WHERE snapshot_date = (SELECT max(snapshot_date) FROM mx))"""


def holds(condition):
    """False instead of null, so a missing prediction shows."""
    return F.coalesce(condition, F.lit(False))


def is_share(name):
    return holds(F.col(name).between(0, 1))


@query("temporal_split", f"""WITH {MATRIX_SQL} SELECT CASE WHEN snapshot_date = (SELECT max(snapshot_date) FROM mx) THEN 'test' ELSE 'train' END AS part,
  count(*) AS n, min(customerid) AS first_id FROM mx GROUP BY 1""")
def temporal_split(spark, sf):
    train, test = ML.temporal_split(matrix(spark, sf))
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("customerid").alias("first_id"))


@query("fit_frequency", f"{TEST_SQL} SELECT customerid, y_churn, true AS is_probability FROM test")
def fit_frequency(spark, sf):
    train, test = ML.temporal_split(matrix(spark, sf))
    model = ML.fit_frequency(train, CP.WITH_INTERVAL, max_iter=ROUNDS, max_depth=DEPTH)
    return model.predict(test, "p").select("customerid", "y_churn", is_share("p").alias("is_probability"))


@query("fit_severity", f"{TEST_SQL} SELECT customerid, true AS not_negative FROM test WHERE y_churn = 1")
def fit_severity(spark, sf):
    train, test = ML.temporal_split(matrix(spark, sf))
    model = ML.fit_severity(train, CP.WITH_INTERVAL, max_iter=ROUNDS, max_depth=DEPTH)
    scored = model.predict(test.filter(F.col("y_churn") == 1), "s")
    return scored.select("customerid", holds(F.col("s") >= 0).alias("not_negative"))


@query("fit_logistic_baseline", f"{TEST_SQL} SELECT customerid, y_churn, true AS is_probability FROM test")
def fit_logistic_baseline(spark, sf):
    train, test = ML.temporal_split(matrix(spark, sf))
    scored = ML.fit_logistic_baseline(train, CP.WITH_INTERVAL).predict(test, "p")
    return scored.select("customerid", "y_churn", is_share("p").alias("is_probability"))


@query("expected_loss", f"{TEST_SQL} SELECT customerid, n_events >= 2 AS recurring, true AS is_product FROM test")
def expected_loss(spark, sf):
    train, test = ML.temporal_split(matrix(spark, sf))
    pair = CP.fit_pair(train, CP.WITH_INTERVAL, ROUNDS, DEPTH, 42)
    both = pair.severity.predict(ML.with_expected_loss(test, pair.frequency, pair.severity), "severity")
    product = F.abs(F.col("expected_loss") - F.col("churn_prob") * F.col("severity")) < 1e-6
    return both.select("customerid", (F.col("n_events") >= 2).alias("recurring"), holds(product).alias("is_product"))


@query("ablation_predictions", f"""{TEST_SQL} SELECT customerid, y_churn, CAST(n_events >= 2 AS INT) AS recurring, true AS all_probabilities,
  true AS no_loss_negative FROM test""")
def ablation_predictions(spark, sf):
    train, test = ML.temporal_split(matrix(spark, sf))
    out = ML.ablation_predictions(train, test, B.FEATURE_SETS, ["customerid", "y_churn", "y_loss"])
    every = lambda parts: reduce(lambda a, b: a & b, parts)
    return out.select(
        "customerid", "y_churn", "recurring", every([is_share(f"p_{k}") for k in B.FEATURE_SETS]).alias("all_probabilities"),
        every([holds(F.col(f"exp_{k}") >= 0) for k in B.FEATURE_SETS]).alias("no_loss_negative"))


@query("holdout_comparison", f"""{TEST_SQL} SELECT segment, count(*) AS n_test, true AS curves_in_range, true AS deltas_add_up
  FROM (SELECT 'all' AS segment, * FROM test UNION ALL SELECT 'recurring', * FROM test WHERE n_events >= 2) GROUP BY 1""")
def holdout_comparison(spark, sf):
    """Both models on all test customers and on those with a second event."""
    train, test = ML.temporal_split(matrix(spark, sf))
    models = CP.fit_dual(train, ROUNDS, DEPTH)
    parts = []
    for segment, rows in (("all", test), ("recurring", test.filter("n_events >= 2"))):
        one = CP.holdout_comparison(rows, models)
        shares = [is_share(f"{m}_{c}") for m in ("with", "without") for c in ("pr_auc", "roc_auc", "recall")]
        deltas = [holds(F.abs(F.col(f"delta_{c}") - F.col(f"with_{c}") + F.col(f"without_{c}")) < 1e-9) for c in ("pr_auc", "roc_auc", "recall", "expected_loss_mae")]
        parts.append(one.select(
            F.lit(segment).alias("segment"), "n_test", reduce(lambda a, b: a & b, shares).alias("curves_in_range"),
            reduce(lambda a, b: a & b, deltas).alias("deltas_add_up")))
    return parts[0].unionByName(parts[1])


EXPLAINED = 25


def batch_report(spark, sf):
    train, _ = ML.temporal_split(matrix(spark, sf))
    feats = B.build_scoring_features(D.invoices(spark, sf), [D.AS_OF], daily=True)
    customers = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("customerid"))
    return materialise(CP.batch_score_dual(feats, CP.fit_dual(train, ROUNDS, DEPTH), customers=customers, explain_top_n=EXPLAINED), "report")


def drivers_fit(side):
    """Strongest first, signs as listed, the main driver the strongest of all; without a briefing the text says so."""
    b = side["briefing"]
    ups, downs = F.transform(b["increasing"], lambda d: d["contribution"]), F.transform(b["decreasing"], lambda d: -d["contribution"])
    both = F.concat(ups, downs)
    fits = (F.sort_array(ups, asc=False) == ups) & (F.sort_array(downs, asc=False) == downs) & F.forall(both, lambda v: v >= 0) & (
        F.abs(b["main"]["contribution"]) == F.array_max(both)) & b["told"].contains(b["main"]["label"])
    return F.when(b.isNull(), side["drivers_told"].startswith("Detailed factor-level")).otherwise(fits)


@query("batch_score_dual", f"""WITH {INTERVAL_SQL}, k AS (SELECT customerid, billing_interval, round_even(raw_confidence, 4) AS conf FROM iv WHERE snapshot_date = DATE '2000-06-01')
SELECT CAST(c_custkey AS VARCHAR) AS customerid, billing_interval AS inferred_interval, conf AS interval_confidence, k.customerid IS NOT NULL AS has_history,
  CASE WHEN k.customerid IS NULL THEN 'no_history' WHEN conf < 0.5 THEN 'low_confidence' ELSE 'by_risk' END AS basis, true AS both_explained, true AS agreement_told, true AS drivers_fit
FROM customer LEFT JOIN k ON k.customerid = CAST(c_custkey AS VARCHAR)""")
def batch_score_dual(spark, sf):
    """Every customer of the table: scored from history, or Review without any; the riskiest get their drivers."""
    out = batch_report(spark, sf)
    side, other = F.col("with_interval"), F.col("without_interval")
    missing = F.col("inferred_interval").isNull()
    low = (F.col("interval_confidence") < 0.5) & (F.col("recommendation") == "Review") & (other["recommendation"] == "Review")
    risk = F.when(side["churn_probability"] < 0.45, "Continue").when(side["churn_probability"] >= 0.7, "No-Go")
    by_risk = (F.col("interval_confidence") >= 0.5) & (risk.isNull() | (risk == F.col("recommendation")))
    basis = F.when(missing & (F.col("reason") == "no_history") & (F.col("recommendation") == "Review"), "no_history").when(
        low, "low_confidence").when(by_risk, "by_risk").otherwise("unsound")
    told = missing | (F.col("comparison.recommendations_agree") == (side["recommendation"] == other["recommendation"]))
    explained = F.length("decision_reason") > 0
    return out.select(
        "customerid", "inferred_interval", "interval_confidence", (~missing).alias("has_history"), basis.alias("basis"),
        holds(explained).alias("both_explained"), holds(told).alias("agreement_told"),
        (missing | (holds(drivers_fit(side)) & holds(drivers_fit(other)))).alias("drivers_fit"))


@query("batch_drivers", f"""WITH {INTERVAL_SQL}, k AS (SELECT count(*) AS n FROM iv WHERE snapshot_date = DATE '2000-06-01')
SELECT least(n, {EXPLAINED}) AS n_explained, true AS riskiest, true AS same_on_both_sides FROM k""")
def batch_drivers(spark, sf):
    """The explained customers of the report are those of highest churn probability, on either side."""
    out = batch_report(spark, sf).filter("inferred_interval IS NOT NULL")
    p, told = F.col("with_interval.churn_probability"), F.col("with_interval.briefing").isNotNull()
    return out.agg(
        F.count_if(told).alias("n_explained"),
        holds(F.min(F.when(told, p)) >= F.coalesce(F.max(F.when(~told, p)), F.lit(0.0))).alias("riskiest"),
        F.every(told == F.col("without_interval.briefing").isNotNull()).alias("same_on_both_sides"))


@query("group_kfold", """SELECT fold, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM (SELECT o_custkey,
  CAST(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS UBIGINT) % 5 AS INT) AS fold FROM orders) GROUP BY 1""")
def group_kfold(spark, sf):
    out = ML.group_kfold(D.table(spark, sf, "orders").select("o_custkey"), "o_custkey", 5)
    per = out.groupBy("fold", "o_custkey").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("fold").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("groups"))


BASELINE = ["MonthlyBudget", "Investments", "Rank", "YearFounded"]


def labelled_base(spark, sf):
    return scored_base(spark, sf).drop("OOFResidual").select("LandLordID", "CompanyID", "CompanyIsActive", *BASELINE)


@query("oof_residuals", f"""WITH {PORTFOLIO_SQL} SELECT LandLordID, CompanyID, CompanyIsActive, CompanyIsActive IS NOT NULL AS has_fold, true AS sound,
  true AS owner_in_one_fold FROM full_base""")
def oof_residuals(spark, sf):
    out = materialise(ML.oof_residuals(labelled_base(spark, sf), BASELINE), "oof")
    y, p, r, fold = (F.col(c) for c in ("CompanyIsActive", "OOFPredictedProb", "OOFResidual", "OOFFold"))
    known = p.between(0, 1) & (F.abs(y - p - r) < 1e-9) & fold.between(0, 4)
    sound = F.when(y.isNull(), p.isNull() & r.isNull() & (fold == -1)).otherwise(holds(known))
    folds = out.filter(fold >= 0).groupBy("LandLordID").agg((F.count_distinct("OOFFold") == 1).alias("owner_in_one_fold"))
    return out.join(folds, "LandLordID", "left").select(
        "LandLordID", "CompanyID", "CompanyIsActive", (fold >= 0).alias("has_fold"), sound.alias("sound"),
        F.coalesce("owner_in_one_fold", F.lit(True)).alias("owner_in_one_fold"))


@query("adjusted_scores", f"""WITH {PORTFOLIO_SQL} SELECT LandLordID, count(CompanyIsActive) AS TenantCount, true AS is_shrunk_mean FROM full_base
GROUP BY 1 HAVING count(CompanyIsActive) > 0""")
def adjusted_scores(spark, sf):
    """Owner scores against the stored out-of-fold residuals, by the shrinkage formula with m = 10."""
    base = materialise(labelled_base(spark, sf), "labelled")
    kept = materialise(ML.oof_residuals(base, BASELINE), "oof").filter(F.col("OOFResidual").isNotNull())
    scores = materialise(ML.adjusted_scores(base, BASELINE), "scores")
    per = kept.groupBy("LandLordID").agg(F.count("OOFResidual").alias("n"), F.avg("OOFResidual").alias("own"))
    want = F.col("n") / (F.col("n") + 10.0) * F.col("own") + 10.0 / (F.col("n") + 10.0) * kept.agg(F.avg("OOFResidual")).scalar()
    return scores.join(per, "LandLordID", "left").select("LandLordID", "TenantCount", holds(F.abs(F.col("AdjustedScore") - want) < 1e-9).alias("is_shrunk_mean"))


def landlord_matrix(spark, sf):
    base = stored_base(spark, sf)
    return materialise(P.build_landlord_matrix(D.landlords(spark, sf), base, P.entity_shrunk_score(base), D.AS_OF_YEAR), "owners")


TEXTS = ["PreferredIndustry"]
OWNERS_SQL = f"WITH {RESIDUAL_SQL}, {LANDLORD_FEATURE_SQL}, ow AS (SELECT LandLordID, TenantCount FROM lf JOIN shrunk USING (LandLordID))"


@query("encode_features", f"""WITH {LANDLORD_FEATURE_SQL}, c AS (SELECT LandLordID, coalesce(PreferredIndustry, '__missing__') AS v FROM lf)
SELECT LandLordID, CAST(dense_rank() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM c""")
def encode_features(spark, sf):
    feats = P.landlord_features(D.landlords(spark, sf), D.AS_OF_YEAR)
    _, other, _ = ML.encode_features(feats, feats, ["LandlordAge", "Area"], TEXTS)
    return other.select("LandLordID", F.col("PreferredIndustry__i").alias("code"))


@query("cv_regressors", f"""{OWNERS_SQL} SELECT feature_set, model_type, CAST(CAST('0x' || substr(md5(LandLordID), 1, 8) AS UBIGINT) % 5 AS INT) AS fold, count(*) AS n,
  true AS errors_in_order FROM ow, (VALUES ('random_forest'), ('boosted_trees'), ('linear')) m(model_type), (VALUES ('with_portfolio'), ('landlord_only')) f(feature_set) GROUP BY ALL""")
def cv_regressors(spark, sf):
    """All features of both sets, every model, five folds: rows per fold, and error measures that fit together."""
    parts = []
    base = stored_base(spark, sf)
    for kind in ("with_portfolio", "landlord_only"):
        m = materialise(P.build_landlord_matrix(D.landlords(spark, sf), base, P.entity_shrunk_score(base), D.AS_OF_YEAR, kind), "owners")
        done = ML.cv_regressors(m, *P.feature_lists(m), final=False)
        counts = done.predictions.filter(F.col("pred").isNotNull()).groupBy("model_type", "fold").agg(F.count(F.lit(1)).alias("n"))
        parts.append(done.folds.drop("n").join(counts, ["model_type", "fold"]).select(
            F.lit(kind).alias("feature_set"), "model_type", "fold", "n", holds((F.col("mae") >= 0) & (F.col("rmse") >= F.col("mae") - 1e-12)).alias("errors_in_order")))
    return parts[0].unionByName(parts[1])


def fitted_owner_model(spark, sf):
    m = landlord_matrix(spark, sf)
    numeric, texts = P.feature_lists(m)
    numeric = ML.usable(m, numeric)
    ready = ML.as_double(m, numeric).withColumns({c: F.coalesce(F.col(c), F.lit("__missing__")) for c in texts}).withColumn(
        "_t", F.col("AdjustedScore"))
    model = Pipeline(stages=[*ML.encoding(numeric, texts, ready, trees=True).getStages(), ML.regressors()["random_forest"]]).fit(ready)
    return materialise(ready, "ready"), model, [*numeric, *texts]


@query("score_entities", f"""{OWNERS_SQL} SELECT LandLordID, TenantCount, CASE WHEN TenantCount >= 10 THEN 'high' WHEN TenantCount >= 5 THEN 'medium' ELSE 'low' END AS ConfidenceLevel,
  true AS score_in_range, true AS band_fits FROM ow""")
def score_entities(spark, sf):
    rows, model, _ = fitted_owner_model(spark, sf)
    reference = model.transform(rows).select(F.col("prediction").alias("score"))
    out = SP.score_entities(rows, model, reference, "random_forest")
    p = F.col("PercentileRank")
    fits = F.when(p >= 70, F.col("QualityBand") == "good").when(p <= 30, F.col("QualityBand") == "bad").otherwise(
        F.col("QualityBand") == "neutral")
    return out.select("LandLordID", "TenantCount", "ConfidenceLevel", holds(F.col("PredictedQualityScore").between(0, 100)).alias("score_in_range"), holds(fits).alias("band_fits"))


@query("tree_contributions", f"{OWNERS_SQL} SELECT LandLordID, true AS adds_up FROM ow")
def tree_contributions(spark, sf):
    """Prediction less all contributions is the same base value for every owner."""
    rows, model, names = fitted_owner_model(spark, sf)
    long = materialise(ML.tree_contributions(rows, model, names, ["LandLordID"]), "contributions")
    summed = long.groupBy("LandLordID").agg(F.sum("contribution").alias("total"), F.count(F.lit(1)).alias("k"))
    left = materialise(model.transform(rows).join(summed, "LandLordID").select("LandLordID", "k", (F.col("prediction") - F.col("total")).alias("base")), "bases")
    one = left.agg(F.avg("base")).first()[0]
    return left.select("LandLordID", holds((F.abs(F.col("base") - F.lit(one)) < 1e-6) & (F.col("k") == len(names))).alias("adds_up"))


OWNER_FEATURES = (
    "LandlordAge Area TotalPopulationAround ActiveCompanies PopulationDensity AreaPerCompany PopulationPerCompany PortfolioSize "
    "PortfolioActiveRate PortfolioMeanBudget PortfolioStdBudget PortfolioMeanSales PortfolioMeanClients PortfolioMeanRetention "
    "PortfolioMeanSuccessScore PortfolioStdSuccessScore PreferredIndustry OriginCity OriginCountry").split()


@query("mean_abs_contributions", f"{OWNERS_SQL} SELECT unnest({OWNER_FEATURES!r}) AS feature, true AS is_mean_of_rows WHERE (SELECT count(*) FROM ow) > 0")
def mean_abs_contributions(spark, sf):
    """Importance of every feature of the owner model: the mean of the rows' own values, and together all of the explained spread."""
    rows, model, names = fitted_owner_model(spark, sf)
    long = materialise(ML.tree_contributions(rows, model, names, ["LandLordID"]), "contributions")
    out = ML.mean_abs_contributions(long)
    value = F.col("mean_abs_contribution")
    own = long.groupBy("feature").agg((F.sum(F.abs("contribution")) / rows.count()).alias("own"))
    return out.join(own, "feature").select("feature", holds((value >= 0) & (F.abs(value - F.col("own")) < 1e-12)).alias("is_mean_of_rows"))


@query("customer_contributions", f"""{TEST_SQL} SELECT customerid, {len(CP.WITH_INTERVAL)} AS n_features, true AS adds_up FROM test""")
def customer_contributions(spark, sf):
    """Shapley values of the churn model for every test customer: base and values give its log-odds."""
    train, test = ML.temporal_split(matrix(spark, sf))
    model = ML.fit_frequency(train, CP.WITH_INTERVAL, max_iter=ROUNDS, max_depth=DEPTH, calibrate=False)
    scored = model.predict(test, "p")
    found = SH.shapley_drivers(ML.as_double(scored, model.features), model.pipeline, model.features, ["customerid", "p"])
    total = F.col("base") + F.aggregate("drivers", F.lit(0.0), lambda t, d: t + d["contribution"])
    return found.select("customerid", F.size("drivers").alias("n_features"), holds(F.abs(1 / (1 + F.exp(-total)) - F.col("p")) < 1e-9).alias("adds_up"))


@query("linear_contributions", f"""WITH {LANDLORD_FEATURE_SQL} SELECT LandLordID, round(coalesce(0.002 * (LandlordAge - 100), 0), 6) AS age_part, round(coalesce(0.0001 * (Area - 5000), 0), 6) AS area_part FROM lf""")
def linear_contributions(spark, sf):
    feats = P.landlord_features(D.landlords(spark, sf), D.AS_OF_YEAR)
    out = ML.linear_contributions(feats, ["LandlordAge", "Area"], [0.002, 0.0001], [100.0, 5000.0])
    return out.select(
        "LandLordID", F.round(F.col("drivers")[0]["contribution"], 6).alias("age_part"),
        F.round(F.col("drivers")[1]["contribution"], 6).alias("area_part"))


@query("feature_sparsity", f"""WITH {PORTFOLIO_SQL} SELECT f AS feature, CAST(0 AS BIGINT) AS n_values, f LIKE 'Portfolio%' AS is_portfolio
FROM (VALUES ('PortfolioFake', 0), ('OtherFake', 0)) t(f, k) WHERE (SELECT count(*) FROM pf) > 0""")
def feature_sparsity(spark, sf):
    feats = P.portfolio_features(scored_base(spark, sf))
    return PR.feature_sparsity(feats, ["PortfolioSize", "PortfolioMeanBudget", "PortfolioFake", "OtherFake"])


@query("save_load_model", f"{OWNERS_SQL} SELECT LandLordID, true AS same_score FROM ow")
def save_load_model(spark, sf):
    """Save the artifact, load it again: the loaded model gives the scores of the fitted one."""
    rows, model, names = fitted_owner_model(spark, sf)
    path = new_scratch(spark, "artifact")
    ML.save_model(model, path, model.transform(rows), "prediction", {"model_type": "random_forest", "features": names})
    loaded, reference, meta = ML.load_model(spark, path)
    was = model.transform(rows).select("LandLordID", F.col("prediction").alias("was"))
    now = SP.score_entities(rows, loaded, reference, meta["model_type"])
    return now.join(was, "LandLordID").select("LandLordID", holds(F.abs(F.col("PredictedScore") - F.col("was")) < 1e-12).alias("same_score"))


@query("write_result", f"""WITH {MATRIX_SQL} SELECT snapshot_date, count(*) AS n FROM mx GROUP BY 1""")
def write_result(spark, sf):
    """Write a partitioned result with a nested column, read it back and count."""
    root = new_scratch(spark, "results")
    rows = matrix(spark, sf).select("customerid", "snapshot_date", F.struct("y_churn", "y_loss").alias("labels"))
    paths = SK.write_result(rows, root, "run-1", ["snapshot_date"])
    back = spark.read.option("header", True).csv(paths["csv"])
    return back.groupBy(F.to_date("snapshot_date").alias("snapshot_date")).agg(F.count(F.lit(1)).alias("n"))


@query("write_verdict_lists", """SELECT o_orderstatus AS recommendation, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS first_id FROM orders GROUP BY 1""")
def write_verdict_lists(spark, sf):
    path = new_scratch(spark, "verdicts")
    rows = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("CompanyID"), F.col("o_orderstatus").alias("recommendation"))
    SK.write_verdict_lists(rows, path)
    return spark.read.text(path).groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first_id"))

