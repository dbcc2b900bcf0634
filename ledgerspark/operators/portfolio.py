"""Owners and members: bridge, model base, portfolio features, shrunk scores, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.config import PortfolioConfig
from ledgerspark.functions.idlists import parse_id_list
from ledgerspark.functions.numeric import clip, col_or_null, count_if, safe_ratio_eps
from ledgerspark.sources.tables import (
    LANDLORD_RENAMES, clean_text, detect_input_kind, ensure_columns, rename_columns, require_columns, semi_filter_ids,
)

OWNER, MEMBER = "LandLordID", "CompanyID"
NON_FEATURES = ("LandLordID", "AdjustedScore", "RawAdjustedScore", "TenantCount")
CLEANED_DIMS = ("PreferredIndustry", "OriginCity", "OriginCountry")
TARGET_COLUMNS = ("CompanyID", "CompanyIsActive", "SuccessScore", "SuccessScoreRank")


def explode_bridge(landlords: DataFrame, fmt: str = "auto", column: str = "AllCompanyID") -> DataFrame:
    """Parsed id lists as distinct (owner, member) pairs. The explode is row-local."""
    require_columns(landlords, [OWNER, column])
    is_array = isinstance(landlords.schema[column].dataType, T.ArrayType)
    return landlords.select(
        F.trim(F.col(OWNER).cast("string")).alias(OWNER),
        F.explode(parse_id_list(F.col(column), fmt, is_array)).alias(MEMBER),
    ).distinct()


def require_unique(df: DataFrame, key: str) -> DataFrame:
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(key).limit(5)
    bad = [row[0] for row in twice.collect()]
    if bad:
        raise ValueError(f"{key} is not unique, e.g. {bad}")
    return df


def build_model_base(bridge: DataFrame, companies: DataFrame, check: bool = True) -> DataFrame:
    """bridge LEFT JOIN companies, one company row per id. AQE splits a skewed company."""
    if check:
        require_unique(companies, MEMBER)
    return bridge.join(companies, MEMBER, "left").select(OWNER, MEMBER, *[c for c in companies.columns if c != MEMBER])


def unmatched_members(bridge: DataFrame, companies: DataFrame) -> DataFrame:
    ids = bridge.select(MEMBER).distinct()
    return ids.join(companies.select(MEMBER).distinct(), MEMBER, "left_anti").agg(F.count(F.lit(1)).alias("n_unmatched"))


def attach_targets(model_base: DataFrame, scored: DataFrame) -> DataFrame:
    """Drop clashing target columns, then LEFT JOIN the fresh ones by company."""
    cols = [c for c in TARGET_COLUMNS if c in scored.columns]
    base = model_base.drop(*[c for c in cols if c != MEMBER])
    return base.join(scored.select(*cols), MEMBER, "left")


def landlord_features(landlords: DataFrame, reference_year: int) -> DataFrame:
    """Owner-level features: age, clipped counts, ratios, cleaned dimensions. One projection."""
    df = rename_columns(require_columns(landlords, [OWNER]), LANDLORD_RENAMES)
    num = lambda c: col_or_null(df, c)
    age = F.lit(float(reference_year)) - num("YearFounded")
    area, people, firms = (clip(num(c), 0.0) for c in ("Area", "TotalPopulationAround", "ActiveCompanies"))
    dims = {
        c: clean_text(F.col(c).cast("string"), ("nan", "None", "NaN")) if c in df.columns else F.lit(None).cast("string")
        for c in CLEANED_DIMS
    }
    return df.select(
        F.col(OWNER).cast("string").alias(OWNER),
        F.when(age.between(0, 300), age).alias("LandlordAge"),
        area.alias("Area"),
        people.alias("TotalPopulationAround"),
        firms.alias("ActiveCompanies"),
        safe_ratio_eps(people, area).alias("PopulationDensity"),
        safe_ratio_eps(area, firms).alias("AreaPerCompany"),
        safe_ratio_eps(people, firms).alias("PopulationPerCompany"),
        *[c.alias(name) for name, c in dims.items()],
    )


def portfolio_features(model_base: DataFrame) -> DataFrame:
    """Member signals per owner in one grouped aggregation; size counts unmatched members too."""
    num = lambda c: col_or_null(model_base, c)
    kept = safe_ratio_eps(num("ReturningClient"), num("TotalActiveClients"))
    std = lambda c: F.when(F.count(c) > 1, F.stddev_samp(c))
    return model_base.groupBy(F.col(OWNER).cast("string").alias(OWNER)).agg(
        F.count(F.lit(1)).alias("PortfolioSize"),
        F.avg(num("CompanyIsActive")).alias("PortfolioActiveRate"),
        F.avg(num("MonthlyBudget")).alias("PortfolioMeanBudget"),
        std(num("MonthlyBudget")).alias("PortfolioStdBudget"),
        F.avg(num("SalesOfMainProduct")).alias("PortfolioMeanSales"),
        F.avg(num("TotalActiveClients")).alias("PortfolioMeanClients"),
        F.avg(kept).alias("PortfolioMeanRetention"),
        F.avg(num("SuccessScore")).alias("PortfolioMeanSuccessScore"),
        std(num("SuccessScore")).alias("PortfolioStdSuccessScore"),
    )


def entity_shrunk_score(
    rows: DataFrame, residual: str = "OOFResidual", m: float = PortfolioConfig.shrinkage_m
) -> DataFrame:
    """Mean residual per owner shrunk to the global mean.

    The global mean is taken from the owner sums, so the scalar subquery reuses their shuffle instead
    of reading the rows again.
    """
    known = rows.filter(F.col(residual).isNotNull())
    per = known.groupBy(OWNER).agg(F.count(residual).alias("TenantCount"), F.sum(residual).alias("_sum"))
    overall = per.agg(F.sum("_sum") / F.sum("TenantCount")).scalar()
    n = F.col("TenantCount").cast("double")
    raw = F.col("_sum") / n
    shrunk = raw if m == 0 else n / (n + m) * raw + F.lit(float(m)) / (n + m) * overall
    return per.select(OWNER, "TenantCount", raw.alias("RawAdjustedScore"), shrunk.alias("AdjustedScore"))


def build_landlord_matrix(
    landlords: DataFrame, model_base: DataFrame, scores: DataFrame, reference_year: int,
    feature_set: str = "with_portfolio",
) -> DataFrame:
    """Owner features LEFT JOIN portfolio features INNER JOIN scores."""
    if feature_set not in ("landlord_only", "with_portfolio"):
        raise ValueError(f"unknown feature set {feature_set!r}")
    require_columns(scores, [OWNER, "AdjustedScore"])
    matrix = landlord_features(landlords, reference_year)
    if feature_set == "with_portfolio":
        matrix = matrix.join(portfolio_features(model_base), OWNER, "left")
    keep = [OWNER, "AdjustedScore"] + (["TenantCount"] if "TenantCount" in scores.columns else [])
    return matrix.join(scores.select(*keep), OWNER)


def feature_lists(matrix: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature columns by type, without ids and targets."""
    use = [f for f in matrix.schema.fields if f.name not in NON_FEATURES]
    return (
        [f.name for f in use if isinstance(f.dataType, T.NumericType)],
        [f.name for f in use if isinstance(f.dataType, T.StringType)],
    )


def build_scoring_matrix(
    landlords: DataFrame, bridge: DataFrame, companies: DataFrame, scored: DataFrame | None,
    reference_year: int, feature_set: str = "with_portfolio",
) -> DataFrame:
    """The training features without a target; TenantCount falls back to the portfolio size."""
    base = build_model_base(bridge, companies)
    if scored is not None:
        base = attach_targets(base, scored)
    matrix = landlord_features(landlords, reference_year)
    if feature_set == "with_portfolio":
        matrix = matrix.join(portfolio_features(base), OWNER, "left")
    if "TenantCount" not in matrix.columns and "PortfolioSize" in matrix.columns:
        matrix = matrix.withColumn("TenantCount", F.col("PortfolioSize"))
    return matrix


def route_scoring_input(
    upload: DataFrame, landlords: DataFrame, tenant_lists: DataFrame, companies: DataFrame,
    scored: DataFrame | None, reference_year: int, numeric: list[str] = (), categorical: list[str] = (),
) -> tuple[str, DataFrame]:
    """Send a ready matrix, an id list or a raw owner table down the same feature path."""
    kind = detect_input_kind(upload.columns, numeric, categorical)
    if kind == "feature_matrix":
        return kind, ensure_columns(upload, numeric, categorical)
    require_columns(upload, [OWNER])
    if kind == "unknown" and "AllCompanyID" not in upload.columns:
        return kind, ensure_columns(upload, numeric, categorical)
    owners = upload
    if kind == "landlord_ids":
        owners = semi_filter_ids(landlords, upload, OWNER)
        if owners.limit(1).isEmpty():
            raise ValueError("none of the given LandLordIDs is known")
    lists = upload if "AllCompanyID" in upload.columns else semi_filter_ids(tenant_lists, owners, OWNER)
    matrix = build_scoring_matrix(owners, explode_bridge(lists), companies, scored, reference_year)
    return kind, ensure_columns(matrix, numeric, categorical)


def anti_coverage(bridge: DataFrame, companies: DataFrame) -> DataFrame:
    """Ids on one side only, overlap and match rates. The two id sets meet once, as tagged rows."""
    tagged = bridge.select(F.col(MEMBER).cast("string").alias("id"), F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(
        companies.select(F.col(MEMBER).cast("string").alias("id"), F.lit(0).alias("b"), F.lit(1).alias("c"))
    )
    ids = tagged.groupBy("id").agg(F.max("b").alias("b"), F.max("c").alias("c"))
    b, c = F.col("b") == 1, F.col("c") == 1
    one = ids.agg(
        count_if(c).alias("companies_in_table"), count_if(b).alias("companies_in_bridge"),
        count_if(b & c).alias("overlap"), count_if(b & ~c).alias("bridge_not_in_companies"),
        count_if(c & ~b).alias("companies_not_in_bridge"),
        count_if(b & (F.col("id").contains("[") | F.col("id").contains("'"))).alias("malformed_bridge_ids"),
    )
    rate = lambda d: F.round(F.col("overlap") * 100.0 / F.greatest(F.col(d), F.lit(1)), 2)
    return one.withColumns({
        "match_rate_bridge_pct": rate("companies_in_bridge"),
        "coverage_rate_companies_pct": rate("companies_in_table"),
    })


def id_set_algebra(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Every id of either side with where it occurs: both / left_only / right_only."""
    a = left.select(F.col(id_col).cast("string").alias(id_col), F.lit(1).alias("s"))
    b = right.select(F.col(id_col).cast("string").alias(id_col), F.lit(2).alias("s"))
    sides = a.unionByName(b).groupBy(id_col).agg(F.bit_or("s").alias("s"))
    return sides.select(
        id_col,
        F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "left_only").otherwise("right_only").alias("side"),
    )


def claimed_vs_actual(owners: DataFrame, bridge: DataFrame, claimed: str = "ActiveCompanies") -> DataFrame:
    """Claimed against linked member counts: exact and within-one share, median gap, means."""
    from ledgerspark.operators.profile import side_by_side
    from ledgerspark.operators.quality import claimed_sizes
    from ledgerspark.operators.ranking import exact_quantiles

    sized = claimed_sizes(owners, bridge, claimed).withColumn("gap", F.abs(F.col("claimed") - F.col("linked")))
    share = lambda cond: F.round(F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100, 2)
    base = sized.agg(
        share(F.col("gap") == 0).alias("exact_match_pct"),
        share(F.col("gap") <= 1).alias("within_1_pct"),
        F.avg("claimed").alias("mean_claimed"),
        F.avg("linked").alias("mean_linked"),
    )
    return side_by_side(base, exact_quantiles(sized, "gap", {"median_gap": 0.5}).drop("n_valid"))


def prepare_model_frame(matrix: DataFrame, numeric: list[str], categorical: list[str], keep: list[str] = ()) -> DataFrame:
    """Fixed column order, missing dimensions as __missing__, numbers coerced."""
    require_columns(matrix, [*numeric, *categorical])
    texts: list[Column] = [F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias(c) for c in categorical]
    nums: list[Column] = [F.col(c).try_cast("double").alias(c) for c in numeric]
    return matrix.select(*keep, *nums, *texts)
